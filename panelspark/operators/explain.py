"""Model explanation as Spark jobs: importance, Shapley values, dependence, local effects."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import stable_number
from ..session import cut_lineage
from .ladder import bin_by_edges, edge_bounds, quantile_edges
from .metrics import basic_metrics
from .reshape import explode_grid
from .sampling import stable_sample

Scorer = Callable[[DataFrame], DataFrame]


#: Rounds of the shuffle of positions, and the numbers that its keys and coins are drawn with.
ROUNDS, _PRIME, _SPREAD = 16, (1 << 31) - 1, 1_326_507_023


def _mixed(x: Column) -> Column:
    spread = x % _PRIME * _SPREAD % _PRIME
    return spread * spread % _PRIME


def shuffle_keys(spark: SparkSession, jobs: int, first: int = 0) -> DataFrame:
    """(_job, _keys): the keys of each job's rounds."""
    rounds = F.sequence(F.lit(1).cast("bigint"), F.lit(ROUNDS).cast("bigint"))
    return spark.range(first, first + jobs).select(F.col("id").alias("_job"), F.transform(rounds, lambda i: _mixed(_mixed(F.col("id") * ROUNDS + i) + i)).alias("_keys"))


def shuffled(position: Column, count: int, keys: Column) -> Column:
    """Position in a permutation of 0..count-1 that the keys name, without a table.

    In each round a position and its mirror image about the round's key change places or not, by a coin that
    both see alike. A round is its own inverse, so all positions are permuted, for any count.
    """

    def swap(at: Column, key: Column) -> Column:
        mirror = F.pmod(key * (count // _PRIME + 1) + key - at, F.lit(count).cast("bigint"))
        return F.when(_mixed(F.greatest(at, mirror) + key) < F.lit(_PRIME // 2), mirror).otherwise(at)

    return F.aggregate(keys, position.cast("bigint"), swap)


def _rest(x: np.ndarray, by: int) -> np.ndarray:
    """x modulo ``by``, never negative; a division by one number is much faster than the remainder."""
    return x - x // by * by


def _mixed_array(x: np.ndarray) -> np.ndarray:
    spread = _rest(_rest(x, _PRIME) * _SPREAD, _PRIME)
    return _rest(spread * spread, _PRIME)


def shuffled_array(positions: np.ndarray, count: int, job: int) -> np.ndarray:
    """What ``shuffled`` gives with the keys that ``shuffle_keys`` names for the job, for whole arrays."""
    rounds = np.arange(1, ROUNDS + 1, dtype=np.int64)
    at = positions
    for key in _mixed_array(_mixed_array(job * ROUNDS + rounds) + rounds).tolist():
        mirror = _rest(key * (count // _PRIME + 1) + key - at, count)
        at = np.where(_mixed_array(np.maximum(at, mirror) + key) < _PRIME // 2, mirror, at)
    return at


def numbered(df: DataFrame, key: str, seed: int, out: str = "_pos") -> DataFrame:
    """Position 0..n-1 of every row in the order of a portable hash of its key, exact and without a single-task sort."""
    hashed = df.withColumn("_h", stable_number(key, seed))
    slices = hashed.groupBy(F.shiftright("_h", 44).alias("_slice")).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # 65,536 slices at most
    before = slices.select("_slice", F.coalesce(F.sum("_n").over(along), F.lit(0).cast("bigint")).alias("_before"))
    inside = Window.partitionBy("_slice").orderBy("_h", key)
    placed = hashed.withColumn("_slice", F.shiftright("_h", 44)).withColumn("_inner", F.row_number().over(inside) - 1)
    return placed.join(before, "_slice").withColumn(out, F.col("_before") + F.col("_inner")).drop("_h", "_slice", "_inner", "_before")


def permute(df: DataFrame, key: str, column: str, seed: int, job: int = 0) -> DataFrame:
    """The column's values in another row order: every value is used once."""
    rows = cut_lineage(numbered(df, key, seed))
    keys = shuffle_keys(df.sparkSession, 1, job).select("_keys").scalar()
    sent = rows.withColumn("_keys", keys).select(shuffled(F.col("_pos"), max(1, rows.count()), F.col("_keys")).alias("_pos"), column)
    return rows.drop(column).join(sent, "_pos").drop("_pos")


def permuted_scores(score: Scorer, df: DataFrame, key: str, features: list[str], y: str, repeats: int, seed: int = 42) -> DataFrame:
    """(feature, repeat, mse) with one feature permuted at a time, all from one scoring job.

    Every row sends its values on, one for each feature and repeat, to the position that the job's
    permutation gives; the rows meet them there. The plan is the same for one job and for a thousand. The
    partition count is stated: the table is small against the work and would else be merged into few tasks.
    """
    tasks = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(numbered(df.withColumns({f: F.col(f).cast("double") for f in features}), key, seed))
    count, jobs = max(1, rows.count()), len(features) * repeats

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            positions = batch.column(0).to_numpy()
            for job in range(jobs):
                to = pa.array(shuffled_array(positions, count, job))
                yield pa.RecordBatch.from_arrays([to, pa.array(np.full(len(to), job)), batch.column(1 + job // repeats)], names=["_pos", "_job", "_value"])

    number = F.floor(F.col("_job") / repeats).cast("int")
    sent = rows.select("_pos", *features).repartition(tasks, "_pos").mapInArrow(send, "_pos bigint, _job bigint, _value double")
    mixed = rows.repartition(tasks, "_pos").join(sent.repartition(tasks, "_pos"), "_pos").withColumns({f: F.when(number == i, F.col("_value")).otherwise(F.col(f)) for i, f in enumerate(features)})
    miss = F.col(y) - F.col("prediction")
    errors = score(mixed).groupBy("_job").agg(F.avg(miss * miss).alias("mse"))
    name = F.get(F.array(*[F.lit(f) for f in features]), number)
    return errors.select(name.alias("feature"), (F.col("_job") % repeats).cast("int").alias("repeat"), "mse")


def permutation_importance(score: Scorer, df: DataFrame, key: str, features: list[str], y: str, repeats: int = 3, seed: int = 42) -> DataFrame:
    """Rise of the mean squared error when one feature is permuted; mean and deviation over repeats."""
    rows = cut_lineage(df)
    base = basic_metrics(score(rows), y, "prediction").select(F.col("mse").alias("_base"))
    parts = permuted_scores(score, rows, key, features, y, repeats, seed).withColumn("_base", base.scalar())
    rise = F.col("mse") - F.col("_base")
    return parts.groupBy("feature").agg(F.avg(rise).alias("score"), F.stddev_pop(rise).alias("deviation"))


def linear_shapley(df: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """coefficient·(x - mean) per row and feature, exact for a linear model."""
    names = [f for f in weights if f != "intercept"]
    means = df.agg(*[F.avg(f).alias(f"_m_{f}") for f in names])
    out = df
    for f in names:
        out = out.withColumn(f"_m_{f}", means.select(f"_m_{f}").scalar())
    value = lambda f: F.lit(weights[f]) * (F.coalesce(F.col(f).cast("double"), F.col(f"_m_{f}")) - F.col(f"_m_{f}"))
    wide = out.select(key, *[value(f).alias(f) for f in names])
    return wide.unpivot([key], names, "feature", "value")


def sampled_shapley(score: Scorer, df: DataFrame, key: str, features: list[str], background: int = 8, orders: int = 4, seed: int = 42) -> DataFrame:
    """Monte-Carlo Shapley values of any model.

    Each row meets ``background`` reference rows (a literal array exploded next to it) and
    ``orders`` feature orders with their reverses; walking an order, a feature's value is
    the change of the prediction when it switches from reference to own value. The copies
    per row are a fixed number and are averaged map-side.
    """
    rng = random.Random(seed)
    refs = [r.asDict() for r in stable_sample(df.select(key, *features), key, background, seed).collect()]
    walks = []
    for _ in range(orders):
        o = features[:]
        rng.shuffle(o)
        walks += [o, o[::-1]]
    cells = F.array(*[F.struct(*[F.lit(None if r[f] is None else float(r[f])).alias(f) for f in features]) for r in refs])
    rows = df.select(key, *[F.struct(*[F.col(f).cast("double").alias(f) for f in features]).alias("_own")]).withColumn("_ref", F.explode(cells))
    steps = []
    for o in walks:
        for i, f in enumerate(o):
            for side, taken in ((1.0, o[: i + 1]), (-1.0, o[:i])):
                mixed = [(F.col(f"_own.{x}") if x in taken else F.col(f"_ref.{x}")).alias(x) for x in features]
                steps.append(F.struct(F.lit(f).alias("feature"), F.lit(side).alias("side"), *mixed))
    walked = rows.select(key, F.explode(F.array(*steps)).alias("_s")).select(key, "_s.*")
    scored = score(walked)
    n = len(refs) * len(walks)
    return scored.groupBy(key, "feature").agg((F.sum(F.col("side") * F.col("prediction")) / n).alias("value"))


def shapley_importance(values: list[DataFrame], softmax: bool = False) -> DataFrame:
    """Mean |value| per feature averaged over models; optionally softmax-normalised over features."""
    union = None
    for i, v in enumerate(values):
        part = v.groupBy("feature").agg(F.avg(F.abs("value")).alias("s")).withColumn("_m", F.lit(i))
        union = part if union is None else union.unionByName(part)
    mean = union.groupBy("feature").agg((F.sum("s") / len(values)).alias("importance"))
    if not softmax:
        return mean
    e = mean.withColumn("_e", F.exp("importance"))
    return e.withColumn("_t", e.agg(F.sum("_e")).scalar()).select("feature", "importance", (F.col("_e") / F.col("_t")).alias("weight"))


def partial_dependence(score: Scorer, df: DataFrame, key: str, feature: str, grid: list[float], ice: bool = False) -> DataFrame:
    """Mean prediction with the feature set to each grid value, or centred curves per row."""
    on_grid = explode_grid(df.drop(feature), grid, feature)
    scored = score(on_grid).select(key, F.col(feature).alias("at"), "prediction")
    if not ice:
        return scored.groupBy("at").agg(F.avg("prediction").alias("mean"), F.stddev_samp("prediction").alias("sd"))
    start = scored.where(F.col("at") == grid[0]).select(key, F.col("prediction").alias("_0"))
    return scored.join(start, key).select(key, "at", (F.col("prediction") - F.col("_0")).alias("curve"))


def local_effects(score: Scorer, df: DataFrame, key: str, feature: str, bins: int = 20, z: float = 1.96) -> DataFrame:
    """Accumulated local effects: mean change across each quantile bin, summed up and centred.

    Rows are scored twice, at the lower and upper edge of their own bin.
    """
    rows = cut_lineage(df)
    edges = cut_lineage(quantile_edges(rows, [], feature, bins, digits=None))
    bounds = edge_bounds(edges, [], "bin")
    ends = rows.agg(F.min(feature).alias("lo"), F.max(feature).alias("hi"))
    bounds = bounds.withColumns({"_lo": ends.select("lo").scalar(), "_hi": ends.select("hi").scalar()})
    bounds = bounds.select("bin", F.greatest("lower", "_lo").alias("lower"), F.least("upper", "_hi").alias("upper"))
    binned = bin_by_edges(rows, [], feature, edges, "bin").join(bounds, "bin")
    sides = F.array(F.struct(F.col("lower").alias("v"), F.lit(-1.0).alias("s")), F.struct(F.col("upper").alias("v"), F.lit(1.0).alias("s")))
    both = binned.withColumn("_side", F.explode(sides)).withColumn(feature, F.col("_side.v"))
    change = score(both).groupBy(key, "bin", "lower", "upper").agg(F.sum(F.col("_side.s") * F.col("prediction")).alias("d"))
    steps = change.groupBy("bin", "lower", "upper").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("step"), F.stddev_samp("d").alias("sd"))
    # one row per bin: the order window below sees ``bins`` rows at most
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    summed = cut_lineage(steps.withColumn("upto", F.sum("step").over(w)))
    middle = summed.agg((F.sum((F.col("upto") - F.col("step") / 2) * F.col("n")) / F.sum("n")).alias("m"))
    half = z * F.col("sd") / F.sqrt(F.col("n").cast("double"))
    return summed.withColumn("_m", middle.scalar()).select(
        "bin", "lower", "upper", "n", (F.col("upto") - F.col("_m")).alias("effect"), (F.col("upto") - F.col("_m") - half).alias("low"), (F.col("upto") - F.col("_m") + half).alias("high")
    )
