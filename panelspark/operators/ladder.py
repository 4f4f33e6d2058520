"""Exact ranks and quantiles without putting a whole group into one task.

A plain rank window sorts one group in one task, so a group that holds a third of
all rows does not scale. Here equal values are counted first (map-side combine). The
distinct values are dealt by ranges of (group, value), whose bounds Spark draws from them, so
that slices are even whatever the values are: a day of epoch seconds spreads like
amounts over ten powers of ten. A running sum inside each slice and a short one over the slices of
a group give every distinct value the number of rows below it.

The sliced values are written once, with the number of their slice, and read by all later steps: a task that
is computed again cannot deal a value to another slice than the sums were taken of. Each ladder
is thus climbed once, however many results are drawn from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Slices at least, however few shuffle partitions the session has.
LEAST_SLICES = 16


def _starts(batch: pa.RecordBatch, keys: list[str], last: list) -> np.ndarray:
    """Whether each row begins a group; ``last`` holds the keys of the row before the batch, or nothing."""
    out = np.zeros(batch.num_rows, bool)
    out[0] = [batch.column(k)[0].as_py() for k in keys] != last
    for k in keys:
        values = batch.column(k)
        out[1:] |= pc.fill_null(pc.not_equal(values[1:], values[:-1]), False).to_numpy(zero_copy_only=False)
    return out


def _climb(keys: list[str], exact: bool):
    """Append the running sum of ``n`` in each group of sorted rows, and the number of the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, carried = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n")
            n = n.to_numpy(zero_copy_only=False) if exact else np.array(n.to_pylist(), object)
            starts = _starts(batch, keys, last)
            total = np.cumsum(n)
            at = np.flatnonzero(starts)
            # what came before a group's first row in this batch; before the first group it is what was carried
            base = np.concatenate([[-carried], total[at] - n[at]]) if len(at) else np.array([-carried])
            upto = total - base[np.cumsum(starts)]
            last, carried = [batch.column(k)[-1].as_py() for k in keys], upto[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto, batch.column("n").type), pa.array(np.full(len(upto), part, np.int32))], names=[*batch.schema.names, "_upto", "_slice"])

    return run


def value_ladder(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """One row per (keys, distinct value): ``n`` rows, ``below`` rows with a smaller value, ``total``.

    Null values are left out, so they move no rank. ``keys`` must not be null.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    slices = max(LEAST_SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    exact = dict(counted.dtypes)["n"] in ("bigint", "double")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema.fields)
    dealt = counted.repartitionByRange(slices, *keys, value).sortWithinPartitions(*keys, value)
    climbed = cut_lineage(dealt.mapInArrow(_climb(keys, exact), f"{schema}, _upto {dict(counted.dtypes)['n']}, _slice int"))
    # a row for each group and slice
    sums = climbed.groupBy(*keys, "_slice").agg(F.sum("n").alias("_n"))
    along = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    placed = sums.select(*keys, "_slice", (F.sum("_n").over(along) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("total"))
    return climbed.join(placed, [*keys, "_slice"]).select(*keys, value, "n", (F.col("_before") + F.col("_upto") - F.col("n")).alias("below"), "total")


def rank_columns(df: DataFrame, keys: list[str], value: str, **names: Column) -> DataFrame:
    """Attach columns computed from the ladder (``n``, ``below``, ``total``) to every row."""
    rungs = value_ladder(df, keys, value).select(*keys, value, *[e.alias(k) for k, e in names.items()])
    return df.join(rungs, [*keys, value], "left")


def pct_rank_avg(df: DataFrame, keys: list[str], value: str, out: str, digits: int | None = 4) -> DataFrame:
    """Average-tie rank divided by the non-null count of the group; null in, null out."""
    share = (F.col("below") + (F.col("n") + 1) / 2) / F.col("total")
    return rank_columns(df, keys, value, **{out: share if digits is None else F.bround(share, digits)})


def pct_rank_many(df: DataFrame, row_key: list[str], keys: list[str], cols: list[str], prefix: str = "percentile_", digits: int | None = 4) -> DataFrame:
    """Percentile ranks of several columns with one ladder: long form, one join, one pivot back.

    ``row_key`` names a row; ``df`` should be a stored table, since it is read three times.
    """
    index = list(dict.fromkeys([*row_key, *keys]))
    long = df.select(*index, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(index, cols, "_name", "_value")
    ranked = pct_rank_avg(long.where("_value IS NOT NULL"), [*keys, "_name"], "_value", "_rank", digits)
    wide = ranked.groupBy(*row_key).agg(*[F.max(F.when(F.col("_name") == c, F.col("_rank"))).alias(f"{prefix}{c}") for c in cols])
    return df.join(wide, row_key, "left")


def avg_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    return rank_columns(df, keys, value, **{out: F.col("below") + (F.col("n") + 1) / 2})


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float | Column]) -> DataFrame:
    """Exact linear-interpolated quantiles, one column per entry of ``probs``.

    A probability may be a column of the ladder (it can use ``total``).
    """
    rungs = value_ladder(df, keys, value)
    aggs, outs = [], []
    for name, p in probs.items():
        prob = p if isinstance(p, Column) else F.lit(float(p))
        at = (F.col("total") - 1) * prob
        low, high = F.floor(at), F.ceil(at)

        def holds(k: Column) -> Column:
            return (F.col("below") <= k) & (k < F.col("below") + F.col("n"))

        aggs += [
            F.max(F.when(holds(low), F.col(value).cast("double"))).alias(f"_lo_{name}"),
            F.max(F.when(holds(high), F.col(value).cast("double"))).alias(f"_hi_{name}"),
            F.max(at - low).alias(f"_at_{name}"),
        ]
        lo, hi, frac = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_at_{name}")
        outs.append((lo + (hi - lo) * frac).alias(name))
    return rungs.groupBy(*keys).agg(*aggs).select(*keys, *outs)


def quantile_edges(df: DataFrame, keys: list[str], value: str, bins: Column | int, digits: int | None = 0) -> DataFrame:
    """Inner edges of ``bins`` equal-count bins per group as rows (keys, edge), without repeats.

    ``bins`` may be a column of the ladder, e.g. ``greatest(2, total div 1000)``: the edges
    then grow with the group, which is why they are rows and not one array.
    """
    return ladder_edges(value_ladder(df, keys, value), keys, value, bins, digits)


def ladder_edges(ladder: DataFrame, keys: list[str], value: str, bins: Column | int, digits: int | None = 0) -> DataFrame:
    """The same from a ladder that is at hand."""
    count = (bins if isinstance(bins, Column) else F.lit(bins)).cast("bigint")
    rungs = ladder.withColumn("_bins", count)
    v, size = F.col(value).cast("double"), F.col("_bins")
    last = F.greatest(F.col("total") - 1, F.lit(1))
    # only the edges whose neighbouring ranks can fall on this value
    first_edge = F.greatest(F.lit(1), F.floor((F.col("below") - 1) * size / last))
    last_edge = F.least(size - 1, F.ceil((F.col("below") + F.col("n")) * size / last))
    touched = rungs.where(first_edge <= last_edge).withColumn("_edge", F.explode(F.sequence(first_edge, last_edge)))
    at = (F.col("total") - 1) * F.col("_edge") / size

    def here(k: Column) -> Column:
        return (F.col("below") <= k) & (k < F.col("below") + F.col("n"))

    found = touched.groupBy(*keys, "_edge").agg(
        F.max(F.when(here(F.floor(at)), v)).alias("_lo"),
        F.max(F.when(here(F.ceil(at)), v)).alias("_hi"),
        F.max(at - F.floor(at)).alias("_frac"),
    )
    edge = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")
    return found.select(*keys, (edge if digits is None else F.bround(edge, digits)).alias("edge")).distinct()


def edge_array(edges: DataFrame, keys: list[str], out: str = "breaks") -> DataFrame:
    """Edges as one sorted array per group; for a fixed number of bins only."""
    return edges.groupBy(*keys).agg(F.array_sort(F.collect_set("edge")).alias(out))


def mark_edges(values: DataFrame, keys: list[str], value: str, edges: DataFrame) -> DataFrame:
    """(keys, _v, n, below) of every value and edge: edges at it, and edges below it."""
    points = values.select(*keys, F.col(value).cast("double").alias("_v"), F.lit(0).alias("_e"))
    marks = edges.select(*keys, F.col("edge").alias("_v"), F.lit(1).alias("_e"))
    return value_ladder(points.unionByName(marks), keys, "_v", F.col("_e"))


def number_by_marks(df: DataFrame, keys: list[str], value: str, marked: DataFrame, out: str, closed: str = "right") -> DataFrame:
    """Bin number of every row from its value's marks."""
    number = F.col("below") if closed == "right" else F.col("below") + F.col("n")
    numbered = marked.select(*keys, "_v", number.cast("int").alias(out))
    return df.withColumn("_v", F.col(value).cast("double")).join(numbered, [*keys, "_v"], "left").drop("_v")


def bin_by_edges(df: DataFrame, keys: list[str], value: str, edges: DataFrame, out: str, closed: str = "right") -> DataFrame:
    """Bin number of every row against edge rows of its group.

    Right-closed bins count the edges below the value, left-closed bins also those equal
    to it: both are running counts of edges on the value axis, so neither the rows nor
    the edges of a group meet in one task.
    """
    return number_by_marks(df, keys, value, mark_edges(df, keys, value, edges), out, closed)


def edge_bounds(edges: DataFrame, keys: list[str], out: str = "bin") -> DataFrame:
    """Lower and upper edge of every bin; the outer bins are open."""
    return placed_bounds(value_ladder(edges, keys, "edge"), keys, out)


def placed_bounds(placed: DataFrame, keys: list[str], out: str = "bin") -> DataFrame:
    """Bounds from edges (keys, edge) with the number of edges below each."""
    inf = F.lit(float("inf"))
    sides = placed.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("below").cast("int").alias(out), F.lit(None).cast("double").alias("lower"), F.col("edge").alias("upper")),
                F.struct((F.col("below") + 1).cast("int").alias(out), F.col("edge").alias("lower"), F.lit(None).cast("double").alias("upper")),
            )
        ).alias("_b"),
    ).select(*keys, "_b.*")
    return sides.groupBy(*keys, out).agg(
        F.coalesce(F.max("lower"), -inf).alias("lower"), F.coalesce(F.max("upper"), inf).alias("upper")
    )


def clamp_order_statistics(df: DataFrame, keys: list[str], value: str, fraction: float, out: str) -> DataFrame:
    """Winsorise: the int(fraction*n) smallest and largest values take the next order statistic."""
    k = F.floor(F.lit(fraction) * F.col("total"))
    rungs = value_ladder(df, keys, value)
    v = F.col(value)
    low_at = (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
    top = F.col("total") - 1 - k
    high_at = (F.col("below") <= top) & (top < F.col("below") + F.col("n"))
    bounds = rungs.groupBy(*keys).agg(F.max(F.when(low_at, v)).alias("_low"), F.max(F.when(high_at, v)).alias("_high"))
    joined = attach(df, bounds, keys)
    clipped = F.greatest(F.least(v, F.col("_high")), F.col("_low"))
    return joined.withColumn(out, F.when(v.isNotNull(), clipped)).drop("_low", "_high")


def attach(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join per-group values back to the rows.

    No broadcast hint: Spark broadcasts ``stats`` only when its measured size is under
    the session threshold and otherwise sort-merges with skew splitting. Without keys the
    one-row table is read through scalar subqueries.
    """
    if keys:
        return df.join(stats, keys, how)
    out = df
    for name in stats.columns:
        out = out.withColumn(name, stats.select(name).scalar())
    return out


def running_total(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Running sum in the order of a column that is unique inside the group."""
    rungs = value_ladder(df, keys, order, F.col(value)).select(*keys, order, (F.col("below") + F.col("n")).alias(out))
    return df.join(rungs, [*keys, order], "left")


def hashed_position(df: DataFrame, key: list[str], seed: int, out: str, keys: list[str] | None = None) -> DataFrame:
    """Position 0..n-1 of every row in a hash order, exact and without a single-task sort.

    Two rows with one hash keep a fixed order by their key inside the slice.
    """
    keys = keys or []
    h = F.xxhash64(*[F.col(k) for k in key], F.lit(seed))
    hashed = df.withColumn("_h", h).withColumn("_slice", F.shiftright("_h", 48))
    along = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        hashed.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_slice_n"))
        .withColumn("_before", F.coalesce(F.sum("_slice_n").over(along), F.lit(0)))
        .drop("_slice_n")
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy("_h", *key)
    return (
        hashed.withColumn("_inner", F.row_number().over(inside) - 1)
        .join(slices, [*keys, "_slice"])
        .withColumn(out, F.col("_before") + F.col("_inner"))
        .drop("_h", "_slice", "_inner", "_before")
    )
