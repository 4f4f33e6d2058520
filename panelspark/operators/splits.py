"""Train / validation / test splits and target assembly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stable_bucket
from ..session import cut_lineage
from .windows import group_mean_fill, level_deltas


def temporal_split(df: DataFrame, period: str, kind: str, year: int, wanted_kind: str, target: str, reach: int = 15, disjoint: bool = False) -> dict[str, DataFrame]:
    """Test is the year, train the ``reach`` years before, validation all earlier years.

    Validation contains the training rows unless ``disjoint`` keeps only the years before them.
    Three filters on one frame: partition pruning applies to each.
    """
    rows = df.where((F.col(kind) == wanted_kind) & F.col(target).isNotNull())
    p = F.col(period)
    val = rows.where(p < (year - reach if disjoint else year))
    return {"train": rows.where((p >= year - reach) & (p < year)), "val": val, "test": rows.where(p == year)}


def previous_events_split(df: DataFrame, period: str, kind: str, year: int, wanted_kind: str) -> dict[str, DataFrame]:
    """Test is the year, train the event before, validation the one before that."""
    rows = df.where(F.col(kind) == wanted_kind)
    years = [r[0] for r in rows.select(period).distinct().orderBy(period).collect()]
    if year not in years or years.index(year) < 2:
        raise ValueError(f"{year} has fewer than two earlier events of kind {wanted_kind}")
    at = years.index(year)
    pick = lambda y: rows.where(F.col(period) == y)
    return {"train": pick(years[at - 1]), "val": pick(years[at - 2]), "test": pick(year)}


def hashed_split(df: DataFrame, key: str, test: float = 0.2, val: float = 0.2, seed: int = 42) -> DataFrame:
    """Column ``part`` in train / val / test decided by the key alone (a row key, or a year for whole-year splits).

    The three parts are disjoint and repeatable on any cluster; no shuffle.
    """
    b = stable_bucket(key, 10_000, seed)
    return df.withColumn("part", F.when(b < int(test * 10_000), "test").when(b < int((test + val) * 10_000), "val").otherwise("train"))


def target_frame(df: DataFrame, target: str, mode: str, features: list[str], meta: list[str], region: str) -> DataFrame:
    """Meta, features, target ``y`` and its previous value ``y_prev``.

    ``mode`` is level, delta or percentile. Missing previous values take their region's mean.
    """
    previous = [f"previous_{target}", f"previousprevious_{target}", f"previous_percentile_{target}"]
    filled = level_deltas(group_mean_fill(df, [region], previous, fallback=False), target)
    y, y_prev = {
        "level": (target, f"previous_{target}"),
        "delta": (f"delta_{target}", f"previous_delta_{target}"),
        "percentile": (f"percentile_{target}", f"previous_percentile_{target}"),
    }[mode]
    return filled.where(F.col(y).isNotNull()).select(*meta, *features, F.col(y).alias("y"), F.col(y_prev).alias("y_prev"))


#: Rows of a strip of the product matrix, and parts that one task of the tree adds for a strip.
STRIP_ROWS, TREE_PARTS = 64, 32


def added_in_tree(rows: DataFrame, key: str, part: str) -> DataFrame:
    """Sums of vectors of doubles, packed as bytes, by key: no task adds more than about ``TREE_PARTS`` parts of a key.

    Each level writes its sums, a ``TREE_PARTS``-th of those before, until one is left for each key.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for k, g, raw in zip(*(batch.column(c).to_pylist() for c in ("k", "g", "part"))):
                if (k, g) != at:
                    if at is not None:
                        yield made(at, total)
                    at, total = (k, g), np.zeros(len(raw) // 8)
                total += np.frombuffer(raw)
        if at is not None:
            yield made(at, total)

    def made(at: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["k", "g", "part"])

    now = cut_lineage(rows.select(F.col(key).alias("k"), F.monotonically_increasing_id().alias("g"), F.col(part).alias("part")))
    while True:
        most = now.groupBy("k").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return now.select(F.col("k").alias(key), F.col("part").alias(part))
        groups = -(-most // TREE_PARTS)
        dealt = now.withColumn("g", F.pmod(F.xxhash64("g"), F.lit(groups)))
        now = cut_lineage(dealt.repartition("k", "g").sortWithinPartitions("k", "g").mapInArrow(added, "k int, g bigint, part binary"))


def correlation_matrix(df: DataFrame, features: list[str]) -> np.ndarray:
    """Pearson correlations of all pairs of features over the rows where both are given.

    Tasks add up products of the centred values, their squares and their presence. Their matrices of
    (3 k)² numbers are cut into strips, which are added in a tree, each by itself.
    """
    row = df.agg(*[F.avg(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)]).first()
    middle, k = np.array([0.0 if m is None else m for m in row]), len(features)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3 * k, 3 * k))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)]).astype(float) - middle
            given = ~np.isnan(x)
            x = np.where(given, x, 0.0)
            wide = np.hstack([given, x, x * x])
            total += wide.T @ wide
        for i in range(0, 3 * k, STRIP_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i : i + STRIP_ROWS].tobytes()], pa.binary())], names=["i", "part"])

    numbers = df.select(*[F.col(f).cast("double") for f in features])
    rows = numbers.mapInArrow(products, "i int, part binary")
    sums = added_in_tree(rows, "i", "part")
    found = {r["i"]: np.frombuffer(r["part"]) for r in sums.collect()}
    if not found:
        return np.full((k, k), np.nan)
    g = np.vstack([found[i].reshape(-1, 3 * k) for i in sorted(found)])
    g = g.reshape(3, k, 3, k).swapaxes(1, 2)
    n, x, xx, xy = g[0, 0], g[1, 0], g[2, 0], g[1, 1]  # by (i, j): rows with both, sums of i, of its squares, of products
    with np.errstate(invalid="ignore", divide="ignore"):
        return (xy - x * x.T / n) / np.sqrt((xx - x * x / n) * (xx - x * x / n).T)


def correlated_to_drop(df: DataFrame, features: list[str], threshold: float = 0.95, absolute: bool = False) -> list[str]:
    """Features that correlate above the threshold with an earlier one; all pairs come from one pass."""
    if len(features) < 2:
        return []
    r = correlation_matrix(df, features)
    hit = (np.abs(r) if absolute else r) > threshold
    return [f for i, f in enumerate(features) if hit[i, :i].any()]


def stationary_features(features: list[str], keep_previous: bool = True) -> list[str]:
    """Features that are ranks, shares or changes by name; levels go, and 'previous' columns on request."""
    stationary = [f for f in features if any(t in f for t in ("rank", "delta", "pct_change", "prop", "share", "percentile", "previous"))]
    return stationary if keep_previous else [f for f in stationary if "previous" not in f]
