"""Repeatable samples and score cut-offs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stable_bucket, stable_number
from .ladder import attach, quantiles


def stable_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in hash order: repeatable, and each task sends at most n rows on."""
    return df.orderBy(stable_number(key, seed), key).limit(n)


def stable_fraction(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """About ``fraction`` of the rows, decided by the key alone; no shuffle."""
    steps = 1_000_000
    return df.where(stable_bucket(key, steps, seed) < int(fraction * steps))


def above_median(df: DataFrame, score: str, key: str, factor: float = 2.0, cap: int | None = None) -> DataFrame:
    """Rows scoring above ``factor`` times the median, or the best row alone; at most ``cap`` of them."""
    stats = attach(df, quantiles(df, [], score, {"_median": 0.5}), [])
    stats = attach(stats, df.agg(F.max(score).alias("_best")), [])
    over = F.col(score) > F.lit(factor) * F.col("_median")
    alone = (F.col("_best") <= F.lit(factor) * F.col("_median")) & (F.col(score) == F.col("_best"))
    kept = stats.where(over | alone).drop("_median", "_best").orderBy(F.col(score).desc(), key)
    return kept if cap is None else kept.limit(cap)
