"""Wide/long reshaping, unions and keys grids."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YEAR = re.compile(r"\d{4}$")


def unpivot_years(df: DataFrame, key: str, source: str) -> DataFrame:
    """Columns ending in four digits become (key, feature, period, raw); others are ignored."""
    yearly = [c for c in df.columns if YEAR.search(c)]
    if not yearly:
        raise ValueError("no column ends in a year")
    cells = df.select(key, *[F.col(c).cast("string").try_cast("double").alias(c) for c in yearly])
    long = cells.unpivot([key], yearly, "_name", "raw")
    return long.select(
        key,
        F.concat(F.lit(f"{source}/"), F.regexp_replace("_name", r"\d{4}$", "")).alias("feature"),
        F.regexp_extract("_name", r"(\d{4})$", 1).cast("bigint").alias("period"),
        "raw",
    )


def pivot_values(df: DataFrame, index: list[str], on: str, levels: list, values: list[str]) -> DataFrame:
    """Long to wide with the first value per cell; columns are ``{value}_{level}``.

    ``levels`` is required: Spark then needs no extra pass to find them.
    """
    wide = df.groupBy(*index).pivot(on, levels).agg(*[F.first(v, ignorenulls=False).alias(v) for v in values])
    if len(values) == 1:
        return wide.select(*index, *[F.col(f"`{l}`").alias(f"{values[0]}_{l}") for l in levels])
    return wide.select(*index, *[F.col(f"`{l}_{v}`").alias(f"{v}_{l}") for v in values for l in levels])


def union_diagonal(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def period_grid(df: DataFrame, key: str, feature: str = "feature", period: str = "period") -> DataFrame:
    """Every key with every period between a feature's first and last one, without a cross join.

    The feature ranges are one small row per feature (features are columns of a source
    table); they are folded into one array read through a scalar subquery and exploded
    next to each distinct key.
    """
    ranges = df.groupBy(feature).agg(F.min(period).alias("first"), F.max(period).alias("last"))
    packed = ranges.agg(F.collect_list(F.struct(feature, "first", "last")).alias("r"))
    keys = df.select(key).distinct()
    return (
        keys.withColumn("_r", F.explode(packed.scalar()))
        .select(key, F.col(f"_r.{feature}").alias(feature), F.explode(F.sequence("_r.first", "_r.last")).alias(period))
    )


def fill_grid(df: DataFrame, key: str, feature: str = "feature", period: str = "period") -> DataFrame:
    """The long table on its full grid; absent cells hold null."""
    return period_grid(df, key, feature, period).join(df, [key, feature, period], "left")


def shift_periods(df: DataFrame, period: str, feature: str, steps: int) -> DataFrame:
    """Copies of a long table moved forward by 1..steps periods, feature tagged ``|minus_i``.

    One explode of a literal array instead of one join per step.
    """
    shifted = df.withColumn("_i", F.explode(F.array(*[F.lit(i) for i in range(steps + 1)])))
    tag = F.when(F.col("_i") == 0, F.col(feature)).otherwise(F.concat(F.col(feature), F.lit("|minus_"), F.col("_i").cast("string")))
    return shifted.withColumns({feature: tag, period: F.col(period) + F.col("_i")}).drop("_i")


def melt(df: DataFrame, keys: list[str], cols: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(keys, cols, name, value)


def tables_between(df: DataFrame, start: str, end: str, order: str = "table_no", title: str = "title") -> DataFrame:
    """Rows of the tables from one title to another (both included) in page order."""
    bounds = df.agg(
        F.min(F.when(F.col(title) == start, F.col(order))).alias("a"),
        F.min(F.when(F.col(title) == end, F.col(order))).alias("b"),
    )
    return df.where(F.col(order).between(bounds.select("a").scalar(), bounds.select("b").scalar()))


def explode_grid(df: DataFrame, values: list[float], out: str) -> DataFrame:
    """Every row once per grid value, as a narrow explode of a literal array."""
    return df.withColumn(out, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def stack_measures(df: DataFrame, rows: dict[str, dict[str, Column]], name: str = "measure") -> DataFrame:
    """One wide row to several named rows: ``{row name: {column: expression}}``."""
    cells = [F.struct(F.lit(n).alias(name), *[e.cast("double").alias(c) for c, e in cols.items()]) for n, cols in rows.items()]
    return df.select(F.explode(F.array(*cells)).alias("_m")).select("_m.*")
