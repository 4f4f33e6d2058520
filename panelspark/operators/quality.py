"""Data-quality operators: each is one aggregation over the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import row_sum
from .reshape import stack_measures


class ExpectationError(ValueError):
    """Rows break a rule that should hold everywhere."""


def expectations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per rule; a condition that is null counts as broken."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    cells = [F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules]
    return counts.select(F.explode(F.array(*cells)).alias("_r")).select("_r.*")


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Return ``df`` unchanged or raise with the broken rules and their counts."""
    broken = {row["rule"]: row["violations"] for row in expectations(df, rules).collect() if row["violations"]}
    if broken:
        raise ExpectationError(str(broken))
    return df


def null_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null, NaN and infinite counts per numeric column."""
    inf = F.lit(float("inf"))
    counts = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"{c}|nulls") for c in cols],
        *[F.count_if(F.isnan(F.col(c).cast("double"))).alias(f"{c}|nans") for c in cols],
        *[F.count_if(F.abs(F.col(c).cast("double")) == inf).alias(f"{c}|infs") for c in cols],
    )
    cells = [
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{c}|{k}`").alias(k) for k in ("nulls", "nans", "infs")]) for c in cols
    ]
    return counts.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def require_finite(df: DataFrame, cols: list[str]) -> DataFrame:
    bad = [r["column_name"] for r in null_profile(df, cols).collect() if r["nulls"] + r["nans"] + r["infs"]]
    if bad:
        raise ExpectationError(f"null, NaN or infinite values in {bad}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def total_report(df: DataFrame, keys: list[str], total: str, sums: dict[str, list[str]]) -> DataFrame:
    """Does each set of measures add up to the total, and by how much does it miss."""
    out = []
    for name, cols in sums.items():
        s = row_sum(cols)
        out += [(s == F.col(total)).alias(f"{name}_match"), F.abs(s - F.col(total)).alias(f"{name}_diff")]
    return df.select(*keys, *out)


def column_range(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.min(c).alias("low"), F.max(c).alias("high"))


def summary(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """Count, range, mean and sample deviation per column."""
    stats = {"filled": F.count, "low": F.min, "high": F.max, "mean": F.avg, "sd": F.stddev_samp}
    wide = df.agg(*[f(c).alias(f"{c}|{n}") for c in cols for n, f in stats.items()])
    rows = {}
    for c in cols:
        rows[c] = {n: F.col(f"`{c}|{n}`") if n in ("filled", "low", "high") else F.round(F.col(f"`{c}|{n}`"), digits) for n in stats}
    return stack_measures(wide, rows, "column_name").withColumn("filled", F.col("filled").cast("bigint"))
