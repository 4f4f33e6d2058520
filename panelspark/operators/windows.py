"""Panel windows.

A panel holds one row per (entity, kind, period): ``unique_panel`` enforces that by
aggregation. A window over one entity therefore never sees more rows than there are
periods, however many raw rows the entity has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, finite
from .ladder import attach, pct_rank_avg, quantiles


def over(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def unique_panel(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """One row per key: the pre-aggregation that bounds every later window."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def lags(df: DataFrame, keys: list[str], order: str, cols: list[str], steps: dict[str, int]) -> DataFrame:
    """Positional lags (previous row, not previous calendar period) as ``{prefix}{column}``."""
    w = over(keys, order)
    return df.select("*", *[F.lag(c, n).over(w).alias(f"{p}{c}") for p, n in steps.items() for c in cols])


def dense_rank_non_null(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Dense rank inside a bounded group; null in, null out."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.dense_rank().over(w)))


def interpolate_linear(df: DataFrame, keys: list[str], order: str, value: str, out: str | None = None) -> DataFrame:
    """Fill interior gaps on a straight line; leading and trailing gaps stay null."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("t"), F.col(value).cast("double").alias("v")))
    w = over(keys, order)
    a = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    step = df.withColumn("_a", a).withColumn("_b", b)
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * F.try_divide(
        (F.col(order) - F.col("_a.t")).cast("double"), (F.col("_b.t") - F.col("_a.t")).cast("double")
    )
    return step.withColumn(out or value, F.coalesce(F.col(value).cast("double"), line)).drop("_a", "_b")


def forward_fill(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    w = over(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def difference(value: str, w: Window) -> Column:
    return F.col(value) - F.lag(value).over(w)


def relative_change(value: str, w: Window, base: str = "previous", fill: bool = True) -> Column:
    """Relative change; ``base='current'`` divides by the current value, ``fill`` carries values forward first."""
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    x = F.last(value, ignorenulls=True).over(frame) if fill else F.col(value)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) if fill else F.lag(value).over(w)
    return F.try_divide(x - before, before if base == "previous" else x)


def augment_indicators(df: DataFrame, key: str, digits: int | None = 4) -> DataFrame:
    """lag, rank, delta and pct_change of ``raw`` on a long (key, feature, period) table.

    One shuffle by (key, feature) serves all row-order columns; the rank goes through
    the value ladder because one feature may hold a large part of all rows.
    """
    w = over([key, "feature"], "period")

    def short(c: Column) -> Column:
        return c if digits is None else F.bround(c, digits)

    stepped = df.select(
        "*",
        short(F.lag("raw").over(w)).alias("lag"),
        short(difference("raw", w)).alias("delta"),
        finite(short(relative_change("raw", w))).alias("pct_change"),
    )
    return pct_rank_avg(stepped, ["feature", "period"], "raw", "rank", digits)


def augment(df: DataFrame, keys: list[str], order: str, value: str, functions: dict) -> DataFrame:
    """Extension point: each entry maps a column name to ``f(current, previous) -> Column``."""
    previous = F.lag(value).over(over(keys, order))
    return df.select("*", *[f(F.col(value), previous).alias(n) for n, f in functions.items()])


# Augmentations over the previous available period; the relative change divides by the current value.
AUGMENTATIONS = {
    "delta": lambda x, y: x - y,
    "lag": lambda x, y: y,
    "pct_change": lambda x, y: F.try_divide(x - y, x),
}


def clip_to_quantiles(df: DataFrame, keys: list[str], value: str, low: float, high: float, out: str) -> DataFrame:
    """Clip to two exact quantiles of the group."""
    q = quantiles(df, keys, value, {"_ql": low, "_qh": high})
    return attach(df, q, keys).withColumn(out, clip(value, F.col("_ql"), F.col("_qh"))).drop("_ql", "_qh")


def group_mean_fill(df: DataFrame, keys: list[str], cols: list[str], fallback: bool = True, prefix: str = "") -> DataFrame:
    """Null takes the mean of its group, then the overall mean.

    Means come from one partial aggregation and return by join: no window gathers a group.
    The overall mean is derived from the group sums, so the data is scanned once for both.
    """
    sums = df.groupBy(*keys).agg(
        *[F.sum(F.col(c).cast("double")).alias(f"_s_{c}") for c in cols],
        *[F.count(c).alias(f"_n_{c}") for c in cols],
    )
    means = sums.select(*keys, *[F.try_divide(F.col(f"_s_{c}"), F.col(f"_n_{c}")).alias(f"_m_{c}") for c in cols])
    out = attach(df, means, keys)
    if fallback:
        overall = sums.agg(*[F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_n_{c}")).alias(f"_g_{c}") for c in cols])
        out = attach(out, overall, [])
    options = lambda c: [F.col(c).cast("double"), F.col(f"_m_{c}")] + ([F.col(f"_g_{c}")] if fallback else [])
    filled = {f"{prefix}{c}": F.coalesce(*options(c)) for c in cols}
    extra = [f"_m_{c}" for c in cols] + ([f"_g_{c}" for c in cols] if fallback else [])
    return out.withColumns(filled).drop(*extra)


def overall_mean_fill(df: DataFrame, cols: list[str], zero: list[str] = ()) -> DataFrame:
    """Null takes the column mean; columns in ``zero`` take 0."""
    means = df.agg(*[F.avg(c).alias(f"_g_{c}") for c in cols])
    out = attach(df, means, [])
    return (
        out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_g_{c}")) for c in cols})
        .na.fill(0, list(zero))
        .drop(*[f"_g_{c}" for c in cols])
    )


def centre(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    means = df.groupBy(*keys).agg(F.avg(value).alias("_m"))
    return attach(df, means, keys).withColumn(out, F.col(value) - F.col("_m")).drop("_m")


def standardise(df: DataFrame, keys: list[str], value: str, out: str, cut_sigma: float | None = None) -> DataFrame:
    """(x - mean) / population deviation per group; rows beyond ``cut_sigma`` are removed."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))
    out_df = attach(df, stats, keys).withColumn(out, z).drop("_m", "_s")
    return out_df if cut_sigma is None else out_df.where(F.abs(out) <= cut_sigma)


def level_deltas(df: DataFrame, target: str) -> DataFrame:
    """Change since the previous period, the change before that, and the change of the percentile."""
    return df.withColumns(
        {
            f"delta_{target}": F.col(target) - F.col(f"previous_{target}"),
            f"delta_percentile_{target}": F.col(f"percentile_{target}") - F.col(f"previous_percentile_{target}"),
            f"previous_delta_percentile_{target}": F.lit(0.0),
            f"previous_delta_{target}": F.col(f"previous_{target}") - F.col(f"previousprevious_{target}"),
        }
    )


def keep_until_cumulative(df: DataFrame, score: str, key: str, limit: float) -> DataFrame:
    """Rows in descending score while the running sum stays under ``limit``.

    Ties are ordered by ``key``; the scores are first normalised to sum to one.
    Meant for a feature list, whose length is the number of columns.
    """
    w = Window.orderBy(F.col(score).desc(), key).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cumulative", F.sum(score).over(w)).where(F.col("cumulative") < limit)
