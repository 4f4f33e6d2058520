"""Forward projection of yearly series with higher-order folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inventory(long: DataFrame, feature: str = "feature", period: str = "period") -> DataFrame:
    """Years, last year and whole-number frequency (mean of the last four gaps, null under five years)."""
    years = long.groupBy(feature).agg(F.array_sort(F.collect_set(period)).alias("years"))
    n = F.size("years")
    span = F.element_at("years", -1) - F.element_at("years", -5)
    return years.select(feature, "years", F.element_at("years", -1).alias("last_year"), F.when(n >= 5, F.floor(F.when(n >= 5, span) / 4)).alias("frequency"))


def _last_values(long: DataFrame, keys: list[str], period: str, value: str, reference: int, p: int) -> DataFrame:
    years = range(reference - p + 1, reference + 1)
    cells = [F.max(F.when(F.col(period) == y, F.col(value).cast("double"))) for y in years]
    return long.where(F.col(period).between(years[0], years[-1])).groupBy(*keys).agg(F.array(*cells).alias("_x"))


def _next_growth(x: Column, p: int) -> Column:
    tail = F.slice(x, -p, p)
    rates = F.transform(F.sequence(F.lit(1), F.lit(p - 1)), lambda i: F.try_divide(F.get(tail, i), F.get(tail, i - 1)) - 1)
    known = F.filter(rates, lambda g: g.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, b: a + b), F.size(known).cast("double"))
    return F.element_at(x, -1) * (1 + mean)


def _next_smooth(x: Column, p: int, alpha: float) -> Column:
    weighted = [F.lit(alpha**m) * F.element_at(x, -m) for m in range(1, p + 1)]
    total = weighted[0]
    for w in weighted[1:]:
        total = total + w
    return F.lit(alpha) * F.element_at(x, -1) + F.lit(1 - alpha) * total


def project(long: DataFrame, keys: list[str], period: str, value: str, reference: int, end: int, method: str = "growth", p: int = 5, alpha: float = 0.5) -> DataFrame:
    """Values of reference+1..end per key.

    ``growth`` repeats the mean relative change of the last p values; ``smoothing`` takes
    α·x₋₁ + (1-α)·Σ α^m·x₋m. Each step feeds the next one inside a fold over the p last
    values, so there is one shuffle and no lineage per projected year.
    """
    base = _last_values(long, keys, period, value, reference, p)
    nxt = (lambda x: _next_growth(x, p)) if method == "growth" else (lambda x: _next_smooth(x, p, alpha))
    grown = F.aggregate(F.sequence(F.lit(reference + 1), F.lit(end)), F.col("_x"), lambda x, _: F.concat(x, F.array(nxt(x))))
    cells = base.select(*keys, F.posexplode(F.slice(grown, p + 1, end - reference)).alias("_i", value))
    return cells.select(*keys, (F.col("_i") + (reference + 1)).cast("bigint").alias(period), value)


def extend_eligible(long: DataFrame, keys: list[str], reference: int, end: int, method: str = "growth", p: int = 5, alpha: float = 0.5) -> DataFrame:
    """Projected rows for features with yearly data up to the reference year, appended to the table."""
    fit = inventory(long).where((F.col("last_year") == reference) & (F.col("frequency") == 1)).select("feature")
    ready = long.join(fit, "feature", "left_semi")
    new = project(ready, [*keys, "feature"], "period", "raw", reference, end, method, p, alpha)
    return long.unionByName(new.select(*long.columns))


def placeholder_targets(df: DataFrame, periods: list[int], targets: list[str]) -> DataFrame:
    """Future rows for every key of the last period with targets set to zero."""
    last = df.agg(F.max("period")).first()[0]
    future = df.where(F.col("period") == last).withColumn("period", F.explode(F.array(*[F.lit(y).cast("bigint") for y in periods])))
    return df.unionByName(future.withColumns({t: F.lit(0.0) for t in targets}))
