"""Grouped aggregations: winners, moments, stability, outliers, importances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio, row_argmax
from .joins import same_key_pairs
from .ladder import attach, quantiles


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the smallest under a total order; combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def sorted_list(df: DataFrame, keys: list[str], value: str | Column, out: str) -> DataFrame:
    """Distinct values (or structs) per key, sorted; the value domain bounds the list."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias(out))


def totals_and_shares(df: DataFrame, size: str, participants: str, votes: dict[str, str]) -> DataFrame:
    """National totals: participation, its share of the size, votes per bloc and their share."""
    sums = df.agg(F.sum(size).alias("_size"), F.sum(participants).alias("tot_par"), *[F.sum(c).alias(f"tot_vote_{b}") for b, c in votes.items()])
    return sums.select(
        "tot_par",
        ratio("tot_par", "_size").alias("tot_ppar"),
        *[F.col(f"tot_vote_{b}") for b in votes],
        *[ratio(f"tot_vote_{b}", "tot_par").alias(f"tot_pvote_{b}") for b in votes],
    )


def winner(df: DataFrame, votes: list[str], names: list[str]) -> DataFrame:
    """Name with the largest total; the first listed name wins a tie."""
    return df.agg(*[F.sum(v).alias(v) for v in votes]).select(row_argmax(votes, names).alias("winner"))


def seats(df: DataFrame, district: str, votes: list[str], names: list[str]) -> DataFrame:
    """Districts won per name."""
    per = df.groupBy(district).agg(*[F.sum(v).alias(v) for v in votes])
    return per.select(row_argmax(votes, names).alias("winner")).groupBy("winner").agg(F.count(F.lit(1)).alias("seats"))


def assembly_winner(df: DataFrame, district: str, votes: list[str], names: list[str]) -> DataFrame:
    """Name with most districts; ties go to the first listed name."""
    place = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, -i)])
    return seats(df, district, votes, names).agg(F.max_by("winner", F.struct(F.col("seats"), place[F.col("winner")])).alias("winner"))


def agreement(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Share of rows on which two labels agree, and the most frequent label of each (smallest name on a tie)."""
    base = df.agg(F.avg((F.col(predicted) == F.col(actual)).cast("double")).alias("agreement"))
    for c, out in ((predicted, "predicted_mode"), (actual, "actual_mode")):
        counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("n").agg(F.min(c).alias("c")).agg(F.max_by("c", "n").alias(out))
        base = base.withColumn(out, best.scalar())
    return base


def moments(df: DataFrame, keys: list[str], value: str, num: str, den: str) -> DataFrame:
    """Sample deviation, population skewness, excess kurtosis and the weighted mean Σnum/Σden."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.skewness(value).alias("skew"),
        F.kurtosis(value).alias("excess_kurtosis"),
        F.try_divide(F.sum(num).cast("double"), F.sum(den).cast("double")).alias("weighted_mean"),
    )


def stability_matrix(df: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """How far values of one period lie from those of another, for all period pairs.

    Each entity gives every unordered pair once; the mirrored half and the relative error
    (by the mean of the first period) come from the aggregated rows. The median runs
    through the ladder, so no period pair gathers in one task.
    """
    pairs = same_key_pairs(df.where(F.col(value).isNotNull()), keys, period, value).select(
        F.col("a.t").alias("year1"),
        F.col("b.t").alias("year2"),
        F.col("a.v").alias("v1"),
        F.col("b.v").alias("v2"),
        F.abs(F.col("b.v") - F.col("a.v")).alias("gap"),
    )
    sums = pairs.groupBy("year1", "year2").agg(
        F.avg("gap").alias("mae"), F.avg(F.col("gap") * F.col("gap")).alias("mse"), F.avg("v1").alias("m1"), F.avg("v2").alias("m2")
    )
    half = sums.join(quantiles(pairs, ["year1", "year2"], "gap", {"mad": 0.5}), ["year1", "year2"])
    turn = F.struct(F.col("year2").alias("year1"), F.col("year1").alias("year2"), F.col("m2").alias("base"))
    keep = F.struct(F.col("year1"), F.col("year2"), F.col("m1").alias("base"))
    both = half.withColumn("_p", F.explode(F.array(keep, turn)))
    return both.select(
        F.col("_p.year1").alias("year1"),
        F.col("_p.year2").alias("year2"),
        "mae",
        ratio(F.col("mae"), F.col("_p.base")).alias("mape"),
        "mad",
        "mse",
        F.sqrt("mse").alias("rmse"),
    )


def iqr_filter(df: DataFrame, cols: list[str], keys: list[str] = (), factor: float = 1.5) -> DataFrame:
    """Keep rows inside Q1-1.5·IQR .. Q3+1.5·IQR, one column after another."""
    keys = list(keys)
    out = df
    for c in cols:
        q = quantiles(out, keys, c, {"_q1": 0.25, "_q3": 0.75})
        low = F.col("_q1") - factor * (F.col("_q3") - F.col("_q1"))
        high = F.col("_q3") + factor * (F.col("_q3") - F.col("_q1"))
        out = attach(out, q, keys).where(F.col(c).between(low, high)).drop("_q1", "_q3")
    return out


def importance_percent(df: DataFrame, feature: str, score: str, models: int) -> DataFrame:
    """Importance averaged over models (absent counts as zero) and its share of the total in percent."""
    mean = df.groupBy(feature).agg((F.sum(score) / F.lit(float(models))).alias("importance"))
    total = mean.agg(F.sum("importance").alias("_t"))
    return attach(mean, total, []).select(feature, "importance", (F.try_divide(F.col("importance"), F.col("_t")) * 100).alias("percent"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, f1 and support per class from the confusion counts."""
    counts = confusion(df, label, predicted)
    hits = counts.where(F.col(label) == F.col(predicted)).select(F.col(label).alias("class"), F.col("n").alias("hit"))
    actual = counts.groupBy(F.col(label).alias("class")).agg(F.sum("n").alias("support"))
    given = counts.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("predicted"))
    joined = actual.join(given, "class", "full_outer").join(hits, "class", "left").na.fill(0)
    p, rcl = F.coalesce(ratio("hit", "predicted"), F.lit(0.0)), F.coalesce(ratio("hit", "support"), F.lit(0.0))
    return joined.select(
        "class", p.alias("precision"), rcl.alias("recall"), F.coalesce(F.try_divide(2 * p * rcl, p + rcl), F.lit(0.0)).alias("f1"), "support"
    )
