"""Statistics inside bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ladder import ladder_edges, mark_edges, number_by_marks, placed_bounds, quantiles, value_ladder


def size_bins(df: DataFrame, keys: list[str], size: str, per_bin: int, out: str = "size_bin") -> tuple[DataFrame, DataFrame]:
    """Equal-count bins of about ``per_bin`` rows (two at least) per group.

    Returns the rows with their right-closed bin number, and the bounds of every bin. The rows are
    counted once; numbers and bounds come from the distinct sizes and the edges.
    """
    sizes = value_ladder(df, keys, size)
    edges = ladder_edges(sizes, keys, size, F.greatest(F.lit(2), F.floor(F.col("total") / F.lit(per_bin))), digits=0)
    marked = mark_edges(sizes, keys, size, edges)
    bounds = placed_bounds(marked.where("n > 0").withColumnRenamed("_v", "edge"), keys, out)
    return number_by_marks(df, keys, size, marked, out, "right"), bounds


def percentile_bins(df: DataFrame, keys: list[str], value: str, bins: int, out: str = "bin") -> DataFrame:
    """Left-closed bins between the group's inner percentiles; the largest value falls in the last bin."""
    values = value_ladder(df, keys, value)
    marked = mark_edges(values, keys, value, ladder_edges(values, keys, value, bins, digits=None))
    return number_by_marks(df, keys, value, marked, out, "left")


def binned_stats(df: DataFrame, keys: list[str], value: str, size: str) -> DataFrame:
    """Rows, mean and sample deviation of the value and mean size per bin."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.avg(size).alias("centre")
    )


def binned_stats_2d(df: DataFrame, keys: list[str], bin_a: str, bin_b: str, value: str, criterion: str) -> DataFrame:
    """Mean and deviation per (bin, bin) cell and the exact median criterion per second bin."""
    cells = df.groupBy(*keys, bin_a, bin_b).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return cells.join(quantiles(df, [*keys, bin_b], criterion, {"median_criterion": 0.5}), [*keys, bin_b])


def fill_bins(df: DataFrame, keys: list[str], bin_col: str, bins: int, zero: list[str]) -> DataFrame:
    """Every bin number 0..bins-1 for every key; absent bins hold zero."""
    grid = df.select(*keys).distinct().withColumn(bin_col, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(df, [*keys, bin_col], "left").na.fill(0, zero)


def scatter_profile(df: DataFrame, criterion: str, value: str, bins: int, trim: bool = True) -> DataFrame:
    """Median criterion and mean value in quantile bins of the criterion; outer bins can be left out."""
    numbered = percentile_bins(df, [], criterion, bins, "bin")
    means = numbered.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    out = means.join(quantiles(numbered, ["bin"], criterion, {"median_criterion": 0.5}), "bin")
    return out.where((F.col("bin") > 0) & (F.col("bin") < bins - 1)) if trim else out


def equal_width(df: DataFrame, value: str, bins: int, out: str = "bin") -> DataFrame:
    """Bins of equal width between minimum and maximum; the maximum falls in the last bin."""
    ends = df.agg(F.min(value).alias("a"), F.max(value).alias("b")).first()
    low, high = float(ends["a"]), float(ends["b"])
    number = F.least(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)) - 1
    return df.withColumn(out, number.cast("int"))


def log_spaced(df: DataFrame, value: str, bins: int, out: str = "bin") -> DataFrame:
    """Bins evenly spaced in the logarithm between the smallest and largest positive value."""
    pos = F.when(F.col(value) > 0, F.ln(F.col(value).cast("double")))
    ends = df.agg(F.min(pos).alias("a"), F.max(pos).alias("b")).first()
    step = (ends["b"] - ends["a"]) / bins
    number = F.least(F.floor((pos - F.lit(ends["a"])) / F.lit(step)), F.lit(bins - 1))
    return df.withColumn(out, number.cast("int"))


def correlation_by_bin(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"))


def group_ratio(df: DataFrame, keys: list[str], bin_col: str, low: int, high: int, value: str) -> DataFrame:
    """Value of one bin over that of another, per key."""
    pick = lambda b: F.max(F.when(F.col(bin_col) == b, F.col(value)))
    return df.groupBy(*keys).agg(F.try_divide(pick(low), pick(high)).alias("ratio")).where(F.col("ratio").isNotNull())


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    return equal_width(df.where(F.col(value).isNotNull()), value, bins).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, *cols: str | Column) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
