"""Forecast assembly: normalised shares, counts, error tables, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .joins import assert_unique
from .ladder import attach
from .quality import require
from .reshape import stack_measures

TURNOUT = "par"


def add_previous(df: DataFrame, trends: list[str], prefix: str = "pvote_") -> DataFrame:
    """Predicted changes become levels: plus the previous share, or its mean where that is missing."""
    means = df.agg(*[F.avg(f"previous_{prefix}{t}").alias(f"_m_{t}") for t in trends])
    out = attach(df, means, [])
    return out.withColumns(
        {f"{prefix}{t}": F.col(f"{prefix}{t}") + F.coalesce(F.col(f"previous_{prefix}{t}"), F.col(f"_m_{t}")) for t in trends}
    ).drop(*[f"_m_{t}" for t in trends])


def normalise_shares(df: DataFrame, blocs: list[str], prefix: str = "pvote_") -> DataFrame:
    """Add (1 - Σ)/n to every bloc share; turnout is untouched."""
    total = sum((F.col(f"{prefix}{b}") for b in blocs), F.lit(0.0))
    shifted = df.withColumn("_shift", (F.lit(1.0) - total) / len(blocs))
    return shifted.withColumns({f"{prefix}{b}": F.col(f"{prefix}{b}") + F.col("_shift") for b in blocs}).drop("_shift")


def shares_to_counts(df: DataFrame, blocs: list[str], size: str = "size") -> DataFrame:
    """Participants are p·size cut down to whole, votes are share·participants rounded half-even."""
    counted = df.withColumn("participants", (F.col(f"pvote_{TURNOUT}") * F.col(size)).cast("long"))
    return counted.withColumns({f"vote_{b}": F.bround(F.col(f"pvote_{b}") * F.col("participants"), 0).cast("long") for b in blocs})


def check_forecast(df: DataFrame, blocs: list[str]) -> DataFrame:
    """Mean |Σ shares - 1| under 0.001 and mean |Σ votes - participants| under 0.5, or an error."""
    shares = sum((F.col(f"pvote_{b}") for b in blocs), F.lit(0.0))
    votes = sum((F.col(f"vote_{b}") for b in blocs), F.lit(0))
    means = df.agg(F.avg(F.abs(shares - 1)).alias("s"), F.avg(F.abs(votes - F.col("participants"))).alias("v"))
    require(means, {"shares": F.col("s") < 0.001, "votes": F.col("v") < 0.5})
    return df


def clean_truth(df: DataFrame, key: str, size: str, valid: str, blocs: list[str]) -> DataFrame:
    """Key, size, counts and shares with rows holding a null left out; counts as whole numbers."""
    counts = [size, "participants", valid, *[f"vote_{b}" for b in blocs]]
    shares = [f"pvote_{TURNOUT}", *[f"pvote_{b}" for b in blocs]]
    return df.select(F.col(key).cast("string").alias(key), *counts, *shares).na.drop("any").withColumns({c: F.col(c).cast("long") for c in counts})


def error_table(pred: DataFrame, truth: DataFrame, key: str, cols: list[str], check: bool = True) -> DataFrame:
    """Predicted, true and absolute difference per row of a 1:1 join.

    Columns missing on one side are left out of the comparison, others keep their name.
    """
    if check:
        assert_unique(pred, [key], "predictions")
        assert_unique(truth, [key], "truth")
    shared = [c for c in cols if c in pred.columns and c in truth.columns]
    p = pred.select(key, *[F.col(c).alias(f"{c}_pred") for c in shared])
    extra = [c for c in truth.columns if c not in shared and c != key]
    t = truth.select(key, *extra, *[F.col(c).alias(f"{c}_true") for c in shared])
    return p.join(t, key).withColumns({f"{c}_diff": F.abs(F.col(f"{c}_pred") - F.col(f"{c}_true")) for c in shared})


def mean_error(errors: DataFrame, shares: list[str]) -> DataFrame:
    """Mean over the shares of their mean absolute difference."""
    means = errors.agg(*[F.avg(f"{s}_diff").alias(s) for s in shares])
    return means.select((sum((F.col(s) for s in shares), F.lit(0.0)) / len(shares)).alias("mean_error"))


def synthetic_report(errors: DataFrame, blocs: list[str], size: str = "size", valid: str = "valid") -> DataFrame:
    """One row per measure: true and predicted total, mean and sample deviation of the row errors, difference of totals.

    Shares are percentages: predicted votes over predicted participants, true votes over the
    sum of true bloc votes. One aggregation over the error table, then a narrow explode.
    """
    part = "participants"
    sums = [F.sum(size).alias("size"), F.sum(valid).alias("valid"), F.sum(f"{part}_true").alias("part_true"), F.sum(f"{part}_pred").alias("part_pred")]
    spread = []
    for c in [part, f"pvote_{TURNOUT}", *[f"vote_{b}" for b in blocs], *[f"pvote_{b}" for b in blocs]]:
        spread += [F.avg(f"{c}_diff").alias(f"m|{c}"), F.stddev_samp(f"{c}_diff").alias(f"s|{c}")]
    votes = [F.sum(f"vote_{b}_{side}").alias(f"{b}|{side}") for b in blocs for side in ("true", "pred")]
    gap = F.abs(F.col(valid) - F.col(f"{part}_pred"))
    one = errors.agg(*sums, *spread, *votes, F.avg(gap).alias("m|valid"), F.stddev_samp(gap).alias("s|valid"))
    c = lambda n: F.col(f"`{n}`")
    all_true = sum((c(f"{b}|true") for b in blocs), F.lit(0))
    percent = lambda n, d: F.round(ratio(n, d) * 100, 2)

    def row(true: Column, pred: Column, diff: Column, std: Column) -> dict[str, Column]:
        return {"true": true, "pred": pred, "diff": diff, "std": std, "diff_agg": true - pred}

    zero = F.lit(0.0)
    turnout = f"pvote_{TURNOUT}"
    rows = {
        "size": row(c("size"), c("size"), zero, zero),
        part: row(c("part_true"), c("part_pred"), c(f"m|{part}"), c(f"s|{part}")),
        "valid": row(c("valid"), c("part_pred"), c("m|valid"), c("s|valid")),
        "valid_": row(all_true, c("part_pred"), c("m|valid"), c("s|valid")),
        turnout: row(percent(c("part_true"), c("size")), percent(c("part_pred"), c("size")), c(f"m|{turnout}") * 100, c(f"s|{turnout}") * 100),
        "pvote_valid": row(percent(c("valid"), c("size")), percent(c("part_pred"), c("size")), c(f"m|{turnout}") * 100, c(f"s|{turnout}") * 100),
    }
    for b in blocs:
        rows[f"vote_{b}"] = row(c(f"{b}|true"), c(f"{b}|pred"), c(f"m|vote_{b}"), c(f"s|vote_{b}"))
        rows[f"pvote_{b}"] = row(
            percent(c(f"{b}|true"), all_true), percent(c(f"{b}|pred"), c("part_pred")), c(f"m|pvote_{b}") * 100, c(f"s|pvote_{b}") * 100
        )
    return stack_measures(one, rows)


def add_poll_column(report: DataFrame, polls: DataFrame, blocs: list[str]) -> DataFrame:
    """Mean poll value per bloc joined on the share measure."""
    means = polls.agg(*[F.avg(b).alias(b) for b in blocs])
    rows = stack_measures(means, {f"pvote_{b}": {"poll": F.col(b)} for b in blocs})
    return report.join(rows, "measure", "left")


def error_summary(report: DataFrame, blocs: list[str]) -> DataFrame:
    """Mean and population deviation of the share errors over blocs."""
    shares = report.where(F.col("measure").isin([f"pvote_{b}" for b in blocs]))
    return shares.agg(F.avg("diff").alias("mean_error"), F.stddev_pop("diff").alias("std_error"))


def time_series(frames: DataFrame, period: str, measure: str, measures: list[str]) -> DataFrame:
    """True and predicted values of the measures as columns over the periods."""
    picked = frames.where(F.col(measure).isin(measures))
    cells = [F.max(F.when(F.col(measure) == m, F.col(s))).alias(f"{m}_{s}") for m in measures for s in ("true", "pred")]
    return picked.groupBy(period).agg(*cells).orderBy(period)
