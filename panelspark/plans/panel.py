"""Training panel: cleaned events, indicators, assembly of all events in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import region_number, row_sum, safe_share
from ..operators.joins import latest_within, previous_event
from ..operators.ladder import pct_rank_many
from ..operators.quality import require
from ..operators.reshape import fill_grid, pivot_values, unpivot_years
from ..operators.schema import BLOCS, GROUPS, drop_all_null_rows, drop_constant_columns, keep_any_non_negative, zero_cascade
from ..operators.windows import augment_indicators, group_mean_fill, interpolate_linear, lags
from ..session import cut_lineage

VALUES = ["raw", "lag", "rank", "delta", "pct_change"]
# Lettered region codes and their number.
LETTER_REGIONS = {"2A": 20.0, "2B": 20.0}


def clean_events(df: DataFrame, groups: list[str] = GROUPS, exempt: Column | None = None, check: bool = False) -> DataFrame:
    """Drop empty rows, cascade zeros, recompute the valid total from the blocs, derive shares.

    ``exempt`` marks events whose totals are known not to add up; ``check`` verifies the rules.
    """
    votes = [f"vote_{b}" for b in BLOCS + groups]
    counts = ["participants", "valid", "size"]
    rows = drop_all_null_rows(df, counts + votes)
    rows = keep_any_non_negative(zero_cascade(rows, votes), votes + counts)
    rows = rows.withColumn("valid_", row_sum([f"vote_{b}" for b in BLOCS]).cast("double"))
    if check:
        free = F.lit(False) if exempt is None else exempt
        require(
            rows,
            {
                "size": F.col("size") >= 0,
                "participants": F.col("participants") >= 0,
                "size_covers_participants": free | (F.round("size") >= F.round("participants")),
                "blocs_add_up": free | (F.round("valid_") == F.round("valid")),
            },
        )
    absent, blank = F.col("size") - F.col("participants"), F.col("participants") - F.col("valid_")
    shares = {f"pvote_{b}": safe_share(f"vote_{b}", "valid_") for b in BLOCS + groups}
    shares |= {
        "pvote_par": safe_share("participants", "size"),
        "absent": absent,
        "blank": blank,
        "pvote_abs": safe_share(absent, F.col("size")),
        "pvote_blank": safe_share(blank, F.col("size")),
    }
    return rows.withColumns(shares)


def with_history(df: DataFrame, shares: list[str]) -> DataFrame:
    """Percentile of each share in its (kind, period), then the values one and two events back.

    All ranks share one ladder; the frame is written once, since the ladder reads it again.
    """
    out = pct_rank_many(cut_lineage(df), ["entity", "kind", "period"], ["kind", "period"], shares)
    percentiles = [f"percentile_{s}" for s in shares]
    out = lags(out, ["entity", "kind"], "period", shares + percentiles, {"previous_": 1})
    return lags(out, ["entity", "kind"], "period", shares, {"previousprevious_": 2})


def indicators(wide: dict[str, DataFrame], key: str, digits: int | None = 4) -> DataFrame:
    """Yearly wide tables to a long table on its full grid, gaps interpolated, augmented.

    All sources are united before the grid, so the sources share every later shuffle.
    """
    long = None
    for source, df in wide.items():
        part = unpivot_years(df, key, source)
        long = part if long is None else long.unionByName(part)
    filled = interpolate_linear(fill_grid(cut_lineage(long), key), [key, "feature"], "period", "raw")
    return augment_indicators(cut_lineage(filled), key, digits)


def features_wide(entity: DataFrame, region: DataFrame | None, features: list[str], region_features: list[str] = (), values: list[str] = VALUES, how: str = "inner") -> DataFrame:
    """One row per (entity, period) with ``{value}_{feature}`` columns, region features joined on (region, period)."""
    mine = pivot_values(entity, ["entity", "region", "period"], "feature", list(features), values)
    if region is None:
        return mine
    theirs = pivot_values(region, ["region", "period"], "feature", list(region_features), values)
    return mine.join(theirs, ["region", "period"], how)


def assemble(events: DataFrame, places: DataFrame, features: DataFrame, meta: list[str], threshold: float = 0.8, drop_constant: bool = False) -> DataFrame:
    """Events left-joined with places and features; sparse features dropped per event, gaps imputed, prefix and region number.

    All events are one plan: the null share is decided per event from one aggregation and a
    feature dropped for an event becomes null there, as the union of frames with different
    columns would give. A feature dropped for all events leaves the frame.
    """
    names = [c for c in features.columns if c not in ("entity", "region", "period")]
    rows = events.join(places.select("entity", "lat", "long"), "entity", "left")
    rows = rows.join(features.select("entity", "period", *[F.col(f"`{n}`").alias(f"F_{n}") for n in names]), ["entity", "period"], "left")
    rows = cut_lineage(rows)
    feats = [f"F_{n}" for n in names]
    shares = rows.groupBy("event").agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in feats]).collect()
    keep = {c: [s["event"] for s in shares if s[c] < threshold] for c in feats}
    alive = [c for c in feats if keep[c]]
    rows = rows.drop(*[c for c in feats if not keep[c]])
    plain = {c: f"_x{i}" for i, c in enumerate(alive)}
    filled = group_event_fill(rows.withColumnsRenamed(plain), [*plain.values(), "lat", "long"]).withColumnsRenamed({v: k for k, v in plain.items()})
    out = filled.withColumns({c: F.when(F.col("event").isin(keep[c]), F.col(f"`{c}`")) for c in alive if len(keep[c]) < len(shares)})
    if drop_constant:
        out = drop_constant_columns(out, alive)
        alive = [c for c in alive if c in out.columns]
    out = out.withColumn("region_no", region_number(F.col("entity").cast("string"), LETTER_REGIONS))
    return out.select(*meta, "lat", "long", "region_no", *[F.col(f"`{c}`") for c in alive])


def group_event_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null takes the mean of its (event, region), then the mean of its event."""
    near = group_mean_fill(df, ["event", "region"], cols, fallback=False)
    sums = df.groupBy("event").agg(*[F.avg(c).alias(f"_e_{c}") for c in cols])
    return near.join(sums, "event", "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_e_{c}")) for c in cols}).drop(*[f"_e_{c}" for c in cols])


def legacy_panel(long: DataFrame, targets: DataFrame, value: str, reach: int = 10) -> DataFrame:
    """Long-form panel with backfill: features of the event's year or the latest of the ``reach`` years before.

    The backfill works per feature, not per row: a feature absent in a year takes the latest
    year that has it for anybody. ``targets`` holds (entity, kind, period, target) rows; rows
    without target go, the targets of the previous events of the same kind come along.
    """
    have = long.where(F.col("raw").isNotNull()).select("feature", "period").distinct().withColumn("source", F.col("period"))
    wanted = targets.select("period").distinct().withColumn("_f", F.explode(have.agg(F.collect_set("feature").alias("f")).scalar()))
    chosen = latest_within(have, wanted.select(F.col("_f").alias("feature"), "period"), ["feature"], "period", "source", reach)
    used = chosen.where("source IS NOT NULL").select("feature", F.col("period").alias("_event"), F.col("source").alias("period"))
    values = long.join(used, ["feature", "period"]).select("entity", "feature", F.col("_event").alias("period"), F.col("period").alias("source"), "raw")
    rows = targets.where(F.col(value).isNotNull())
    order = previous_event(rows, "kind", "period")
    dated = rows.join(order, ["kind", "period"])
    for back in ("previous", "previousprevious"):
        old = rows.select("entity", "kind", F.col("period").alias(back), F.col(value).alias(f"{back}_{value}"))
        dated = dated.join(old, ["entity", "kind", back], "left")
    return dated.drop("previous", "previousprevious").join(values, ["entity", "period"])


