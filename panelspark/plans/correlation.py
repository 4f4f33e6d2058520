"""Spatial correlation job: field, size bins, centring, correlation function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import default_share, half_ballot_share, logit
from ..operators.bins import size_bins
from ..operators.joins import assert_unique
from ..operators.quality import require
from ..operators.spatial import spatial_correlation
from ..operators.windows import centre, group_mean_fill
from ..session import cut_lineage


def logit_field(events: DataFrame, places: DataFrame, share: str, blocs: int = 0, check: bool = False) -> DataFrame:
    """Default for missing shares, empty sizes out, logit, coordinates, region mean for absent ones.

    ``events`` needs (event, entity, region, size, share); ``places`` (entity, lat, long), one
    row per entity. ``check=True`` verifies both contracts with one extra pass.
    """
    if check:
        assert_unique(places, ["entity"], "places")
    p = events.where("size > 0").withColumn("p", default_share(share, blocs))
    placed = p.join(places.select("entity", "lat", "long"), "entity", "left")
    out = group_mean_fill(placed, ["region"], ["lat", "long"], fallback=False).select(
        "event", "entity", "size", "p", half_ballot_share("p", "size").alias("p_alpha"), logit("p", "size").alias("tau"), "lat", "long"
    )
    if check:
        require(out, {"tau": F.col("tau").isNotNull() & ~F.isnan("tau"), "p_alpha": F.col("p_alpha").between(0, 1)})
    return out


def centred_field(field: DataFrame, per_bin: int = 1000, stored: bool = False) -> DataFrame:
    """tau minus the mean of its (event, size bin).

    The field feeds the edges, the bin search and the rows, so it is written once, unless it is ``stored`` already.
    """
    field = field if stored else cut_lineage(field)
    binned, _ = size_bins(field, ["event"], "size", per_bin)
    return centre(binned, ["event", "size_bin"], "tau", "tau_minus_m")


def correlation_job(events: DataFrame, places: DataFrame, share: str, edges: list[float], blocs: int = 0, per_bin: int = 1000) -> DataFrame:
    """Correlation by distance of one share; the places and the stored field are held to their contracts."""
    assert_unique(places, ["entity"], "places")
    field = cut_lineage(logit_field(events, places, share, blocs))
    require(field, {"tau": F.col("tau").isNotNull() & ~F.isnan("tau"), "p_alpha": F.col("p_alpha").between(0, 1)})
    centred = cut_lineage(centred_field(field, per_bin, stored=True).select("event", "lat", "long", "tau_minus_m"))
    return spatial_correlation(centred, "event", "tau_minus_m", edges)


def correlation_of_measures(events: DataFrame, places: DataFrame, shares: dict[str, int], edges: list[float], per_bin: int = 1000) -> DataFrame:
    """Several measures in one plan: (measure, event) is the group instead of a loop over measures.

    ``shares`` gives, per share column, the number of blocs that sets its default.
    """
    cells = [F.struct(F.lit(m).alias("measure"), default_share(m, k).alias("share")) for m, k in shares.items()]
    long = events.withColumn("_m", F.explode(F.array(*cells))).select(
        "entity", "region", "size", F.concat_ws("|", "_m.measure", F.col("event").cast("string")).alias("event"), "_m.share"
    )
    out = correlation_job(long, places, "share", edges, 0, per_bin)
    return out.select(
        F.split_part("event", F.lit("|"), F.lit(1)).alias("measure"),
        F.split_part("event", F.lit("|"), F.lit(2)).alias("event"),
        "distance_bin",
        "pairs",
        "c_tau",
    )
