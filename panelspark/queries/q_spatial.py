"""Geography and spatial-statistics queries.

Coordinates come from the customer key on a grid of 181 x 241 points, so many customers
share a place, as in real data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import binning
from ..functions import scalars as S
from ..operators import fits, spatial, windows
from ..plans import correlation
from ..session import cut_lineage
from .base import BLOCS, PANEL_SQL, panel, r, table
from .registry import query

_LAT_SQL = "42 + ({k} * 7919 % 181) / 20.0"
_LONG_SQL = "-4 + ({k} * 104729 % 241) / 20.0"
PLACES_SQL = f"places AS (SELECT c_custkey AS entity, CAST(c_nationkey AS BIGINT) AS region, CAST({_LAT_SQL.format(k='c_custkey')} AS DOUBLE) AS lat, CAST({_LONG_SQL.format(k='c_custkey')} AS DOUBLE) AS long FROM customer)"


def hav_sql(a1, o1, a2, o2):
    return (
        f"2 * 6371.0088 * asin(sqrt(least(1, pow(sin((radians({a2}) - radians({a1})) / 2), 2) + cos(radians({a1})) * cos(radians({a2})) * pow(sin((radians({o2}) - radians({o1})) / 2), 2))))"
    )


def places(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("entity"),
        F.col("c_nationkey").cast("bigint").alias("region"),
        (F.lit(42.0) + (k * 7919 % 181) / 20.0).alias("lat"),
        (F.lit(-4.0) + (k * 104729 % 241) / 20.0).alias("long"),
    )


def spots(spark, sf):
    """One row per distinct place, named by its smallest entity, with the balance of its entities."""
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    balance = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), cents.alias("cents"))
    rows = places(spark, sf).join(balance, "entity")
    return rows.groupBy("lat", "long").agg(F.min("entity").alias("place"), (F.sum("cents").cast("double") / 100).alias("balance"))


SPOTS_SQL = f"{PLACES_SQL}, spots AS (SELECT lat, long, min(entity) AS place, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / 100 AS balance FROM places JOIN customer ON entity = c_custkey GROUP BY lat, long)"


@query(
    "g1_polygon_centroid",
    f"WITH {PLACES_SQL} SELECT entity, round((4 * lat - 0.25 * (lat + 0.5) + 1 * (lat + 10)) / 4.75, 8) AS lat, round((4 * long - 0.25 * (long + 0.25) + 1 * (long + 20)) / 4.75, 8) AS long FROM places",
)
def _(spark, sf):
    def square(cx, cy, half, turn):
        corners = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)][::turn]
        return F.array(*[F.array(cx + half * a, cy + half * b) for a, b in corners])

    x, y = F.col("long"), F.col("lat")
    with_hole = F.array(square(x, y, 1.0, 1), square(x + 0.25, y + 0.5, 0.25, 1))
    island = F.array(square(x + 20, y + 10, 0.5, -1))
    shaped = places(spark, sf).select("entity", F.array(with_hole, island).alias("polygons"), x, y)
    out = spatial.polygon_centroids(shaped.select("entity", "polygons"), "entity", "polygons")
    return out.select("entity", r("lat", 8).alias("lat"), r("long", 8).alias("long"))


@query(
    "g2_replicate_districts",
    f"WITH {PLACES_SQL}, t AS (SELECT CAST(region AS VARCHAR) AS code, avg(lat) AS lat, avg(long) AS long FROM places GROUP BY region) SELECT code, round(lat, 8) AS lat, round(long, 8) AS long FROM t UNION ALL SELECT CAST(unnest(range(7501, 7521)) AS VARCHAR), round(lat, 8), round(long, 8) FROM t WHERE code = '7' UNION ALL SELECT CAST(unnest(range(9301, 9310)) AS VARCHAR), round(lat, 8), round(long, 8) FROM t WHERE code = '9'",
)
def _(spark, sf):
    t = places(spark, sf).groupBy(F.col("region").cast("string").alias("code")).agg(r(F.avg("lat"), 8).alias("lat"), r(F.avg("long"), 8).alias("long"))
    return spatial.replicate_to_districts(t, "code", {"7": (7501, 7520), "9": (9301, 9309)})


@query("g3_haversine", f"WITH {PLACES_SQL} SELECT entity, round({hav_sql('lat', 'long', 48.8566, 2.3522)}, 6) AS distance_km FROM places")
def _(spark, sf):
    return places(spark, sf).select("entity", r(S.haversine_km("lat", "long", 48.8566, 2.3522)).alias("distance_km"))


_EDGES = [2.5 * i for i in range(1, 9)]


@query(
    "g4_pair_table",
    f"WITH {SPOTS_SQL}, p AS (SELECT a.place, b.place AS place_dest, {hav_sql('a.lat', 'a.long', 'b.lat', 'b.long')} AS d FROM spots a JOIN spots b ON a.place < b.place) "
    "SELECT CAST(ceil(d / 2.5) - 1 AS BIGINT) AS distance_bin, place, place_dest, round(d, 6) AS distance_km FROM p WHERE d <= 20",
)
def _(spark, sf):
    out = spatial.pair_table(spots(spark, sf), "place", _EDGES)
    return out.select(F.col("distance_bin").cast("bigint").alias("distance_bin"), "place", "place_dest", r("distance_km").alias("distance_km"))


@query(
    "j5_unordered_pairs",
    f"WITH {SPOTS_SQL}, p AS (SELECT a.place AS a, b.place AS b FROM spots a JOIN spots b ON a.place < b.place AND {hav_sql('a.lat', 'a.long', 'b.lat', 'b.long')} <= 40) SELECT place, CAST(count(*) AS BIGINT) AS neighbours FROM (SELECT a AS place FROM p UNION ALL SELECT b FROM p) GROUP BY place",
)
def _(spark, sf):
    pairs = spatial.pairs_within(spots(spark, sf).drop("balance"), "place", 40.0)
    ends = pairs.select(F.explode(F.array("place", "place_dest")).alias("place"))
    return ends.groupBy("place").agg(F.count(F.lit(1)).alias("neighbours"))


def event_rows(spark, sf):
    p = panel(spark, sf)
    return p.select(
        F.col("period").alias("event"), "entity", "region", "size",
        S.ratio("participants", "size").alias("turnout"), S.ratio("vote_g", "valid").alias("share_g"),
    )


_TAU_SQL = (
    "CASE WHEN p = 1 THEN (size - 0.5) / size WHEN p = 0 THEN 0.5 / size ELSE p END"
)
_FIELD_SQL = (
    f"WITH {PANEL_SQL}, {PLACES_SQL}, f AS (SELECT period AS event, panel.entity, size, participants / size AS p, lat, long FROM panel JOIN places USING (entity)), "
    f"g AS (SELECT *, {_TAU_SQL} AS p_alpha, ln(({_TAU_SQL}) / (1 - ({_TAU_SQL}))) AS tau FROM f)"
)


@query("f8_logit", f"{_FIELD_SQL} SELECT event, entity, round(p_alpha, 8) AS p_alpha, round(tau, 8) AS tau FROM g")
def _(spark, sf):
    e = event_rows(spark, sf)
    return e.select("event", "entity", r(S.half_ballot_share("turnout", "size"), 8).alias("p_alpha"), r(S.logit("turnout", "size"), 8).alias("tau"))


@query(
    "f9_logit_raw_edge",
    f"{_FIELD_SQL} SELECT event, entity, round(CASE WHEN p IN (0, 1) THEN p_alpha ELSE ln(p / (1 - p)) END, 8) AS tau FROM g",
)
def _(spark, sf):
    return event_rows(spark, sf).select("event", "entity", r(S.logit("turnout", "size", edge="raw"), 8).alias("tau"))


@query("f10_default_fill", f"WITH {PANEL_SQL} SELECT entity, period, round(coalesce(vote_g / nullif(valid, 0), 0.2), 8) AS share_g FROM panel")
def _(spark, sf):
    return panel(spark, sf).select("entity", "period", r(S.default_share(S.ratio("vote_g", "valid"), 5), 8).alias("share_g"))


@query(
    "g5_field_preparation",
    f"WITH {PANEL_SQL}, {PLACES_SQL}, seen AS (SELECT entity, lat, long FROM places WHERE region % 5 <> 0 OR lat > 45), f AS (SELECT period AS event, panel.entity, panel.region, size, coalesce(vote_g / nullif(valid, 0), 0.2) AS p, lat, long FROM panel LEFT JOIN seen USING (entity)), "
    f"m AS (SELECT region, avg(lat) AS la, avg(long) AS lo FROM f GROUP BY region) SELECT event, entity, size, round(p, 6) AS p, round({_TAU_SQL}, 6) AS p_alpha, round(ln(({_TAU_SQL}) / (1 - ({_TAU_SQL}))), 6) AS tau, round(coalesce(lat, la), 6) AS lat, round(coalesce(long, lo), 6) AS long FROM f JOIN m USING (region)",
)
def _(spark, sf):
    # places of some regions are known in part only, so that the region mean is needed
    known = places(spark, sf).where("region % 5 <> 0 OR lat > 45").drop("region")
    out = correlation.logit_field(event_rows(spark, sf), known, "share_g", 5, check=True)
    return out.select("event", "entity", "size", *[r(c).alias(c) for c in ("p", "p_alpha", "tau", "lat", "long")])


_CORR_EDGES = binning.distance_edges()


def _edge_sql(k: str) -> str:
    """Edge k of ``distance_edges``; edge 0 is 0."""
    return f"round(({k}) * 1000 / 300.0, 2)"


def _bin_sql(d: str) -> str:
    """How many of the 299 edges are below the distance: a guess by division, corrected by one at most."""
    g = f"least(CAST(floor({d} * 0.3) AS BIGINT), 299)"
    return f"({g} + CASE WHEN {g} < 299 AND {_edge_sql(g + ' + 1')} < {d} THEN 1 ELSE 0 END - CASE WHEN {g} > 0 AND {_edge_sql(g)} >= {d} THEN 1 ELSE 0 END)"


# bounds and middle of a bin; the last one is open
_BOUNDS_SQL = f"{_edge_sql('distance_bin')} AS distance_lower, CASE WHEN distance_bin < 299 THEN ({_edge_sql('distance_bin')} + {_edge_sql('distance_bin + 1')}) / 2 END AS mid"
_CORR_STEPS = (
    ", n AS (SELECT event, greatest(2, count(*) // 200) AS b FROM g GROUP BY event), "
    "s AS (SELECT event, size AS v, row_number() OVER (PARTITION BY event ORDER BY size) - 1 AS k, count(*) OVER (PARTITION BY event) AS c FROM g), "
    "i AS (SELECT event, unnest(range(1, b)) AS i, b FROM n), "
    "e AS (SELECT DISTINCT i.event, round_even(lo.v + (hi.v - lo.v) * ((lo.c - 1) * i / b - floor((lo.c - 1) * i / b)), 0) AS edge FROM i "
    "JOIN s lo ON lo.event = i.event AND lo.k = CAST(floor((lo.c - 1) * i / b) AS BIGINT) JOIN s hi ON hi.event = i.event AND hi.k = CAST(ceil((hi.c - 1) * i / b) AS BIGINT)), "
    "z AS (SELECT g.*, (SELECT count(*) FROM e WHERE e.event = g.event AND e.edge < g.size) AS size_bin FROM g), "
    "c AS (SELECT event, entity, lat, long, tau - avg(tau) OVER (PARTITION BY event, size_bin) AS x FROM z), "
    f"pl AS (SELECT DISTINCT lat, long, row_number() OVER (ORDER BY lat, long) AS pl FROM (SELECT DISTINCT lat, long FROM c)), "
    f"dist AS MATERIALIZED (SELECT pa, pb, {_bin_sql('d')} AS distance_bin FROM (SELECT a.pl AS pa, b.pl AS pb, {hav_sql('a.lat', 'a.long', 'b.lat', 'b.long')} AS d FROM pl a JOIN pl b ON a.pl <= b.pl)), "
    "cp AS MATERIALIZED (SELECT c.*, pl FROM c JOIN pl USING (lat, long)), "
    "q AS (SELECT a.event, distance_bin, a.x * b.x AS xx, a.lat = b.lat AND a.long = b.long AS here FROM cp a JOIN cp b ON a.event = b.event AND a.entity < b.entity JOIN dist ON pa = least(a.pl, b.pl) AND pb = greatest(a.pl, b.pl)), "
    "v AS (SELECT event, avg(x * x) AS v FROM c GROUP BY event), "
    "corr AS (SELECT q.event, distance_bin, CAST(count(*) AS DOUBLE) AS pairs, avg(xx) / any_value(v) AS c_tau FROM q JOIN v USING (event) GROUP BY q.event, distance_bin)"
)


_CORR_SQL = _FIELD_SQL + _CORR_STEPS
def correlation_rows(spark, sf):
    known = places(spark, sf).drop("region")
    return correlation.correlation_job(event_rows(spark, sf), known, "turnout", _CORR_EDGES, 0, 200)


@query("w9_centred_field", f"{_CORR_SQL} SELECT event, entity, round(x, 6) AS tau_minus_m FROM c")
def _(spark, sf):
    field = correlation.logit_field(event_rows(spark, sf), places(spark, sf).drop("region"), "turnout")
    return correlation.centred_field(field, 200).select("event", "entity", r("tau_minus_m").alias("tau_minus_m"))


def with_bounds(rows):
    """Lower bound and middle of each distance bin; null middle for the open one."""
    bounds = spatial.bin_bounds(rows.sparkSession, _CORR_EDGES)
    finite = F.when(F.col("mid") != float("inf"), F.col("mid"))
    return rows.join(bounds, "distance_bin").withColumns({"mid": finite, "distance_bin": F.col("distance_bin").cast("bigint"), "c_tau": r("c_tau")}).drop("distance_upper")


@query("g6_spatial_correlation", f"{_CORR_SQL} SELECT event, CAST(distance_bin AS BIGINT) AS distance_bin, {_BOUNDS_SQL}, pairs, round(c_tau, 6) AS c_tau FROM corr")
def _(spark, sf):
    return with_bounds(correlation_rows(spark, sf))


@query(
    "a18_pair_covariance",
    f"{_CORR_SQL} SELECT q.event, CAST(distance_bin AS BIGINT) AS distance_bin, CAST(count(*) AS BIGINT) AS pairs, round(avg(xx) / any_value(v), 6) AS c_tau FROM q JOIN v USING (event) WHERE NOT here AND distance_bin < 299 GROUP BY q.event, distance_bin",
)
def _(spark, sf):
    field = cut_lineage(correlation.centred_field(correlation.logit_field(event_rows(spark, sf), places(spark, sf).drop("region"), "turnout"), 200))
    # places are paired once; every entity of the one place meets every entity of the other by their sums
    named = places(spark, sf).select("entity", "lat", "long").join(spots(spark, sf).select("place", "lat", "long"), ["lat", "long"]).select("entity", "place")
    pairs = spatial.pair_table(spots(spark, sf), "place", _CORR_EDGES)
    out = spatial.pair_correlation(pairs.select("place", "place_dest", "distance_bin"), field, "event", "entity", "tau_minus_m", named)
    return out.select("event", F.col("distance_bin").cast("bigint").alias("distance_bin"), "pairs", r("c_tau").alias("c_tau"))


# twelve measures: shares of five blocs, four composites, turnout, abstention and unused ballots, with the blocs that set their defaults
_MEASURES = {"turnout": 0, "absent": 0, "unused": 0, **{f"share_{b}": 5 for b in BLOCS}, "share_gcg": 2, "share_dcd": 2, "share_tg": 3, "share_td": 3}
_PARTS = {"gcg": ("g", "cg"), "dcd": ("d", "cd"), "tg": ("g", "cg", "c"), "td": ("d", "cd", "c")}


def measure_rows(spark, sf):
    p = panel(spark, sf)
    of = lambda *blocs: sum((F.col(f"vote_{b}") for b in blocs[1:]), F.col(f"vote_{blocs[0]}"))
    shares = {"turnout": S.ratio("participants", "size"), "absent": 1 - S.ratio("participants", "size"), "unused": 1 - S.ratio("valid", "size")}
    shares |= {f"share_{b}": S.ratio(of(b), "valid") for b in BLOCS} | {f"share_{k}": S.ratio(of(*v), "valid") for k, v in _PARTS.items()}
    return p.select(F.col("period").alias("event"), "entity", "region", "size", *[c.alias(n) for n, c in shares.items()])


def _measure_sql(m: str, blocs: int) -> str:
    votes = " + ".join(f"vote_{b}" for b in _PARTS.get(m.removeprefix("share_"), (m.removeprefix("share_"),)))
    share = {"turnout": "participants / size", "absent": "1 - participants / size", "unused": "1 - valid / size"}.get(m, f"({votes}) / nullif(valid, 0)")
    return f"WHEN '{m}' THEN " + (f"coalesce({share}, {S.DEFAULT_SHARES[blocs]!r})" if blocs else share)


_MEASURES_SQL = (
    f"WITH {PANEL_SQL}, {PLACES_SQL}, f AS (SELECT m || '|' || period AS event, panel.entity, size, CASE m {' '.join(_measure_sql(m, k) for m, k in _MEASURES.items())} END AS p, lat, long "
    f"FROM panel JOIN places USING (entity), (SELECT unnest({list(_MEASURES)}) AS m)), g AS (SELECT *, {_TAU_SQL} AS p_alpha, ln(({_TAU_SQL}) / (1 - ({_TAU_SQL}))) AS tau FROM f)"
) + _CORR_STEPS


@query(
    "g6_correlation_of_measures",
    f"{_MEASURES_SQL} SELECT split_part(event, '|', 1) AS measure, split_part(event, '|', 2) AS event, CAST(distance_bin AS BIGINT) AS distance_bin, {_BOUNDS_SQL}, pairs, round(c_tau, 6) AS c_tau FROM corr",
)
def _(spark, sf):
    return with_bounds(correlation.correlation_of_measures(measure_rows(spark, sf), places(spark, sf).drop("region"), _MEASURES, _CORR_EDGES, 200))


@query(
    "g4_pairs_by_bin",
    f"WITH {SPOTS_SQL}, p AS (SELECT {hav_sql('a.lat', 'a.long', 'b.lat', 'b.long')} AS d FROM spots a JOIN spots b ON a.place < b.place) "
    f"SELECT CAST({_bin_sql('d')} AS BIGINT) AS distance_bin, CAST(count(*) AS BIGINT) AS pairs, round(min(d), 6) AS nearest, round(max(d), 6) AS farthest FROM p WHERE d <= {_CORR_EDGES[-1]} GROUP BY 1",
)
def _(spark, sf):
    """The pair table over all closed bins, told by its numbers."""
    out = spatial.pair_table(spots(spark, sf), "place", _CORR_EDGES)
    return out.groupBy(F.col("distance_bin").cast("bigint").alias("distance_bin")).agg(F.count(F.lit(1)).alias("pairs"), r(F.min("distance_km")).alias("nearest"), r(F.max("distance_km")).alias("farthest"))


@query(
    "g7_region_mean_coordinates",
    f"WITH {PLACES_SQL}, k AS (SELECT entity, region, CASE WHEN lat > 45 THEN lat END AS lat, CASE WHEN lat > 45 THEN long END AS long FROM places) SELECT entity, round(coalesce(lat, avg(lat) OVER (PARTITION BY region)), 6) AS lat, round(coalesce(long, avg(long) OVER (PARTITION BY region)), 6) AS long FROM k",
)
def _(spark, sf):
    known = F.col("lat") > 45
    k = places(spark, sf).select("entity", "region", F.when(known, F.col("lat")).alias("lat"), F.when(known, F.col("long")).alias("long"))
    out = windows.group_mean_fill(k, ["region"], ["lat", "long"], fallback=False)
    return out.select("entity", r("lat").alias("lat"), r("long").alias("long"))


@query(
    "g7_region_first_coordinates",
    f"WITH {PLACES_SQL}, k AS (SELECT entity, region, CASE WHEN lat > 45 THEN lat END AS lat, CASE WHEN lat > 45 THEN long END AS long FROM places), f AS (SELECT region, arg_min(lat, entity) AS la, arg_min(long, entity) AS lo FROM k WHERE lat IS NOT NULL GROUP BY region) SELECT entity, coalesce(lat, la) AS lat, coalesce(long, lo) AS long FROM k LEFT JOIN f USING (region)",
)
def _(spark, sf):
    known = F.col("lat") > 45
    k = places(spark, sf).select("entity", "region", F.when(known, F.col("lat")).alias("lat"), F.when(known, F.col("long")).alias("long"))
    return spatial.region_first_fill(k, "region", "entity", ["lat", "long"]).select("entity", "lat", "long")


@query(
    "g8_local_moran",
    f"WITH {SPOTS_SQL}, y AS (SELECT place, lat, long, balance - avg(balance) OVER () AS y FROM spots), p AS (SELECT a.place, b.y / ({hav_sql('a.lat', 'a.long', 'b.lat', 'b.long')}) AS wy FROM y a JOIN y b ON a.place <> b.place WHERE {hav_sql('a.lat', 'a.long', 'b.lat', 'b.long')} <= 30), "
    "s AS (SELECT place, sum(wy) AS wy FROM p GROUP BY place) SELECT place, round(y * coalesce(wy, 0) / (SELECT avg(y * y) FROM y), 6) AS moran FROM y LEFT JOIN s USING (place)",
)
def _(spark, sf):
    return spatial.local_moran(spots(spark, sf), "place", "balance", 30.0).withColumn("moran", r("moran"))


@query(
    "g9_logarithmic_law",
    f"{_CORR_SQL}, m AS (SELECT event, {_BOUNDS_SQL}, c_tau FROM corr WHERE distance_bin < 299), fit AS (SELECT event, regr_slope(c_tau, ln(mid)) AS slope, regr_intercept(c_tau, ln(mid)) AS intercept, regr_r2(c_tau, ln(mid)) AS r2 FROM m WHERE mid BETWEEN 20 AND 180 GROUP BY event) "
    "SELECT event, round(CASE WHEN slope < 0 THEN sqrt(-slope) END, 6) AS lambda, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2 FROM fit",
)
def _(spark, sf):
    c = correlation_rows(spark, sf).join(spatial.bin_bounds(spark, _CORR_EDGES), "distance_bin").where("distance_bin < 299")
    out = fits.log_law(c, ["event"], "mid", "c_tau", 20.0, 180.0)
    return out.select("event", *[r(x).alias(x) for x in ("lambda", "slope", "intercept", "r2")])


