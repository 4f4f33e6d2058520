"""Geography: centroids, pairs within a radius, correlation functions, local autocorrelation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import even_cut
from ..functions.scalars import ratio
from ..session import cut_lineage
from .ladder import attach

EARTH_KM = 6371.0088
#: Events whose sums stand side by side in one row of a folded field.
EVENTS_AT_ONCE = 8


# ---- polygons ----


def ring_moments(ring: Column) -> Column:
    """Unsigned area and centroid sums of one ring of [x, y] points (shoelace)."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(acc: Column, i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, i + 1)
        x0, y0, x1, y1 = F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(q, F.lit(0)), F.get(q, F.lit(1))
        c = x0 * y1 - x1 * y0
        return F.struct((acc["a"] + c).alias("a"), (acc["x"] + (x0 + x1) * c).alias("x"), (acc["y"] + (y0 + y1) * c).alias("y"))

    def finish(acc: Column) -> Column:
        sign = F.signum(acc["a"])
        return F.struct((acc["a"] * sign / 2).alias("a"), (acc["x"] * sign / 6).alias("x"), (acc["y"] * sign / 6).alias("y"))

    return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), zero, step, finish)


def polygon_centroids(df: DataFrame, key: str, polygons: str) -> DataFrame:
    """Area-weighted centroid (lat = y, long = x) of a multi-polygon; later rings of a polygon are holes.

    ``polygons`` is array<polygon>, a polygon is array<ring>, a ring is array<[x, y]>.
    """
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc: Column, m: Column) -> Column:
        return F.struct((acc["a"] + m["a"]).alias("a"), (acc["x"] + m["x"]).alias("x"), (acc["y"] + m["y"]).alias("y"))

    def signed(ring: Column, i: Column) -> Column:
        s = F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
        m = ring_moments(ring)
        return F.struct((m["a"] * s).alias("a"), (m["x"] * s).alias("x"), (m["y"] * s).alias("y"))

    total = F.aggregate(F.flatten(F.transform(polygons, lambda p: F.transform(p, signed))), zero, add)
    return df.withColumn("_t", total).select(
        *[c for c in df.columns if c != polygons], ratio(F.col("_t.y"), F.col("_t.a")).alias("lat"), ratio(F.col("_t.x"), F.col("_t.a")).alias("long")
    )


def replicate_to_districts(df: DataFrame, key: str, parents: dict[str, tuple[int, int]]) -> DataFrame:
    """Add one row per district of a city with the city's coordinates."""
    ranges = F.create_map(*[x for p, (a, b) in parents.items() for x in (F.lit(p), F.sequence(F.lit(a), F.lit(b)))])
    copies = df.where(F.col(key).isin(list(parents))).withColumn("_d", F.explode(ranges[F.col(key)]))
    return df.unionByName(copies.withColumn(key, F.col("_d").cast("string")).drop("_d"))


def region_first_fill(df: DataFrame, region: str, key: str, cols: list[str]) -> DataFrame:
    """Null coordinates take those of the region's first entity that has them."""
    firsts = df.groupBy(region).agg(
        *[F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(key))).alias(f"_f_{c}") for c in cols]
    )
    out = attach(df, firsts, [region])
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_f_{c}")) for c in cols}).drop(*[f"_f_{c}" for c in cols])


# ---- pairs ----


def _band_cells(band: Column, height: float, angle: float, steps: int) -> Column:
    """Number of longitude cells of a latitude band: ``steps`` of them span the radius in the band and those it reaches."""
    low, high = F.lit(-90.0) + (band - steps) * F.lit(height), F.lit(-90.0) + (band + steps + 1) * F.lit(height)
    farthest = F.least(F.lit(90.0), F.greatest(F.abs(low), F.abs(high)))
    reach = F.lit(math.sin(angle / 2)) / F.greatest(F.cos(F.radians(farthest)), F.lit(1e-12))
    span = F.degrees(2 * F.asin(F.least(F.lit(1.0), reach)))
    cells = F.floor(F.lit(360.0 * steps) / (span * F.lit(1 + 1e-9)))
    return F.when((reach >= 1) | (cells < 2 * steps + 1), F.lit(1)).otherwise(cells).cast("bigint")


def _cell(long: Column, cells: Column) -> Column:
    east = F.pmod(long + 180.0, F.lit(360.0))
    return F.least(F.floor(east * cells / 360.0), cells - 1).cast("bigint")


def pairs_within(df: DataFrame, key: str, max_km: float, lat: str = "lat", long: str = "long", radius_km: float = EARTH_KM, split_rows: int = 500, steps: int = 1, before: Column | None = None) -> DataFrame:
    """Unordered pairs (key < key_dest) at most ``max_km`` apart with their distance.

    Latitude bands of a ``steps``-th of the radius and, inside each band, longitude cells
    made for its farthest latitude turn the search into an equi-join: a row sits in one cell
    and probes the (2·steps+1)² around it, with wrap-around at the date line and one cell
    near the poles. More steps hug the circle closer at the price of more probes.
    Only rows of neighbouring cells meet, and only true pairs leave the join. Every other
    column of ``df`` comes along, with suffix ``_dest`` for the second row.

    ``before`` replaces key < key_dest where another total order is cheaper to test.
    Cells are counted first: one with more than ``split_rows`` home rows is shared out over as
    many keys as it asks for, the home row taking one by hash and the probing row meeting
    all, so no key holds more. The partition count is stated, because the inputs
    are small against the work and would otherwise be merged into few tasks.
    """
    angle = max_km / radius_km
    height = math.degrees(angle) / steps * (1 + 1e-9)
    phi, lam = F.radians(lat), F.radians(long)
    unit = {"_x": F.cos(phi) * F.cos(lam), "_y": F.cos(phi) * F.sin(lam), "_z": F.sin(phi)}
    rows = df.where(F.col(lat).isNotNull() & F.col(long).isNotNull()).withColumns(unit | {"_band": F.floor((F.col(lat) + 90) / F.lit(height))})
    home_cells = _band_cells(F.col("_band"), height, angle, steps)
    renamed = {c: f"{c}_dest" for c in [*df.columns, *unit]}
    home = rows.withColumn("_cell", _cell(F.col(long), home_cells)).withColumnsRenamed(renamed)
    probe = rows.withColumn("_band", F.explode(F.sequence(F.col("_band") - steps, F.col("_band") + steps)))
    cells = _band_cells(F.col("_band"), height, angle, steps)
    middle = _cell(F.col(long), cells)
    around = F.array_distinct(F.transform(F.sequence(middle - steps, middle + steps), lambda c: F.pmod(c, cells)))
    probe = probe.withColumn("_cell", F.explode(around))
    crowded = home.groupBy("_band", "_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(split_rows)).cast("int").alias("_splits")).where("_splits > 1")
    splits = F.coalesce("_splits", F.lit(1))
    home = home.join(crowded, ["_band", "_cell"], "left").withColumn("_split", F.pmod(F.hash(*[f"{c}_dest" for c in (lat, long, key)]), splits)).drop("_splits")
    probe = probe.join(crowded, ["_band", "_cell"], "left").withColumn("_split", F.explode(F.sequence(F.lit(0), splits - 1))).drop("_splits")
    on, tasks = ["_band", "_cell", "_split"], 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # haversine's h is a quarter of the squared chord: with unit vectors stored per row, a
    # candidate costs three products, and a kept pair one square root and one arc sine
    gaps = [F.col(c) - F.col(f"{c}_dest") for c in unit]
    chord2 = gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]
    limit = 4 * math.sin(min(angle, math.pi) / 2) ** 2
    met = probe.repartition(tasks, *on).join(home.repartition(tasks, *on), on)
    met = met.where((chord2 <= limit * (1 + 1e-9)) & (F.col(key) < F.col(f"{key}_dest") if before is None else before))
    distance = F.lit(2.0 * radius_km) * F.asin(F.least(F.lit(1.0), F.sqrt(chord2) / 2))
    keep = [*df.columns, *[f"{c}_dest" for c in df.columns]]
    return met.select(*keep, distance.alias("distance_km")).where(F.col("distance_km") <= max_km)


def pair_table(df: DataFrame, key: str, edges: list[float], max_km: float | None = None) -> DataFrame:
    """(distance_bin, key, key_dest, distance_km) for pairs up to the last edge (or ``max_km``)."""
    pairs = pairs_within(df.select(key, "lat", "long"), key, max_km or edges[-1])
    return pairs.select(even_cut("distance_km", edges).alias("distance_bin"), key, f"{key}_dest", "distance_km")


def bin_bounds(spark, edges: list[float]) -> DataFrame:
    inf = float("inf")
    rows = [(i, ([0.0] + edges)[i], (edges + [inf])[i]) for i in range(len(edges) + 1)]
    out = spark.createDataFrame(rows, "distance_bin int, distance_lower double, distance_upper double")
    return out.withColumn("mid", (F.col("distance_lower") + F.col("distance_upper")) / 2)


# ---- correlation ----


def pair_correlation(pairs: DataFrame, field: DataFrame, event: str, key: str, value: str, members: DataFrame | None = None) -> DataFrame:
    """Normalised covariance per (event, bin) from a stored pair table.

    ``members`` (key, place) tells which keys stand at a place where ``pairs`` are pairs of places: every key of
    the one then meets every key of the other. The field is folded first to sums and counts of a place, all events
    side by side, so that a pair of places costs one row for ``EVENTS_AT_ONCE`` events, however many keys stand there.
    The events are numbered on the driver.
    """
    held = field.where(F.col(event).isNotNull()).select(F.col(event).alias("_event"), key, F.col(value).cast("double").alias("_x"))
    place = key if members is None else next(c for c in members.columns if c != key)
    held = held if members is None else held.join(members, key)
    names = [row[0] for row in field.select(event).distinct().orderBy(event).collect() if row[0] is not None]
    kind = dict(field.dtypes)[event]
    if not names:
        return field.sparkSession.createDataFrame([], f"`{event}` {kind}, distance_bin int, pairs bigint, c_tau double")
    listed = F.array(*[F.struct(F.lit(n).cast(kind).alias("_event"), F.lit(i).alias("_e")) for i, n in enumerate(names)])
    numbers = field.sparkSession.range(1).select(F.explode(listed).alias("_v")).select("_v.*")
    slots = range(min(EVENTS_AT_ONCE, len(names)))
    chunk = F.floor(F.col("_e") / EVENTS_AT_ONCE).cast("int").alias("_chunk")
    mine = lambda i, c: F.when(F.col("_e") % EVENTS_AT_ONCE == i, c)
    folded = cut_lineage(
        held.join(numbers, "_event").groupBy(F.col(place).alias("_place"), chunk).agg(
            F.array(*[F.sum(mine(i, F.col("_x"))) for i in slots]).cast("array<double>").alias("_s"),
            F.array(*[F.count(mine(i, F.col("_x"))) for i in slots]).cast("array<bigint>").alias("_m"),
            F.array(*[F.count(mine(i, F.lit(1))) for i in slots]).cast("array<bigint>").alias("_n"),
        )
    )
    side = lambda suffix: folded.select(F.col("_place").alias(f"{place}{suffix}"), "_chunk", *[F.col(c).alias(f"{c}{suffix}") for c in ("_s", "_m", "_n")])
    met = pairs.select("distance_bin", place, f"{place}_dest").join(side(""), place).join(side("_dest"), ["_chunk", f"{place}_dest"])
    # a sum is null where an event has no value at the place, so it adds nothing
    product = lambda c, i: F.sum(F.get(c, F.lit(i)) * F.get(f"{c}_dest", F.lit(i)))
    cells = met.groupBy("_chunk", "distance_bin").agg(
        F.array(*[F.struct((F.col("_chunk") * EVENTS_AT_ONCE + i).alias("_e"), product("_n", i).alias("pairs"), ratio(product("_s", i), product("_m", i)).alias("_c")) for i in slots]).alias("_cells")
    )
    sums = cells.select("distance_bin", F.explode("_cells").alias("_v")).select("distance_bin", "_v.*").where("pairs > 0").join(numbers, "_e").withColumnRenamed("_event", event)
    spread = field.groupBy(event).agg(F.avg(F.col(value) * F.col(value)).alias("_v"))
    return attach(sums, spread, [event]).select(event, "distance_bin", "pairs", ratio("_c", "_v").alias("c_tau"))


def spatial_correlation(field: DataFrame, event: str, value: str, edges: list[float], lat: str = "lat", long: str = "long") -> DataFrame:
    """C(r) = mean(x·x' over pairs in the distance bin) / mean(x²), for all events together.

    * Rows of one place are folded first to (Σx, Σx², n) per event: pairs inside a place
      follow from these sums, so a crowded place costs one row.
    * Places meet once, for all events (``pairsums``).
    * The open last bin holds all remaining pairs: total minus the rest, from three sums.
      No pair beyond the last edge is ever formed.

    The events are numbered on the driver; rows without a value or a place are left out.
    """
    from .pairsums import sums_by_distance

    last, x = len(edges), F.col(value).cast("double")
    known = field.where(x.isNotNull() & F.col(lat).isNotNull() & F.col(long).isNotNull())
    places = cut_lineage(known.groupBy(lat, long, event).agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.count(x).cast("double").alias("n")))
    names = [row[0] for row in places.select(event).distinct().orderBy(event).collect()]
    if not names:
        return field.sparkSession.createDataFrame([], f"{event} {dict(field.dtypes)[event]}, distance_bin int, pairs double, c_tau double")
    numbers = field.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], f"`{event}` {dict(field.dtypes)[event]}, e int")
    numbered = places.join(numbers, event).drop(event)
    apart = sums_by_distance(numbered, len(names), edges, lat, long)
    half = lambda s, q: (F.col(s) * F.col(s) - F.col(q)) / 2
    totals = cut_lineage(
        numbered.groupBy("e").agg(
            F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"), F.sum(half("s", "q")).alias("hs"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("hn")
        )
    )
    here = totals.select("e", F.lit(0).alias("distance_bin"), F.col("hs").alias("xx"), F.col("hn").alias("pairs"))
    every = totals.select("e", F.lit(last).alias("distance_bin"), half("s", "q").alias("xx"), (F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    # every closed bin also counts against the open one
    signed = F.array(
        F.struct(F.col("distance_bin"), F.col("xx"), F.col("pairs")),
        F.struct(F.lit(last).alias("distance_bin"), (-F.col("xx")).alias("xx"), (-F.col("pairs")).alias("pairs")),
    )
    closed = apart.unionByName(here).select("e", F.explode(signed).alias("_b")).select("e", "_b.*")
    binned = closed.unionByName(every).groupBy("e", "distance_bin").agg(F.sum("xx").alias("xx"), F.sum("pairs").alias("pairs")).where("pairs > 0")
    spread = totals.select("e", ratio("q", "n").alias("_v"))
    out = binned.join(spread, "e").join(numbers, "e")
    return out.select(event, "distance_bin", "pairs", ratio(ratio("xx", "pairs"), F.col("_v")).alias("c_tau"))


def local_moran(df: DataFrame, key: str, value: str, max_km: float) -> DataFrame:
    """z_i = (y_i / m2) · Σ_j w_ij y_j with centred y, inverse-distance weights inside the radius."""
    stats = df.agg(F.avg(value).alias("_m"))
    y = attach(df, stats, []).withColumn("y", F.col(value) - F.col("_m")).drop("_m")
    m2 = y.agg(F.avg(F.col("y") * F.col("y")).alias("_m2"))
    pairs = pairs_within(y.select(key, "lat", "long", "y"), key, max_km).where("distance_km > 0")
    w = 1 / F.col("distance_km")
    ends = F.array(
        F.struct(F.col(key).alias(key), (w * F.col("y_dest")).alias("wy")), F.struct(F.col(f"{key}_dest").alias(key), (w * F.col("y")).alias("wy"))
    )
    sums = pairs.select(F.explode(ends).alias("_e")).groupBy(F.col(f"_e.{key}").alias(key)).agg(F.sum("_e.wy").alias("wy"))
    out = attach(y.join(sums, key, "left"), m2, [])
    return out.select(key, ratio(F.col("y") * F.coalesce("wy", F.lit(0.0)), F.col("_m2")).alias("moran"))
