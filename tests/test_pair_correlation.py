"""Covariance from a pair table of places at which many keys stand."""

import itertools
import math

from pyspark.sql import functions as F

from panelspark.operators import spatial


def test_pairs_of_places_equal_pairs_of_keys(spark):
    """Nulls, a key named twice, events that a place does not have, and more events than stand in one row."""
    events = spatial.EVENTS_AT_ONCE + 3
    rows = [(e, k, None if (k + e) % 5 == 0 else float((k * 7 + e * 3) % 11 - 5)) for e in range(events) for k in range(12) if (k // 3 + e) % 4]
    rows += [(None, 3, 1.0), (1, None, 2.0), (1, 4, 6.0)]
    member = [(k, k // 3) for k in range(12)] + [(5, 1)]
    pair = [(a + b, a, b) for a, b in itertools.combinations(range(4), 2)]
    field = spark.createDataFrame(rows, "event int, entity int, x double")
    out = spatial.pair_correlation(spark.createDataFrame(pair, "distance_bin int, place int, place_dest int"), field, "event", "entity", "x", spark.createDataFrame(member, "entity int, place int"))
    want = {}
    for number, a, b in pair:
        for e in range(events):
            at = lambda p: [x for k, q in member if q == p for f, i, x in rows if f == e and i == k]  # noqa: B023
            want.setdefault((e, number), []).extend(itertools.product(at(a), at(b)))
    spread = {e: [x * x for f, _, x in rows if f == e and x is not None] for e in range(events)}
    got = {(r["event"], r["distance_bin"]): r for r in out.collect()}
    assert set(got) == {k for k, v in want.items() if v}
    for (e, number), r in got.items():
        products = [x * y for x, y in want[e, number] if x is not None and y is not None]
        assert r["pairs"] == len(want[e, number])
        if products:
            assert math.isclose(r["c_tau"], (sum(products) / len(products)) / (sum(spread[e]) / len(spread[e])), abs_tol=1e-9)
        else:
            assert r["c_tau"] is None


def test_crowded_places_cost_one_row(spark):
    """Two places of 200,000 keys each: 40,000,000,000 pairs of keys and one of places."""
    keys = spark.range(400_000).select(F.col("id").alias("entity"), (F.col("id") % 2).alias("place"))
    field = keys.select(F.lit(1).alias("event"), "entity", (F.col("place") + 1).cast("double").alias("x"))
    pairs = spark.createDataFrame([(7, 0, 1)], "distance_bin int, place bigint, place_dest bigint")
    (row,) = spatial.pair_correlation(pairs, field, "event", "entity", "x", keys).collect()
    assert (row["distance_bin"], row["pairs"]) == (7, 40_000_000_000)
    assert math.isclose(row["c_tau"], 2.0 / 2.5)


def test_without_members(spark):
    field = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 1.0)], "event string, k int, x double")
    pairs = spark.createDataFrame([(0, 1, 2)], "distance_bin int, k int, k_dest int")
    assert [tuple(r) for r in spatial.pair_correlation(pairs, field, "event", "k", "x").collect()] == [("a", 0, 1, 6.0 / 6.5)]
