import itertools
import math
import random

import numpy as np
import pytest

from panelspark.operators import pairsums, spatial

R = spatial.EARTH_KM


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(min(1.0, h)))


def plain(points, events, edges):
    """{(event, bin): (sum of products, pairs)} over unordered pairs up to the last edge."""
    out = {}
    for a, b in itertools.combinations(sorted(points), 2):
        number = sum(e < km(a, b) for e in edges)
        if number < len(edges):
            for e in range(events):
                (s, n), (t, m) = points[a].get(e, (0.0, 0)), points[b].get(e, (0.0, 0))
                if n * m:
                    x, p = out.get((e, number), (0.0, 0))
                    out[e, number] = (x + s * t, p + n * m)
    return out


@pytest.mark.parametrize("seed,spread,edges", [(1, 1.0, [10.0 * i for i in range(1, 8)]), (2, 170.0, [500.0, 5000.0, 20000.0]), (3, 0.01, [30.0, 60.0]), (4, 60.0, [1.0, 100.0])])
def test_sums_equal_all_pairs(spark, monkeypatch, seed, spread, edges):
    monkeypatch.setattr(pairsums, "BLOCK_PLACES", 16)
    monkeypatch.setattr(pairsums, "LEAF", 3)
    rnd = random.Random(seed)
    points = {}
    for _ in range(130):
        at = (round(max(-90.0, min(90.0, 45 + rnd.uniform(-spread, spread) / 2)), 3), round(rnd.uniform(-spread, spread), 3))
        points[at] = {e: (rnd.uniform(-1, 1), rnd.randint(1, 3)) for e in range(3) if rnd.random() < 0.8}
    rows = [(lat, long, e, s, float(n)) for (lat, long), of in points.items() for e, (s, n) in of.items()]
    df = spark.createDataFrame(rows, "lat double, long double, e int, s double, n double").repartition(4)
    got = {(r["e"], r["distance_bin"]): (r["xx"], r["pairs"]) for r in pairsums.sums_by_distance(df, 3, edges).collect()}
    want = plain({p: v for p, v in points.items() if v}, 3, edges)
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=1e-9) for k in want)


def test_runs_in_one_bin_are_not_opened(monkeypatch):
    rnd = np.random.default_rng(3)

    def block(lat, long, n=1000):
        phi, lam = np.radians(lat + rnd.uniform(-0.02, 0.02, n)), np.radians(long + rnd.uniform(-0.02, 0.02, n))
        units = np.stack([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)], 1)
        return pairsums.Block(units, rnd.uniform(-1, 1, (2, n)), np.ones((2, n)))

    a, b, c = block(45, 2), block(46, 2), block(70, 100)
    monkeypatch.setattr(pairsums.BinSums, "_pairs", lambda *_: pytest.fail("opened"))
    found = pairsums.BinSums([50.0, 200.0, 1000.0], 2)
    found.meet(a, b, a.tree(), b.tree())
    found.meet(a, c, a.tree(), c.tree())
    assert found.counts.tolist() == [[0, 1e6, 0, 0]] * 2
    assert found.sums[:, 1] == pytest.approx(a.sums.sum(1) * b.sums.sum(1))


def test_empty_field(spark):
    df = spark.createDataFrame([(1, None, 2.0, 1.0), (1, 45.0, 2.0, None)], "event int, lat double, long double, x double")
    assert spatial.spatial_correlation(df, "event", "x", [10.0]).count() == 0
    one = spark.createDataFrame([(1, 45.0, 2.0, 1.0), (1, 45.0, 2.0, -1.0), (2, 45.0, 3.0, 5.0)], "event int, lat double, long double, x double")
    assert [tuple(r) for r in spatial.spatial_correlation(one, "event", "x", [10.0]).collect()] == [(1, 0, 1.0, -1.0)]
