"""Operators against pandas, brute force and hand-made frames."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import ballots, bins, explain, fits, forecast, joins, ladder, metrics, polls, projection, quality, reshape, schema, spatial, splits, windows
from panelspark.sources import files, pages


def frame(spark, seed=1, n=400):
    rng = random.Random(seed)
    values = [None, -3.5, 0.0, 0.0, 1.25, 2.0] + [round(rng.gauss(0, 10), 2) for _ in range(60)] + [1e12, -1e-9]
    # one group holds most rows and one value of it a third of them
    rows = [("hot" if i % 5 else rng.choice("abc"), 7.0 if i % 3 == 0 else rng.choice(values), i) for i in range(n)]
    return spark.createDataFrame(rows, "g string, v double, i int"), pd.DataFrame(rows, columns=["g", "v", "i"])


def test_pct_rank_matches_pandas_with_ties_and_nulls(spark):
    df, pdf = frame(spark)
    got = ladder.pct_rank_avg(df, ["g"], "v", "r", None).toPandas().sort_values("i")["r"].to_numpy()
    want = pdf.groupby("g")["v"].rank(pct=True).to_numpy()
    np.testing.assert_allclose(got, want)
    assert np.nanmin(got) > 0 and np.nanmax(got) <= 1


def test_quantiles_match_numpy(spark):
    df, pdf = frame(spark)
    got = {r["g"]: (r["a"], r["b"], r["c"]) for r in ladder.quantiles(df, ["g"], "v", {"a": 0.0, "b": 0.37, "c": 1.0}).collect()}
    for g, part in pdf.dropna().groupby("g"):
        np.testing.assert_allclose(got[g], np.quantile(part["v"], [0, 0.37, 1]))


def test_quantile_edges_and_bins(spark):
    df, pdf = frame(spark)
    edges = ladder.quantile_edges(df, ["g"], "v", 7, digits=None)
    for g, part in pdf.dropna().groupby("g"):
        got = sorted(r["edge"] for r in edges.where(F.col("g") == g).collect())
        want = np.unique(np.quantile(part["v"], [i / 7 for i in range(1, 7)]))
        np.testing.assert_allclose(got, want)
    binned = ladder.bin_by_edges(df, ["g"], "v", edges, "b").where("v IS NOT NULL").toPandas()
    for g, part in binned.groupby("g"):
        inner = np.unique(np.quantile(pdf[(pdf.g == g)].dropna()["v"], [i / 7 for i in range(1, 7)]))
        np.testing.assert_array_equal(part["b"], np.searchsorted(inner, part["v"], "left"))


def test_winsorise_and_positions(spark):
    df, _ = frame(spark, n=200)
    got = ladder.clamp_order_statistics(df, [], "v", 0.1, "w").where("v IS NOT NULL").toPandas()
    s = np.sort(got["v"].to_numpy())
    k = int(0.1 * len(s))
    np.testing.assert_allclose(np.sort(got["w"].to_numpy()), np.clip(s, s[k], s[-1 - k]))
    pos = ladder.hashed_position(df, ["i"], 3, "p").toPandas()["p"]
    assert sorted(pos) == list(range(200))


def test_permute_keeps_all_values(spark):
    df, pdf = frame(spark, n=120)
    mixed = explain.permute(df, "i", "v", 5).toPandas()
    assert sorted(mixed["v"].fillna(1e99)) == sorted(pdf["v"].fillna(1e99))
    assert len(mixed) == 120


def test_interpolation_fills_only_inner_gaps(spark):
    rows = [("a", 1, None), ("a", 2, 10.0), ("a", 3, None), ("a", 4, None), ("a", 5, 40.0), ("a", 6, None), ("b", 1, None), ("c", 1, 3.0)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    got = [r["v"] for r in windows.interpolate_linear(df, ["k"], "t", "v").orderBy("k", "t").collect()]
    assert got == [None, 10.0, 20.0, 30.0, 40.0, None, None, 3.0]


def test_group_mean_fill_falls_back_to_overall(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", None), ("y", None)], "g string, v double")
    got = {(r["g"], r["v"]) for r in windows.group_mean_fill(df, ["g"], ["v"]).collect()}
    assert got == {("x", 1.0), ("y", 1.0)}


def test_period_grid_and_asof(spark):
    df = spark.createDataFrame([("a", "f", 2000, 1.0), ("b", "f", 2003, 2.0), ("a", "g", 2001, 5.0)], "k string, feature string, period int, raw double")
    grid = reshape.fill_grid(df, "k").collect()
    assert len(grid) == 2 * (4 + 1)
    facts = spark.createDataFrame([("a", 2000, 1.0), ("a", 2002, None)], "k string, period int, v double")
    wanted = spark.createDataFrame([("a", y) for y in (1999, 2000, 2003, 2004)], "k string, period int")
    got = {r["period"]: (r["v"], r["v_from"]) for r in joins.latest_within(facts, wanted, ["k"], "period", "v", 3).collect()}
    assert got == {1999: (None, None), 2000: (1.0, 2000), 2003: (1.0, 2000), 2004: (None, None)}


def test_checked_join_raises(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    b = spark.createDataFrame([(1, "x")], "k int, v string")
    assert joins.checked_join(a, b, ["k"], "left", "m:1").count() == 2
    with pytest.raises(joins.CardinalityError):
        joins.checked_join(a, b, ["k"], "inner", "1:1")


def test_zero_cascade_and_quality(spark):
    df = spark.createDataFrame([(0.0, 5.0, 5.0, 3.0), (10.0, 0.0, 4.0, 2.0), (10.0, 8.0, 7.0, None)], "size double, participants double, valid double, vote_g double")
    got = [tuple(r) for r in schema.zero_cascade(df, ["vote_g"]).collect()]
    assert got == [(0.0, 0.0, 0.0, 0.0, True, True), (10.0, 0.0, 0.0, 0.0, False, True), (10.0, 8.0, 7.0, None, False, False)]
    with pytest.raises(quality.ExpectationError):
        quality.require(df, {"vote": F.col("vote_g") >= 0})


def great_circle(p, q):
    a, b, c, d = map(math.radians, (*p, *q))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * spatial.EARTH_KM * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("km", [30.0, 700.0, 4000.0])
def test_pairs_match_brute_force_at_poles_and_date_line(spark, km):
    rng = random.Random(3)
    pts = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(80)]
    pts += [(100 + i, 89.5 + 0.05 * i, -170.0 + 37 * i) for i in range(9)] + [(200 + i, 10.0 + 0.01 * i, 179.9 + 0.02 * i - (360 if i > 4 else 0)) for i in range(10)]
    pts += [(300, -90.0, 0.0), (301, -90.0, 120.0), (302, 45.0, 3.0), (303, 45.0, 3.0)]
    got = spatial.pairs_within(spark.createDataFrame(pts, "k int, lat double, long double"), "k", km).toPandas()
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and great_circle(a[1:], b[1:]) <= km}
    pairs = list(zip(got["k"], got["k_dest"]))
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    at = {p[0]: p[1:] for p in pts}
    np.testing.assert_allclose(got["distance_km"], [great_circle(at[a], at[b]) for a, b in pairs], atol=1e-6)


def test_correlation_matches_brute_force_with_crowded_place(spark):
    rng = random.Random(5)
    spots = [(45 + rng.random(), 2 + rng.random()) for _ in range(25)]
    rows = [(e, *(spots[0] if i % 3 == 0 else rng.choice(spots)), rng.gauss(0, 1)) for e in ("e1", "e2") for i in range(60)]
    edges = [10.0, 20.0, 30.0]
    got = {(r["event"], r["distance_bin"]): (r["pairs"], r["c_tau"]) for r in spatial.spatial_correlation(spark.createDataFrame(rows, "event string, lat double, long double, x double"), "event", "x", edges).collect()}
    want = {}
    for e in ("e1", "e2"):
        part = [r for r in rows if r[0] == e]
        v = np.mean([r[3] ** 2 for r in part])
        sums = {}
        for i, a in enumerate(part):
            for b in part[i + 1 :]:
                k = int(np.searchsorted(edges, great_circle(a[1:3], b[1:3]), "left"))
                n, s = sums.get(k, (0, 0.0))
                sums[k] = (n + 1, s + a[3] * b[3])
        want |= {(e, k): (n, s / n / v) for k, (n, s) in sums.items()}
    assert got.keys() == want.keys() and sum(n for n, _ in got.values()) == 60 * 59
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-9)


def test_centroid_with_hole(spark):
    big, hole = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[0, 0], [2, 0], [2, 4], [0, 4], [0, 0]]
    df = spark.createDataFrame([("a", [[[[float(c) for c in p] for p in big], [[float(c) for c in p] for p in hole]]])], "code string, polygons array<array<array<array<double>>>>")
    row = spatial.polygon_centroids(df, "code", "polygons").first()
    assert (row["lat"], row["long"]) == pytest.approx((2.0, 3.0))


@pytest.mark.parametrize("blocks", [2, 8])
def test_kendall_matches_brute_force(spark, blocks):
    rng = random.Random(2)
    rows = [(0.0 if i % 3 == 0 else float(rng.randint(0, 40)), rng.choice([1.0, 1.0, rng.random()])) for i in range(300)]
    x, y = np.array(rows).T
    s = np.sum(np.sign(x[:, None] - x) * np.sign(y[:, None] - y)) / 2
    n0 = 300 * 299 / 2
    tx = sum(c * (c - 1) / 2 for c in pd.Series(x).value_counts())
    ty = sum(c * (c - 1) / 2 for c in pd.Series(y).value_counts())
    got = metrics.kendall(spark.createDataFrame(rows, "a double, b double"), "a", "b", blocks).first()["kendall"]
    assert got == pytest.approx(s / math.sqrt((n0 - tx) * (n0 - ty)))


def test_divide_and_conquer_pair_sum():
    rng = np.random.default_rng(0)
    x, y, w = rng.integers(0, 50, 900).astype(float), rng.integers(0, 60, 900).astype(float), rng.integers(1, 4, 900).astype(float)
    s = np.sign(x[None] - x[:, None]) * np.sign(y[None] - y[:, None])
    assert metrics._signed_pairs(x, y, w) == pytest.approx(w @ s @ w / 2)


def test_fits_recover_parameters(spark):
    sizes = [50.0, 100.0, 300.0, 1000.0, 5000.0, 20000.0]
    law = spark.createDataFrame([("e", n, 1.2 - 0.05 * n**0.3) for n in sizes], "k string, n double, m double")
    row = fits.power_law(law, ["k"], "n", "m").first()
    assert (row["a"], row["b"], row["c"]) == pytest.approx((1.2, -0.05, 0.3), abs=1e-3)
    var = spark.createDataFrame([("e", n, math.sqrt(3 / n + 0.02)) for n in sizes], "k string, n double, s double")
    row = fits.variance_law(var, ["k"], "n", "s").first()
    assert (row["a"], row["b"], row["r2"]) == pytest.approx((3, 0.02, 1))
    noise = spark.createDataFrame([("e", n, 6.0 / n + 0.8 * n**-0.5, 0.4) for n in sizes], "k string, n double, y double, p double")
    row = fits.noise_law(noise, ["k"], "n", "y", "p").first()
    assert (row["a1"], row["a2"], row["omega"]) == pytest.approx((6.0, 0.8, -0.5), abs=1e-6)
    log = spark.createDataFrame([("e", float(r), 0.5 - 0.09 * math.log(r)) for r in (5, 20, 60, 150, 400)], "k string, r double, c double")
    row = fits.log_law(log, ["k"], "r", "c", 10, 300).first()
    assert row["lambda"] == pytest.approx(0.3) and row["range_km"] == pytest.approx(math.exp(0.5 / 0.09))


def test_slots(spark):
    df = spark.createDataFrame([("c", "A", "10", "25,0%", None, "5", "12,5%", "A", "20", "50%", None, "5", "12,5%", None, "0", "0%")], "k string, N1 string, V1 string, S1 string, N2 string, V2 string, S2 string, N3 string, V3 string, S3 string, N4 string, V4 string, S4 string, N5 string, V5 string, S5 string")
    merged = ballots.merge_labels(ballots.slots_to_long(df, ["k"], "N", "V", "S"), ["k"])
    got = {r["label"]: (r["votes"], r["share"]) for r in merged.collect()}
    assert got == {"A": (30.0, 75.0), "AUTRES_0": (5.0, 12.5), "AUTRES_1": (5.0, 12.5)}


def test_city_policy_needs_all_districts_null(spark):
    rows = [("75056", 1, 100.0, 0.4), ("75101", 1, None, None), ("75102", 1, None, 0.5), ("1001", 1, None, 0.1)]
    df = spark.createDataFrame(rows, "e string, t int, votes double, share double")
    cities = {"75056": (75101, 75120)}
    got = {r["e"]: (r["votes"], r["share"]) for r in ballots.city_policy(df, "e", ["t"], cities, ["votes", "share"], "Arr").collect()}
    assert got == {"75101": (5.0, None), "75102": (5.0, 0.5), "1001": (None, 0.1)}
    assert {r["e"] for r in ballots.city_policy(df, "e", ["t"], cities, ["votes", "share"], "Agg").collect()} == {"75056", "1001"}


def test_projection(spark):
    df = spark.createDataFrame([("a", 2018 + i, 100.0 * 1.1**i) for i in range(5)] + [("b", 2022, 4.0)], "k string, y int, v double")
    got = {(r["k"], r["y"]): r["v"] for r in projection.project(df, ["k"], "y", "v", 2022, 2024).collect()}
    assert got[("a", 2024)] == pytest.approx(100 * 1.1**6) and got[("b", 2023)] is None
    years = spark.createDataFrame([("f", y) for y in (2000, 2010, 2020, 2021, 2022, 2023)] + [("g", y) for y in (1, 2, 3, 4)], "feature string, period int")
    inv = {r["feature"]: (r["last_year"], r["frequency"]) for r in projection.inventory(years).collect()}
    assert inv == {"f": (2023, 3), "g": (4, None)}


def test_forecast_pins(spark):
    """Shares sum to one by an equal shift, counts are cut and rounded, |0.6 - 0.5| = 0.1."""
    df = spark.createDataFrame([("001", 100, 0.2, 0.3, 0.5), ("002", 200, 0.2, 0.3, 0.5)], "entity string, size long, pvote_a double, pvote_b double, pvote_par double")
    out = forecast.check_forecast(forecast.shares_to_counts(forecast.normalise_shares(df, ["a", "b"]), ["a", "b"]), ["a", "b"])
    rows = out.orderBy("entity").collect()
    assert [(r["pvote_a"], r["pvote_b"]) for r in rows] == [pytest.approx((0.45, 0.55))] * 2
    assert [r["participants"] for r in rows] == [50, 100]
    pred = spark.createDataFrame([("001", 0.6, 100, 90)], "entity string, pvote_a double, size long, valid long")
    truth = spark.createDataFrame([("001", 0.5, 100, 90)], "entity string, pvote_a double, size long, valid long")
    assert forecast.error_table(pred, truth, "entity", ["pvote_a"]).first()["pvote_a_diff"] == pytest.approx(0.1)


def test_kalman_matches_matrices(spark):
    import datetime

    z = [48.0, 52.0, 47.0, 60.0]
    df = spark.createDataFrame([("s", datetime.date(2022, 1, 1 + i), v) for i, v in enumerate(z)], "s string, d date, v double")
    got = [(r["level"], r["slope"]) for r in polls.kalman_level(df, ["s"], "d", "v").orderBy("d").collect()]
    f, h, q, x, p = np.array([[1, 1], [0, 1.0]]), np.array([[1, 0.0]]), np.diag([1.0, 3.0]), np.array([[50], [50.0]]), np.eye(2)
    for v, (level, slope) in zip(z, got):
        x, p = f @ x, f @ p @ f.T + q
        k = p @ h.T / (h @ p @ h.T + 100)[0, 0]
        x, p = x + k * (v - (h @ x)[0, 0]), (np.eye(2) - k @ h) @ p
        assert (level, slope) == pytest.approx((x[0, 0], x[1, 0]))


def test_splits(spark):
    df = spark.createDataFrame([(y, "p", float(y)) for y in (2002, 2007, 2012, 2017)], "t int, k string, y double")
    parts = splits.temporal_split(df, "t", "k", 2017, "p", "y", 8)
    assert {n: sorted(r["t"] for r in p.collect()) for n, p in parts.items()} == {"train": [2012], "val": [2002, 2007, 2012], "test": [2017]}
    assert [r["t"] for r in splits.temporal_split(df, "t", "k", 2017, "p", "y", 8, disjoint=True)["val"].collect()] == [2002, 2007]
    with pytest.raises(ValueError):
        splits.previous_events_split(df, "t", "k", 2007, "p")


def test_html_tables():
    html = """<h2>Polls</h2><table><tr><th colspan=2>Top</th></tr><tr><th>Date</th><th>A</th></tr><tr><td rowspan=2>x</td><td>1</td></tr>
    <tr><td>2</td></tr><tr><td></td><td></td></tr></table><table><caption> Second  round </caption><tr><td>q</td></tr></table><h3>Polls</h3><table><tr><td>z</td></tr></table>"""
    rows = pages.page_tables(html)
    assert rows == [
        (1, "Polls", ["Dates", "A"], 0, ["x", "1"]),
        (1, "Polls", ["Dates", "A"], 1, ["x", "2"]),
        (2, "Second round", ["0"], 0, ["q"]),
        (3, "Polls (2)", ["0"], 0, ["z"]),
    ]


def test_route_by_level_and_scan_event_tree(spark, tmp_path):
    spark.createDataFrame([(1001, 10.0), (2004, 5.0)], "entity int, size double").write.parquet(f"{tmp_path}/e/referundum/2005/ref2005_csv")
    spark.createDataFrame([("2A004", 3.0, 1)], "entity string, votes_x double, size int").write.parquet(f"{tmp_path}/e/presidentiel/2012/pres2012_csv")
    out = files.scan_event_tree(spark, f"{tmp_path}/e", {"referendum": 2, "presidentiel": 1})
    got = sorted((r["kind"], r["period"], r["event"], r["entity"], r["size"], r["kind_no"]) for r in out.collect())
    assert got == [("presidentiel", 2012, "pres2012", "2A004", 1.0, 1), ("referendum", 2005, "ref2005", "01001", 10.0, 2), ("referendum", 2005, "ref2005", "02004", 5.0, 2)]


def test_size_bins_partition_rows(spark):
    df, _ = frame(spark)
    rows, bounds = bins.size_bins(df.where("v IS NOT NULL"), ["g"], "v", 20)
    joined = rows.join(bounds, ["g", "size_bin"])
    assert joined.count() == rows.count() == joined.where("v > lower AND v <= upper").count()


def test_link_layout(spark):
    names = ["pres2022_csv.zip", "pres2017comm_csv.zip", "leg1871juil_csv.zip", "leg1946Nov_csv.zip", "leg1946Juin_csv.zip", "foo.pdf", "ref2005_csp.zip", "age2020csp.zip"]
    text = "".join(f"https://h/{n}" for n in names)
    got = {(r["kind"], r["year"], r["target"]) for r in files.link_layout(spark.createDataFrame([(text,)], "t string"), "t").collect()}
    assert got == {
        ("presidentiel", 2022, "presidentiel/2022/pres2022"),
        ("presidentiel", 2017, "presidentiel/2017/pres2017comm"),
        ("legislative", 1872, "legislative/1872/leg1871"),
        ("legislative", 1947, "legislative/1947/leg1946"),
        ("legislative", 1946, "legislative/1946/leg1946Juin"),
        ("referendum", 2005, "referendum/2005/ref2005"),
        (None, None, "age2020csp.zip"),
    }


def test_csv_tree_matches_columns_by_name(spark, tmp_path):
    root = tmp_path / "in"
    for year, text in {"2017": "code,votes_A,votes_B\n01,10,20\n", "2022/sub": 'code,votes_C,votes_A,"extra, x"\n01,7,5,99\n', "2023": "code,,code\n02,3,04\n"}.items():
        (root / "pres" / year).mkdir(parents=True)
        (root / "pres" / year / "f.csv").write_text(text)
    files.csv_tree_to_parquet(spark, str(root), f"{tmp_path}/out")
    got = {r["year"]: r.asDict() for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert [got[2017][c] for c in ("code", "votes_A", "votes_B", "votes_C", "source_file")] == ["01", "10", "20", None, "f.csv"]
    assert [got[2022][c] for c in ("code", "votes_A", "votes_B", "votes_C", "extra, x", "source_file")] == ["01", "5", None, "7", "99", "sub/f.csv"]
    assert [got[2023][c] for c in ("code", "_c1", "code.1")] == ["02", "3", "04"]


def test_table_columns_of_uneven_rows(spark):
    rows = [(1, 1, "t", ["A", "A", "", None, "B"], i, cells) for i, cells in enumerate([["a", "a2", "e", "n", "b"], ["a"], ["a", "a2", "e", "n", "b", "x", None]])]
    df = spark.createDataFrame(rows, "page_id bigint, table_no int, title string, header array<string>, row_no int, cells array<string>")
    got = [tuple(r)[4:] for r in pages.table_columns(df, ["A", "B", "", "C"], surplus="rest").orderBy("row_no").collect()]
    assert got == [("a", "b", "e", None, []), ("a", None, None, None, []), ("a", "b", "e", None, ["x", None])]


def test_slots_follow_the_columns(spark):
    df = spark.createDataFrame([(1, *[x for i in range(1, 13) for x in (f"L{i}", str(i), "1")])], "k int, " + ", ".join(f"N{i} string, V{i} string, S{i} string" for i in range(1, 13)))
    assert ballots.slots_to_long(df, ["k"], "N", "V", "S").count() == 12


def test_kalman_weighs_the_polls_of_a_day(spark):
    import datetime

    day = datetime.date(2022, 1, 1)
    df = spark.createDataFrame([("s", day, 40.0), ("s", day, 60.0), ("s", day + datetime.timedelta(1), None)], "s string, d date, v double")
    got = polls.kalman_level(df, ["s"], "d", "v").orderBy("d").collect()
    level, a = 100.0, 3.0
    for z in (40.0, 60.0):  # one update for each poll
        gain = a / (a + 100)
        level, a = level + gain * (z - level), (1 - gain) * a
    assert got[0]["level"] == pytest.approx(level)
    assert got[1]["observed"] is None and got[1]["level"] == pytest.approx(got[0]["level"] + got[0]["slope"])


def test_column_helpers(spark):
    from panelspark.functions import binning

    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0, 5.0)], "size int, F_raw_a double, F_rank_a double, lat double, previousy double")
    assert schema.feature_groups(df, "previousy", ["rank", "raw", "geo", "previous_vote", "none"]) == ["F_rank_a", "F_raw_a", "lat", "long", "previousy"]
    assert schema.feature_names(["raw", "rank"], ["s/a", "s/b"]) == ["F_raw_s/a", "F_raw_s/b", "F_rank_s/a", "F_rank_s/b"]
    assert schema.shared_columns(df.select("size", "lat"), df.select("lat", "previousy")) == (["lat"], ["previousy", "size"])
    assert df.where(schema.all_of([F.col("size") == 1, F.col("lat") == 4])).count() == 1
    assert binning.equal_width_edges(0, 10, 5) == [0, 2, 4, 6, 8, 10]
    assert binning.log_edges(1, 1000, 3) == pytest.approx([1, 10, 100, 1000])
    assert len(binning.distance_edges()) == 299 and binning.distance_edges()[0] == 3.33
    assert [tuple(r) for r in reshape.melt(df, ["size"], ["lat", "previousy"]).collect()] == [(1, "lat", 4.0), (1, "previousy", 5.0)]


def test_bin_bounds_cover_the_axis(spark):
    rows = spatial.bin_bounds(spark, [1.0, 3.0]).orderBy("distance_bin").collect()
    assert [tuple(r) for r in rows] == [(0, 0.0, 1.0, 0.5), (1, 1.0, 3.0, 2.0), (2, 3.0, float("inf"), float("inf"))]


def test_fraction_and_finite(spark):
    from panelspark.operators import quality, sampling

    ids = spark.range(20_000)
    part = sampling.stable_fraction(ids, "id", 0.25)
    assert 4_600 < part.count() < 5_400
    assert sampling.stable_fraction(ids.repartition(7), "id", 0.25).exceptAll(part).isEmpty()
    good = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert quality.require_finite(good, ["v"]) is good
    with pytest.raises(quality.ExpectationError):
        quality.require_finite(good.unionByName(spark.createDataFrame([(float("nan"),)], "v double")), ["v"])


def test_kendall_makes_more_parts_of_more_rows(spark, monkeypatch):
    from panelspark.operators import metrics

    rng = np.random.default_rng(5)
    x = rng.integers(0, 40, 600)
    y = x + rng.integers(0, 30, 600)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(600) for j in range(i))
    n = 600 * 599 / 2
    ties = [sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1]) for v in (x, y)]
    want = s / np.sqrt((n - ties[0]) * (n - ties[1]))
    for part_rows, least in ((50_000, 64), (3, 1), (600, 1)):
        monkeypatch.setattr(metrics, "PART_ROWS", part_rows)
        monkeypatch.setattr(metrics, "LEAST_PARTS", least)
        assert metrics.kendall(df, "x", "y").first()["kendall"] == pytest.approx(want)


def test_crowded_cells_are_split_by_their_size(spark):
    rng = np.random.default_rng(6)
    spots = [(i, 48 + float(a), 2 + float(b)) for i, (a, b) in enumerate(rng.normal(0, 0.002, (150, 2)))] + [(1000 + i, 40 + float(a), 5.0) for i, a in enumerate(rng.normal(0, 0.5, 30))]
    df = spark.createDataFrame(spots, "k bigint, lat double, long double")
    pairs = lambda n: {(r["k"], r["k_dest"]) for r in spatial.pairs_within(df, "k", 10.0, split_rows=n).collect()}
    assert pairs(4) == pairs(10_000) and len(pairs(4)) >= 150 * 149 / 2


def test_correlations_are_those_of_complete_pairs(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(1e6, 3, 300)
    pdf = pd.DataFrame({"a": base, "b": base * 2 + rng.normal(0, 0.1, 300), "c": rng.normal(0, 1, 300), "d": -base, "e": 5.0})
    pdf.loc[rng.integers(0, 300, 40), "b"] = np.nan
    pdf.loc[rng.integers(0, 300, 60), "c"] = np.nan
    df = spark.createDataFrame([[None if x != x else float(x) for x in row] for row in pdf.to_numpy()], "a double, b double, c double, d double, e double").repartition(5)
    got, want = splits.correlation_matrix(df, list(pdf.columns)), pdf.corr().to_numpy()
    assert np.allclose(got[:4, :4], want[:4, :4], atol=1e-9) and not (np.abs(got[4]) > 0).any()
    assert splits.correlated_to_drop(df, list("abcde")) == ["b"]
    assert splits.correlated_to_drop(df, list("abcde"), absolute=True) == ["b", "d"]
    assert splits.correlated_to_drop(df, ["a"]) == []
