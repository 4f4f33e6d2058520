"""Operators that cut long keys into parts give what one pass over a key gives."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import joins, polls, splits


def rows_of(df, *columns):
    return sorted(([r[c] for c in columns] for r in df.collect()), key=repr)


def test_kalman_in_chunks_equals_one_fold(spark, monkeypatch):
    rnd = random.Random(3)
    first = datetime.date(1969, 6, 1)
    rows = [(s, first + datetime.timedelta(days=d), None if rnd.random() < 0.1 else rnd.uniform(0, 100)) for s in ("a", None) for d in range(0, 700) if rnd.random() < 0.8 for _ in range(rnd.randint(1, 2))]
    df = spark.createDataFrame([*rows, ("c", first, 5.0)], "s string, day date, v double")
    whole = rows_of(polls.kalman_level(df, ["s"], "day", "v"), "s", "day", "level", "slope")
    monkeypatch.setattr(polls, "CHUNK_DAYS", 37)
    cut = rows_of(polls.kalman_level(df, ["s"], "day", "v"), "s", "day", "level", "slope")
    assert [r[:2] for r in whole] == [r[:2] for r in cut] and len(whole) > 1000
    assert np.allclose([r[2:] for r in whole], [r[2:] for r in cut], rtol=1e-9)


@pytest.mark.parametrize("reach", [0, 1, 3])
def test_backfill_over_ranges_of_periods(spark, monkeypatch, reach):
    monkeypatch.setattr(joins, "RANGE_REACHES", 2)
    rnd = random.Random(reach)
    facts = [(rnd.choice("ab"), p, rnd.choice([None, float(p)])) for p in rnd.sample(range(-20, 40), 40)]
    wanted = [(k, p) for k in "abc" for p in range(-25, 45)]
    got = joins.latest_within(spark.createDataFrame(facts, "k string, p bigint, v double"), spark.createDataFrame(wanted, "k string, p bigint"), ["k"], "p", "v", reach)
    want = {}
    for k, p in wanted:
        served = [(q, v) for f, q, v in facts if f == k and v is not None and p - reach <= q <= p]
        want[k, p] = (max(served)[1], max(served)[0]) if served else (None, None)
    assert {(r["k"], r["p"]): (r["v"], r["v_from"]) for r in got.collect()} == want


def test_strips_are_added_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(splits, "TREE_PARTS", 3)
    monkeypatch.setattr(splits, "STRIP_ROWS", 4)
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(300, 5))
    x[:, 3] = x[:, 0] * 2 + 0.01 * x[:, 3]
    given = [[None if rnd.random() < 0.1 else float(v) for v in row] for row in x]
    df = spark.createDataFrame(given, ", ".join(f"f{i} double" for i in range(5))).repartition(20)
    r = splits.correlation_matrix(df, [f"f{i}" for i in range(5)])
    import pandas as pd

    assert np.allclose(r, pd.DataFrame(given, dtype=float).corr().to_numpy())
    assert splits.correlated_to_drop(df, [f"f{i}" for i in range(5)]) == ["f3"]
    parts = spark.range(40).select((F.col("id") % 2).cast("int").alias("i"), F.lit(np.ones(3).tobytes()).alias("part")).repartition(9)
    assert {r["i"]: np.frombuffer(r["part"]).tolist() for r in splits.added_in_tree(parts, "i", "part").collect()} == {0: [20.0] * 3, 1: [20.0] * 3}


def test_recorded_jobs_go_on_where_they_were(spark, tmp_path):
    from panelspark.plans import backtest

    ran, path, schema = [], f"{tmp_path}/scores", "name string, year int, value double"

    def job(name, year, fail=False):
        def run():
            ran.append((name, year))
            if fail:
                raise RuntimeError("lost")
            return [(name, year, float(i)) for i in range(2)]

        return run

    jobs = {("a", 1): job("a", 1), ("a", 2): job("a", 2, fail=True), ("b", 1): job("b", 1)}
    with pytest.raises(RuntimeError):
        backtest.recorded_jobs(spark, jobs, path, schema, ["name", "year"], parallel=2)
    jobs[("a", 2)] = job("a", 2)
    got = backtest.recorded_jobs(spark, jobs, path, schema, ["name", "year"], parallel=2)
    assert got.count() == 6 and sorted(ran) == [("a", 1), ("a", 2), ("a", 2), ("b", 1)]
    assert backtest.recorded_jobs(spark, {("b", 1): job("b", 1)}, path, schema, ["name", "year"]).count() == 2
