import random
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import functions as F

from panelspark.operators import bins, ladder


def plain(rows):
    """{(key, value): (n, below, total)} of (key, value, weight) rows."""
    out = {}
    for key in {k for k, _, _ in rows}:
        of = [(v, w) for k, v, w in rows if k == key]
        for value in {v for v, _ in of}:
            out[key, value] = (sum(w for v, w in of if v == value), sum(w for v, w in of if v < value), sum(w for _, w in of))
    return out


def test_a_day_of_seconds_spreads_over_slices(spark, monkeypatch):
    seen = []
    cut = ladder.cut_lineage
    monkeypatch.setattr(ladder, "cut_lineage", lambda df: seen.append(cut(df)) or seen[-1])
    start = 1_700_000_000
    df = spark.range(86_400).select((F.col("id") + start).alias("t"), (F.col("id") % 3 == 0).alias("third"))
    got = ladder.value_ladder(df.where("NOT third").unionByName(df), [], "t")
    assert got.where(f"below <> (t - {start}) * 2 - ceil((t - {start}) / 3) OR total <> 144000").count() == 0 and got.count() == 86_400
    sizes = [r["count"] for r in seen[0].groupBy("_slice").count().collect()]
    assert len(sizes) >= 16 and max(sizes) < 2 * 86_400 / len(sizes)


def test_crowded_values_far_from_zero(spark):
    """Values that lie close together beside a few far away: no slice holds most of them."""
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), 1e9 + rnd.randint(0, 4000) * 1e-6, rnd.randint(-2, 3)) for _ in range(6000)] + [("a", -1e300, 1), ("b", 1e300, 2), ("c", 0.0, 1)]
    df = spark.createDataFrame(rows, "k string, v double, w bigint").repartition(7)
    got = {(r["k"], r["v"]): (r["n"], r["below"], r["total"]) for r in ladder.value_ladder(df, ["k"], "v", F.col("w")).collect()}
    assert got == plain(rows)


def test_weights_of_other_types_and_two_keys(spark):
    rows = [(i % 2, "x" if i % 3 else "y", i % 5, Decimal(i) / 4) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b string, v int, w decimal(10,2)")
    got = {((r["a"], r["b"]), r["v"]): (r["n"], r["below"], r["total"]) for r in ladder.value_ladder(df, ["a", "b"], "v", F.col("w")).collect()}
    assert got == plain([((a, b), v, w) for a, b, v, w in rows])
    assert ladder.value_ladder(df.limit(0), ["a"], "v").count() == 0


def test_running_sums_go_on_over_batches():
    batch = lambda ks, ns: pa.RecordBatch.from_pydict({"k": ks, "n": ns}, pa.schema([("k", pa.string()), ("n", pa.int64())]))

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 3

    import pyspark

    kept, pyspark.TaskContext = pyspark.TaskContext, Task
    try:
        out = list(ladder._climb(["k"], True)(iter([batch(["a", "a"], [1, 2]), batch(["a", "b", "b"], [3, 4, 5]), batch([], []), batch(["b"], [6]), batch(["c"], [7])])))
    finally:
        pyspark.TaskContext = kept
    assert [x for b in out for x in b.column("_upto").to_pylist()] == [1, 3, 6, 4, 9, 15, 7] and set(out[0].column("_slice").to_pylist()) == {3}


def test_bins_and_bounds_agree(spark):
    rnd = random.Random(2)
    df = spark.createDataFrame([(i, rnd.choice("ab"), float(rnd.randint(0, 30))) for i in range(400)], "i int, k string, v double")
    rows, bounds = bins.size_bins(df, ["k"], "v", 40, "bin")
    joined = rows.join(bounds, ["k", "bin"])
    assert joined.count() == 400 == joined.where("v > lower AND v <= upper").count()
    assert bounds.where("lower >= upper").count() == 0
