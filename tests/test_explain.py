import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import explain, metrics, models


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 1023])
def test_every_job_permutes_all_positions(spark, n):
    keys = [F.array(*[F.lit(k).cast("bigint") for k in r["_keys"]]) for r in explain.shuffle_keys(spark, 3).orderBy("_job").collect()]
    moved = spark.range(n).select("id", *[explain.shuffled(F.col("id"), n, k).alias(f"j{j}") for j, k in enumerate(keys)]).collect()
    for j in range(3):
        assert sorted(r[f"j{j}"] for r in moved) == list(range(n))
    if n == 1000:
        fixed = [sum(r["id"] == r[f"j{j}"] for r in moved) for j in range(3)]
        order = np.corrcoef([r["id"] for r in moved], [r["j0"] for r in moved])[0, 1]
        assert max(fixed) < 12 and abs(order) < 0.12 and sum(r["j0"] == r["j1"] for r in moved) < 12


def test_plan_does_not_grow_with_jobs(spark):
    df = spark.createDataFrame([(str(i), float(i % 7), float(i % 5), float(i)) for i in range(60)], "key string, a double, b double, y double")
    score = lambda d: d.withColumn("prediction", F.col("a") * 3 + F.col("b"))
    size = lambda names, repeats: explain.permuted_scores(score, df, "key", names, "y", repeats)._jdf.queryExecution().analyzed().toString().count("\n")
    assert size(["a", "b"], 1) == size(["a", "b"], 500)
    wide = df.select("*", *[F.col("a").alias(f"f{i}") for i in range(43)])
    names = ["a", "b", *(f"f{i}" for i in range(43))]
    got = explain.permuted_scores(score, wide, "key", names, "y", 10)
    assert got.groupBy("feature").count().where("count <> 10").count() == 0 and got.count() == 450
    base = df.agg(F.avg((F.col("y") - F.col("a") * 3 - F.col("b")) ** 2)).first()[0]
    assert got.where(F.col("feature").startswith("f")).agg(F.max(F.abs(F.col("mse") - base))).first()[0] < 1e-9


def test_kendall_over_a_grid_of_parts(spark):
    rnd = random.Random(4)
    rows = [(rnd.randint(0, 60), rnd.choice([7, 7, rnd.randint(0, 90)])) for _ in range(700)]
    rows = [(x, y + (x if rnd.random() < 0.5 else 0)) for x, y in rows]
    pairs = list(itertools.combinations(rows, 2))
    s = sum(np.sign(a - c) * np.sign(b - d) for (a, b), (c, d) in pairs)
    want = s / (sum(a != c for (a, _), (c, _) in pairs) * sum(b != d for (_, b), (_, d) in pairs)) ** 0.5
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rows], "x double, y double")
    for blocks in (None, 1, 3, 40):
        assert metrics.kendall(df, "x", "y", blocks).first()[0] == pytest.approx(want)
