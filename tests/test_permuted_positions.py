import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import explain


@pytest.mark.parametrize("n", [1, 2, 1000, 5 * 10**9 + 7])
def test_arrays_and_columns_permute_alike(spark, n):
    places = sorted({i * max(1, n // 500) % n for i in range(500)} | {0, n - 1})
    keys = [F.array(*[F.lit(k).cast("bigint") for k in r["_keys"]]) for r in explain.shuffle_keys(spark, 3).orderBy("_job").collect()]
    df = spark.createDataFrame([(p,) for p in places], "id bigint").coalesce(1)
    rows = df.select("id", *[explain.shuffled(F.col("id"), n, k).alias(f"j{j}") for j, k in enumerate(keys)]).orderBy("id").collect()
    for j in range(3):
        assert explain.shuffled_array(np.array(places), n, j).tolist() == [r[f"j{j}"] for r in rows]


def test_values_are_sent_without_a_column_of_keys(spark):
    """The shuffle of positions is array work: no expression is evaluated for each round of each row."""
    df = spark.createDataFrame([(str(i), float(i % 7) if i % 3 else None, float(i)) for i in range(40)], "key string, a double, y double")
    score = lambda d: d.withColumn("prediction", F.coalesce(F.col("a"), F.lit(0.0)))
    out = explain.permuted_scores(score, df, "key", ["a"], "y", 3)
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["_pos"]: r for r in explain.numbered(df, "key", 42).collect()}
    for r in out.collect():
        to = explain.shuffled_array(np.arange(40), 40, r["repeat"]).tolist()
        sent = {to[p]: rows[p]["a"] or 0.0 for p in range(40)}
        assert r["mse"] == pytest.approx(sum((rows[p]["y"] - sent[p]) ** 2 for p in range(40)) / 40)
