import itertools
import random

import pytest
from pyspark.sql import functions as F

from panelspark.llm import resharding as r


def cheapest(sizes_of, weights):
    """The least bytes that any way of rounding the capacities moves."""
    rows = sum(map(len, sizes_of.values()))
    least = [rows * w // sum(weights) for w in weights]
    best = None
    for up in itertools.combinations(range(len(weights)), rows - sum(least)):
        total = 0
        for old, sizes in sizes_of.items():
            room = least[old] + (old in up) if 0 <= old < len(weights) else 0
            total += sum(sorted(sizes)[: max(0, len(sizes) - room)])
        best = total if best is None else min(best, total)
    return best


def test_flow_finds_the_cheapest():
    net = r.Flow(4)
    a, b, c = net.edge(0, 1, 5, 1), net.edge(0, 2, 5, 2), net.edge(1, 2, 2, 3)
    d, e = net.edge(1, 3, 3, 1), net.edge(2, 3, 6, 1)
    assert net.solve(0, 3) == 9
    assert [net.used(x) for x in (a, b, c, d, e)] == [4, 5, 1, 3, 6]


@pytest.mark.parametrize("seed", range(4))
def test_fewest_bytes_move(spark, seed):
    rnd = random.Random(seed)
    weights = [[1] * 4, [1, 2, 0, 3], [1], [1] * 6][seed]
    rows = [(i, rnd.choice([None, 0, 0, 0, 1, 2, 3, 5, 9]), rnd.choice([None, 3, 3, rnd.randint(1, 50)]), "mine") for i in range(37)]
    df = spark.createDataFrame(rows, "id bigint, was int, n bigint, shard string").repartition(3)
    got = r.reshard(df, F.col("was"), F.col("n"), weights, [F.col("id")]).collect()
    assert sorted(x["id"] for x in got) == list(range(37))
    old = {i: -1 if w is None else w for i, w, _, _ in rows}
    size = {i: n or 0 for i, _, n, _ in rows}
    assert all(x["old_shard"] == old[x["id"]] for x in got)
    counts = [sum(x["shard"] == s for x in got) for s in range(len(weights))]
    assert all(0 <= n - 37 * w // sum(weights) <= 1 for n, w in zip(counts, weights))
    for s, n in enumerate(counts):
        assert sorted(x["slot"] for x in got if x["shard"] == s) == list(range(n))
    sizes_of = {o: [size[i] for i in old if old[i] == o] for o in set(old.values())}
    assert sum(size[x["id"]] for x in got if x["shard"] != x["old_shard"]) == cheapest(sizes_of, weights)


def test_repeated_rows_empty_tables_and_wrong_weights(spark):
    df = spark.createDataFrame([(None, 0, 7)] * 50 + [(1, 0, 7)] * 3, "id bigint, was int, n bigint")
    got = r.reshard(df, F.col("was"), F.col("n"), [1, 1, 1], [F.col("id")])
    assert sorted(x["count"] for x in got.groupBy("shard").count().collect()) == [17, 18, 18]
    assert got.select("shard", "slot").distinct().count() == 53
    assert r.reshard(df.limit(0), F.col("was"), F.col("n"), [1, 1]).count() == 0
    for wrong in ([], [0, 0], [-1, 2]):
        with pytest.raises(ValueError):
            r.reshard(df, F.col("was"), F.col("n"), wrong)


def test_only_affected_shards_are_written(spark, tmp_path):
    rows = [(i, s, f"text {i}") for i, s in enumerate([0] * 10 + [1] * 5 + [2] * 5 + [3] * 1 + [4] * 4)]
    folder, target = f"{tmp_path}/old", f"{tmp_path}/new"
    spark.createDataFrame(rows, "id bigint, shard int, text string").write.partitionBy("shard").parquet(folder)
    layout = spark.read.parquet(folder)
    planned = r.reshard(layout, F.col("shard"), F.octet_length("text"), [1] * 5, [F.col("id")])
    places = r.rewrite(planned, folder, target)
    assert {s: p.startswith(target) for s, p in places.items()} == {0: True, 1: False, 2: False, 3: True, 4: True}
    got = {s: [x["id"] for x in spark.read.parquet(p).collect()] for s, p in places.items()}
    assert sorted(i for ids in got.values() for i in ids) == list(range(25)) and {len(v) for v in got.values()} == {5}
    still = r.reshard(layout.filter("shard in (1, 2)"), F.col("shard") - 1, F.octet_length("text"), [1, 1])
    assert set(r.rewrite(still, folder, f"{tmp_path}/none").values()) == {f"{folder}/shard=0", f"{folder}/shard=1"}
