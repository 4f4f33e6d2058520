import itertools
import math

import pytest

from panelspark.operators import models, tree_shapley as t

NAMES = ["a", "b", "c"]


def expected(nodes, x, known, at=0):
    """What a tree gives if only some features are known."""
    node = nodes[at]
    if node["leftChild"] < 0:
        return node["prediction"]
    left, right = node["leftChild"], node["rightChild"]
    f, threshold = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
    if f in known:
        return expected(nodes, x, known, left if x[f] <= threshold else right)
    share = nodes[left]["impurityStats"][0] / node["impurityStats"][0]
    return share * expected(nodes, x, known, left) + (1 - share) * expected(nodes, x, known, right)


def by_subsets(trees, weights, x, f):
    others, total = [g for g in range(3) if g != f], 0.0
    for size in range(3):
        for known in itertools.combinations(others, size):
            gain = sum(w * (expected(trees[i], x, {*known, f}) - expected(trees[i], x, set(known))) for i, w in weights.items())
            total += math.factorial(size) * math.factorial(2 - size) / 6 * gain
    return total


@pytest.mark.parametrize("kind,params", [("forest", {"numTrees": 4, "maxDepth": 5}), ("boosting", {"maxIter": 4, "maxDepth": 4})])
def test_values_equal_all_subsets(spark, kind, params):
    rows = [(i, float(i % 7), float(i % 5), None if i % 11 == 0 else float(i % 3), float((i % 7) * 2 + (i % 5) * (i % 3))) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double, y double")
    model = models.fit(kind, df, NAMES, "y", **params)
    trees, weights = t.node_table(model, spark)
    long, mean = t.tree_shapley(model, df, "id", NAMES)
    got = {(r["id"], r["feature"]): r["value"] for r in long.collect()}
    assert len(got) == 1200
    for r in models.predict(model, df, NAMES).collect():
        assert sum(got[r["id"], f] for f in NAMES) + mean == pytest.approx(r["prediction"], abs=1e-9)
    fill = sum(r[3] for r in rows if r[3] is not None) / sum(r[3] is not None for r in rows)
    for r in rows[:40]:
        x = [r[1], r[2], fill if r[3] is None else r[3]]
        for f in range(3):
            assert got[r[0], NAMES[f]] == pytest.approx(by_subsets(trees, weights, x, f), abs=1e-9)


def test_other_models_are_refused(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(9)], "a double, y double")
    with pytest.raises(TypeError):
        t.tree_shapley(models.fit("linear", df, ["a"], "y"), df, "a", ["a"])
