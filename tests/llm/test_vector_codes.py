import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import vector_codes as v


def plain(rows, parts, entries, rounds):
    """(codes, errors, codebooks) of rows (id, vector) by the definition, with Python's integers."""
    ints = sorted(((i, [math.floor(1024 * x) for x in vec]) for i, vec in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(ints[0][1])
    cut = lambda x: [x[size * p // parts : size * (p + 1) // parts] for p in range(parts)]
    books = [[cut(x)[p] for _, x in ints[:entries]] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    best = lambda p, x: min(range(len(books[p])), key=lambda k: (far(x, books[p][k]), k))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, x in ints:
                members.setdefault(best(p, cut(x)[p]), []).append(cut(x)[p])
            for k, of in members.items():
                books[p][k] = [sum(c) // len(of) for c in zip(*of)]
    out = []
    for i, x in ints:
        chosen = [best(p, cut(x)[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for k in chosen), sum(far(cut(x)[p], books[p][k]) for p, k in enumerate(chosen))))
    return out, books


def key(r):
    return (r[0] is None, r[0] or 0, r[1], r[2])


@pytest.mark.parametrize("size,parts,entries,n", [(8, 4, 5, 120), (6, 4, 3, 60), (3, 1, 256, 40), (2, 4, 2, 30)])
def test_codes_equal_the_definition(spark, monkeypatch, size, parts, entries, n):
    monkeypatch.setattr(v, "BLOCK", 16)
    rnd = random.Random(size)
    rows = [(rnd.choice([None, *range(200)]), [rnd.choice([rnd.gauss(0, 0.1), -0.25, 0.0005]) for _ in range(size)], "mine") for _ in range(n)]
    rows += rows[:5] + [(7, [0.125] * size, "mine")] * 40
    df = spark.createDataFrame(rows, "id bigint, vec array<float>, code string").repartition(3)
    coded, books = v.compress(df, "vec", [F.col("id")], parts, entries, 3)
    want, plain_books = plain([(i, [float(np.float32(x)) for x in vec]) for i, vec, _ in rows], parts, entries, 3)
    assert [b.tolist() for b in books] == plain_books
    assert sorted(((r["id"], r["code"], r["error"]) for r in coded.collect()), key=key) == sorted(want, key=key)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.5, None]), (3, [nan, 0.0]), (4, [inf, 0.0]), (5, [0.5, -0.5]), (6, [0.25, 0.25]), (7, [1.0]), (8, []), (9, [1e30, 0.0]), (None, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, vec array<double>")
    coded, books = v.compress(df, "vec", [F.col("id")], 2, 4, 2)
    got = {r["id"]: (r["code"], r["error"]) for r in coded.collect()}
    assert got == {5: ("0000", 0), 6: ("0101", 0), None: ("0202", 0), 7: (None, None), 8: (None, None), 9: (None, None)}
    assert books[1].tolist() == [[-512], [256], [0]]
    for none in (df.limit(0), df.filter("id = 9"), df.filter("id = 8")):
        coded, books = v.compress(none, "vec", [F.col("id")], 2, 4, 2)
        assert coded.count() == none.count() and coded.columns == ["id", "vec", "code", "error"]
    with pytest.raises(ValueError):
        v.compress(df, "vec", [F.col("id")], entries=257)


def test_group_error_of_null_labels(spark):
    df = spark.createDataFrame([(1, "a", 2), (2, None, 3), (3, None, 4), (4, "a", None)], "id int, label string, error bigint")
    assert {r["id"]: r["label_error"] for r in v.with_group_error(df, "label").collect()} == {1: 2, 2: 7, 3: 7, 4: 2}


def test_curve_visits_neighbours():
    cells = np.array(list(itertools.product(range(4), repeat=3)))
    wide = np.full(3, (1 << 16) - 1)
    keys = v.hilbert_keys(cells * (1 << 14), np.zeros(3, np.int64), wide)
    walk = cells[np.argsort(keys)]
    assert len(set(keys.tolist())) == 64 and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_shortlist_and_kernels_are_exact():
    rnd = np.random.default_rng(3)
    for scale in (50, 1 << 25):
        for _ in range(40):
            x, c = rnd.integers(-scale, scale, (20, 4)) // rnd.integers(1, 9), rnd.integers(-scale, scale, (12, 4))
            c[5] = c[2]
            chosen = v.shortlist(c, x.min(0), x.max(0))
            best, distance = v.nearest(x, c[chosen])
            whole = ((x[:, None] - c) ** 2).sum(2)
            assert (chosen[best] == whole.argmin(1)).all() and (distance == whole.min(1)).all()
