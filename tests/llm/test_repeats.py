import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from panelspark.llm import queries, suffix_arrays, suffix_dedup


def test_suffix_arrays_and_common_prefixes():
    rnd = random.Random(3)
    for _ in range(400):
        k = rnd.choice([1, 2, 3, 20])
        t = [rnd.randrange(1, k + 1) for _ in range(rnd.randrange(0, 60))] + [0]
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert suffix_arrays.suffix_array(np.array(t, np.int64), k + 1).tolist() == want
        before, common = suffix_arrays.permuted_common_prefixes(np.array(t), np.array(want), np.arange(len(t)), 5)
        for x, y in zip(want[1:], want):
            if max(x, y) + 5 <= len(t):
                n = next((i for i in range(5) if t[x + i] != t[y + i]), 5)
                assert (before[x], common[x]) == (y, n)


def brute(rows, length=200):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[i : i + length] for _, r in raws for i in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        hit = bytearray(len(r))
        for a in range(len(r) - length + 1):
            if seen[r[a : a + length]] > 1:
                hit[a : a + length] = b"\1" * length
        spans = sum(1 for a in range(len(r)) if hit[a] and (not a or not hit[a - 1]))
        kept = bytes(b for b, h in zip(r, hit) if not h)
        out.append((i, len(r), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def shown(df):
    return sorted(((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"]), len(r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(5)
    passage = "".join(rnd.choice("abcde ") for _ in range(320))
    rows = [(i, "".join(rnd.choice("fghij ") for _ in range(rnd.randrange(300))) + passage[rnd.randrange(60) :] + "".join(rnd.choice("klm ") for _ in range(rnd.randrange(300)))) for i in range(40)]
    rows += [(100, "na na " * 90), (101, "x" * 450), (102, "q" * 200), (103, "q" * 199), (104, "é" * 100 + "z"), (105, "z" + "é" * 100), (106, "abc def " * 24 + "abcdefg")]
    rows += [(107, passage), (107, passage), (108, passage[:199] + "X" + passage[200:])]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.mark.parametrize("hot", [10_000, 3])
def test_repeats_of_odd_texts(odd, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_STRINGS", hot)
    rows = [tuple(r) for r in odd.collect()]
    assert shown(suffix_dedup.remove_repeats(odd)) == brute(rows)


def test_edges(edges, empty):
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    assert shown(suffix_dedup.remove_repeats(edges)) == brute(rows)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_query_matches_brute_force(spark, given):
    got = sorted((tuple(r) for r in queries.op6_repeat_removal(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert got == brute([(r["doc_id"], r["text"]) for r in given.collect()])


def test_repeats_inside_one_text_by_period(spark):
    rnd = random.Random(9)
    line = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = [(p, line(90) + line(p) * 7 + line(90)) for p in range(130, 146)]
    rows += [(1000 + n, line(136) * 3 + line(n)) for n in range(3)] + [(2000, (line(136) + "\n") * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert shown(suffix_dedup.remove_repeats(df)) == brute(rows)
