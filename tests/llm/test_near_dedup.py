import random
from collections import Counter

import numpy as np
import pytest
from plain import words

from panelspark.llm import chosen_path, graph, queries
from panelspark.llm.words import words_of


def sets_of(rows, size):
    out = []
    for i, t in rows:
        w = words(t)
        out.append((i, frozenset(tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset()))
    return out


def brute(rows, size=3, percent=85):
    sets = sets_of(rows, size)
    part = list(range(len(sets)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    holders = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, (_, s) in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n) and root(i) != root(j):
                part[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, len(s), least.get(root(i)) if s else doc) for i, (doc, s) in enumerate(sets)), key=repr)


def shown(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def test_words_are_those_of_the_contract():
    texts = ["The  cat\tsat", "", "   ", "a", "THE cat sat", "é É", "x" * 3_000_000 + " y", "\x85 \xa0b"]
    found = words_of([t.encode() for t in texts])
    names = {}
    for t, a, b in zip(texts, found.first, found.first[1:]):
        own = words(t)
        assert b - a == len(own)
        for w, h in zip(own, found.hashes[a:b].tolist()):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5)] + [(2000, 2000 + i) for i in range(50)]
    part = {}
    for a, b in edges:
        part.setdefault(a, {a}), part.setdefault(b, {b})
        if part[a] is not part[b]:
            part[a] |= part[b]
            for x in list(part[a]):
                part[x] = part[a]
    got = graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {(r["node"], r["component"]) for r in got.collect()} == {(x, min(s)) for x, s in part.items() if len(s) > 1}


@pytest.fixture(scope="module")
def copies(spark):
    """A group of many near-copies, chains near the threshold, and documents that share a passage."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base, passage = [word() for _ in range(120)], [word() for _ in range(30)]
    rows = []
    for _ in range(60):
        w = base[:]
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = word()
        rows.append(" ".join(w))
    chain = [word() for _ in range(100)]
    for i in range(20):
        chain[rnd.randrange(100)] = word()
        rows.append(" ".join(chain))
    for _ in range(40):
        rows.append(" ".join([word() for _ in range(40)] + passage))
    rows += ["a b", "a b", "A  b", "a", "b a", "", None]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")


@pytest.mark.parametrize(("limit", "block"), [(64, 2048), (4, 2048), (4, 8)])
def test_groups_match_brute_force(copies, monkeypatch, limit, block):
    monkeypatch.setattr(chosen_path, "NODE_LIMIT", limit)
    monkeypatch.setattr(chosen_path, "BLOCK_CLASSES", block)
    monkeypatch.setattr(chosen_path, "HUBS", 1)
    rows = [tuple(r) for r in copies.collect()]
    assert shown(chosen_path.near_groups(copies, 3, 85)) == brute(rows)


def test_unlinked_cluster_is_compared_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BLOCK_CLASSES", 32)
    monkeypatch.setattr(chosen_path, "HUBS", 1)
    rnd = np.random.default_rng(6)
    sets = [np.unique(rnd.integers(0, 1 << 60, 40, dtype=np.uint64)) for _ in range(300)]
    near = [np.sort(np.append(sets[7 * i][1:], np.uint64(i + 1))) for i in range(40)]
    given = sets + near
    rows = [(i.to_bytes(2, "big"), b"c", len(s), s.tobytes()) for i, s in enumerate(given)]
    sizes, exact = [], chosen_path.exact_links

    def watched(members, percent):
        sizes.extend(r["count"] for r in members.groupBy("block").count().collect())
        return exact(members, percent)

    monkeypatch.setattr(chosen_path, "exact_links", watched)
    table = spark.createDataFrame(rows, "class binary, cluster binary, n bigint, shingles binary")
    part = {int.from_bytes(r["class"], "big"): bytes(r["part"]) for r in chosen_path.linked_parts(table, 85).collect()}
    assert len(part) == len(given) and len(set(part.values())) == 300
    assert all(part[300 + i] == part[7 * i] for i in range(40))
    assert max(sizes) <= 2 * 32


def test_edges_and_stage(edges, empty):
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    want = brute(rows)
    assert shown(chosen_path.near_groups(edges, 3, 85)) == want
    left = chosen_path.drop_near_copies(edges, 3, 85)
    assert left.columns == edges.columns
    kept = {i for i, _, c in want if i == c}
    assert {r["doc_id"] for r in left.collect()} == kept
    assert chosen_path.drop_near_copies(empty, 5, 80).count() == 0


def test_a_minwise_token_agrees_as_often_as_sets_overlap():
    rnd = np.random.default_rng(8)
    common = rnd.integers(0, 2**63, 850, dtype=np.uint64)
    agree = []
    for _ in range(40):
        a, b = (np.unique(np.concatenate([common, rnd.integers(0, 2**63, 75, dtype=np.uint64)])) for _ in range(2))
        agree.append((chosen_path.minwise_tokens(a) == chosen_path.minwise_tokens(b)).mean())
    assert abs(np.mean(agree) - 0.85) < 0.02


def test_query_matches_brute_force(spark, given):
    want = [(i, n, c, i == c) for i, n, c in brute([(r["doc_id"], r["text"]) for r in given.collect()])]
    assert sorted((tuple(r) for r in queries.op10_near_dedup(spark, "/root/testdata/sf0.001").collect()), key=repr) == sorted(want, key=repr)


def test_one_row_of_each_component_stays(spark):
    from panelspark.llm import chosen_path

    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "other"])
    rows = [(1, " ".join(words), "x"), (1, " ".join(words), "y"), (1, "quite another text here", "z"), (2, near, "x"), (None, "no id at all here", "x"), (None, "no id at all here", "y"), (3, None, "x"), (3, None, "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ref string")
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in chosen_path.drop_near_copies(df, size=5, percent=80, single=True).collect())
    assert got == [(0, "no id at all here"), (1, "quite another text here"), (1, " ".join(words)), (3, ""), (3, "")]
    named = spark.createDataFrame([("b", "one two three"), ("a", "one two three")], "doc_id string, text string")
    assert {r["doc_id"]: r["component_id"] for r in chosen_path.near_groups(named, size=3, percent=85).collect()} == {"a": "a", "b": "a"}
