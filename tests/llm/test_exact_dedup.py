import hashlib
import re

from oracle import compare, duck

from panelspark.llm import cuckoo_dedup as c
from panelspark.llm import queries

SF = "/root/testdata/sf0.001"


def key(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_index_inserts_deletes_and_resizes():
    index, keys = c.CuckooIndex(2), [key(i) for i in range(3000)]
    for i, k in enumerate(keys):
        assert index.find(k) is None
        index.insert(k, [i])
    assert len(index) == 3000 and all(index.find(k) == [i] for i, k in enumerate(keys))
    assert index.mask + 1 > 2
    for k in keys[::2]:
        assert index.delete(k) and not index.delete(k)
    assert len(index) == 1500
    assert [index.find(k) is None for k in keys] == [i % 2 == 0 for i in range(3000)]
    index.insert(keys[0], [0])
    assert index.find(keys[0]) == [0]


def test_fingerprint_hits_are_verified():
    index, a = c.CuckooIndex(2), b"\x01\x00" + bytes(30)
    index.insert(a, ["a"])
    b = a[:31] + b"\x01"  # same fingerprint and buckets
    assert index.find(b) is None
    index.insert(b, ["b"])
    assert index.find(a) == ["a"] and index.find(b) == ["b"]


def test_deleted_occurrences_go(spark):
    rows = [(key(1), 3, 5, 10), (key(1), -1, 5, 10), (key(2), -2, 1, 1), (key(2), 2, 1, 1), (key(3), 1, 0, None)]
    live = c.live_digests(spark.createDataFrame(rows, "digest binary, n bigint, length bigint, keep_id bigint"), 3).collect()
    assert {(bytes(r["digest"]), r["n"]) for r in live} == {(key(1), 2), (key(3), 1)}


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[norm], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups_of_edges(edges):
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    got = c.exact_groups(edges).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_stage_keeps_columns(edges, empty):
    left = c.drop_copies(edges)
    assert left.columns == edges.columns
    want = [(r[0], r[4]) for r in brute([(r["doc_id"], r["text"]) for r in edges.collect()]) if r[3]]
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == sorted((w[0] for w in want), key=repr)
    assert c.drop_copies(empty).count() == 0


def test_sql_agrees(spark):
    for name in ("op3_exact_dedup", "op4_url_filter"):
        assert compare(spark, duck(SF), SF, queries.QUERIES[name], queries.SQL[name]) is None


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b", "x"), (1, "a b", "y"), (1, "ab", "z"), (None, "c", "x"), (None, "c", "y"), (None, " c", "z"), (2, "d", "x"), (None, None, "x"), (None, "", "y")]
    got = c.drop_copies(spark.createDataFrame(rows, "doc_id bigint, text string, digest string"), single=True)
    assert sorted((r["doc_id"] or 0, (r["text"] or "").replace(" ", "")) for r in got.collect()) == [(0, ""), (0, "c"), (1, "ab"), (2, "d")]
    assert {r["text"] for r in got.collect()} >= {"a b", " c", "d"}


def test_ids_of_any_type_and_deletions(spark):
    df = spark.createDataFrame([("a2", "t"), ("a10", "t"), ("b", "u")], "doc_id string, text string")
    assert {r["doc_id"]: r["keep_id"] for r in c.exact_groups(df).collect()} == {"a2": "a10", "a10": "a10", "b": "b"}
    rows = spark.createDataFrame([(b"x", 1, 10, 5), (b"x", 1, 9, 7), (b"x", 1, 9, 8), (b"x", -1, 10, 5), (b"y", -1, 3, 1), (b"z", 1, 1, 2), (b"z", -1, 1, 2)], "digest binary, n bigint, length bigint, keep_id bigint")
    live = c.live_digests(rows, 2)
    assert [(bytes(r["digest"]), r["n"]) for r in live.collect()] == [(b"x", 2)]
    assert [(bytes(r["digest"]), r["n"], r["length"], r["keep_id"]) for r in c.living_keepers(rows, live).collect()] == [(b"x", 2, 9, 7)]
