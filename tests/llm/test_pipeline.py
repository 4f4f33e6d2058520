"""The pipeline against plain versions of its stages, one after the other."""

import re

import public_tokenizers as P
import tiktoken
from test_near_dedup import brute as near
from test_scans import brute as contaminated

import corpus_pipeline as pipe
from panelspark.llm import bpe

SF = "/root/testdata/sf0.001"


def plain(rows, items):
    rows = [r for r in rows if any(ch.isalpha() for ch in r["text"] or "")]
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r["text"])
        best[key] = min(best.get(key, (1, 0)), (-len(r["text"]), r["doc_id"]))
    keep = {i for _, i in best.values()}
    rows = [r for r in rows if r["doc_id"] in keep]
    keep = {i for i, _, c in near([(r["doc_id"], r["text"]) for r in rows], 5, 80) if i == c}
    rows = [r for r in rows if r["doc_id"] in keep]
    keep = {r[0] for r in contaminated([(r["doc_id"], r["text"]) for r in rows], items) if not r[5]}
    return [r for r in rows if r["doc_id"] in keep]


def test_run_matches_plain_stages(spark, given):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {r["doc_id"]: lib.encode_ordinary(r["text"]) for r in plain(given.collect(), items)}
    got = pipe.run(spark, SF).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == want and len(got) == len(want) and all(r["exact"] for r in got)
    assert 0 < len(want) < given.count()


def test_stages_take_edges_and_keep_columns(spark, edges, given):
    docs = edges.unionByName(given.limit(20), allowMissingColumns=True)
    for name, stage in pipe.STAGES[:-1]:
        left = stage(spark, docs, SF)
        assert left.columns == docs.columns, name
        assert 0 < left.count() <= docs.count()
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert pipe.STAGES[-1][1](spark, docs, SF).count() == docs.count()
