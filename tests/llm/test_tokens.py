"""Encoding, decoding and counting against the libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from panelspark.llm import bpe, bpe_count, queries

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
COUNTED = P.path("byte_bpe_50k.json")


def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    pools = ["ab", "a ", "a\n \t", "aé漢🙂 ", "0a!-= \n", "aaaa-----====  ", ["<|endoftext|>", "a", " ", "<|end"], "\x00\x1c\x85\xa0\u3000 x"]
    out = []
    for _ in range(n):
        pool = rnd.choice([*pools, [chr(rnd.choice([rnd.randrange(32, 0x3000), rnd.randrange(0x4E00, 0xD7FF), rnd.randrange(0x1F300, 0x1F700)])) for _ in range(30)]])
        out.append("".join(rnd.choice(pool) for _ in range(rnd.choice([0, 1, 3, 30, 300]))))
    return out


def test_each_token_has_one_last_merge():
    ranks = bpe.read_ranks(RANKS)
    some = random.Random(2).sample([t for t in ranks if len(t) > 1], 2000)
    assert all(bpe.last_merge(t, ranks) for t in some)


def test_ids_are_the_librarys():
    texts, lib = odd_texts(1500), library()
    for got, text in zip(bpe.encode_texts(texts, RANKS, P.PATTERN), texts):
        assert got.tolist() == lib.encode_ordinary(text)


def test_offsets_cover_the_texts():
    for text in odd_texts(300, 3):
        ids = bpe.encode_texts([text], RANKS, P.PATTERN)[0]
        starts, ends = bpe.character_offsets(text, ids, RANKS)
        table, begins = bpe.byte_table(RANKS)
        for i, a, b in zip(ids, starts, ends):
            assert table[begins[i] : begins[i + 1]].tobytes() in text[a:b].encode()
        assert {x for a, b in zip(starts, ends) for x in range(a, b)} == set(range(len(text)))


def test_round_trip_of_edges(edges):
    encoded = bpe.encode(edges, RANKS, P.PATTERN)
    rows = bpe.decode(encoded, RANKS).collect()
    assert len(rows) == edges.count()
    lib = library()
    for r in rows:
        text = r["text"] or ""
        assert r["ids"] == lib.encode_ordinary(text) and bytes(r["decoded"]) == text.encode() and r["decoded_text"] == text
        assert bytes(r["ids_le"]) == np.array(r["ids"], "<u4").tobytes()
        assert r["keep_id"] == "mine"


def test_a_split_character_shows_as_replacement(spark):
    cut = library().encode_ordinary("🙂")
    assert len(cut) > 1
    df = spark.createDataFrame([(cut[:1],), (cut,), ([],), (None,)], "ids array<int>")
    assert [r["decoded_text"] for r in bpe.decode(df, RANKS).collect()] == ["\ufffd", "🙂", "", ""]


def test_query_gives_the_contract(spark, given):
    lib = library()
    want = {(r["doc_id"], len(i := lib.encode_ordinary(r["text"] or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in given.collect()}
    assert {tuple(r) for r in queries.op1_bpe_round_trip(spark, "/root/testdata/sf0.001").collect()} == want


def test_counts_are_the_librarys(edges, empty):
    t, counts = Tokenizer.from_file(COUNTED), bpe_count.PieceCounts(COUNTED)
    for text in odd_texts(1500, 5):
        assert counts.of(text) == len(t.encode(text, add_special_tokens=False).ids), repr(text)
    for r in bpe_count.count_tokens(edges, COUNTED, 10).collect():
        text = r["text"] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 10)
    assert bpe_count.count_tokens(empty, COUNTED, 10).count() == 0


def test_count_query(spark, given):
    t = Tokenizer.from_file(COUNTED)
    want = {(r["doc_id"], len(r["text"].encode()), n := len(t.encode(r["text"], add_special_tokens=False).ids), n > 1024) for r in given.collect()}
    assert {tuple(r) for r in queries.op8_token_counts(spark, "/root/testdata/sf0.001").collect()} == want
