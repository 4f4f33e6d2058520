"""Exact dedup through a cuckoo-filter index of live digests, sharded by digest.

A text's digest is the SHA-256 of its UTF-8 bytes without white space. Each shard keeps a
cuckoo filter: two candidate buckets of four 16-bit fingerprints. A hit is only a hint; it is
verified against the content digest stored with the bucket's entry. An insertion that finds no
place after ``MAX_KICKS`` moves doubles the filter and refills it from the stored keys.
Digests whose live count falls to zero are deleted.

Each task folds its own rows to one per digest before they are dealt out, so a text that
fills a third of the corpus sends a few rows, and shards hold distinct digests only. The
number of shards follows the number of rows.

Of equal texts the row with most code points, then the smallest id, stays; a null id comes
last. Null counts as the empty text, and all empty or blank texts are equal. Ids may be of any type
that has an order. Rows that share an id are judged each by its text; ``exact_groups`` marks identical
rows with one id all as staying, since the id is the only name a row has, and ``drop_copies`` keeps one of them if asked to.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut_lineage
from .common import SPACE, forget, raw_texts, schema_with, slices, with_column

SLOTS = 4
MAX_KICKS = 200
#: Rows that one shard is to hold at most on average.
SHARD_ROWS = 500_000
#: Digests that a task folds before it sends them on.
FOLD_KEYS = 100_000


class CuckooIndex:
    """Live keys in a cuckoo filter, each with its stored key and record."""

    def __init__(self, buckets: int = 64):
        self.keys: list[bytes | None] = []
        self.records: list[list | None] = []
        self.free: list[int] = []
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.entry = array("i", bytes(4 * SLOTS * buckets))

    def __len__(self) -> int:
        return len(self.keys) - len(self.free)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & self.mask
        return mark, first, first ^ self._shift(mark)

    def _shift(self, mark: int) -> int:
        return (mark * 0x9E3779B97F4A7C15 >> 13) & self.mask or self.mask & 1

    def _slot(self, key: bytes) -> int:
        """The slot that holds the key, or -1. A fingerprint that matches is checked against the stored key."""
        mark, first, second = self._places(key)
        for bucket in (first, second):
            for s in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if self.prints[s] == mark and self.keys[self.entry[s]] == key:
                    return s
        return -1

    def find(self, key: bytes) -> list | None:
        s = self._slot(key)
        return None if s < 0 else self.records[self.entry[s]]

    def insert(self, key: bytes, record: list) -> None:
        """Enter a key that is not in the index."""
        if self.free:
            at = self.free.pop()
            self.keys[at], self.records[at] = key, record
        else:
            at = len(self.keys)
            self.keys.append(key)
            self.records.append(record)
        if not self._enter(key, at):
            self._resize()

    def _enter(self, key: bytes, at: int) -> bool:
        mark, first, second = self._places(key)
        for bucket in (first, second):
            for s in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if not self.prints[s]:
                    self.prints[s], self.entry[s] = mark, at
                    return True
        bucket = second
        for kick in range(MAX_KICKS):
            s = SLOTS * bucket + (kick + mark) % SLOTS
            self.prints[s], mark = mark, self.prints[s]
            self.entry[s], at = at, self.entry[s]
            bucket ^= self._shift(mark)
            for s in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if not self.prints[s]:
                    self.prints[s], self.entry[s] = mark, at
                    return True
        return False

    def _resize(self) -> None:
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self._empty(buckets)
            if all(self._enter(k, i) for i, k in enumerate(self.keys) if k is not None):
                return

    def delete(self, key: bytes) -> bool:
        s = self._slot(key)
        if s < 0:
            return False
        at = self.entry[s]
        self.prints[s] = 0
        self.keys[at] = self.records[at] = None
        self.free.append(at)
        return True

    def items(self) -> Iterator[tuple[bytes, list]]:
        return ((k, r) for k, r in zip(self.keys, self.records) if k is not None)


def normalised(raw: bytes) -> bytes:
    return raw.translate(None, SPACE)


def with_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append ``digest`` (SHA-256 of the normalised text) and ``length`` (code points of the original)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for batch in slices(whole, text):
                raws = raw_texts(batch, text)
                digests = pa.array([hashlib.sha256(normalised(r)).digest() for r in raws], pa.binary())
                yield with_column(batch, digest=digests, length=pa.array([len(r.decode()) for r in raws], pa.int64()))

    return docs.mapInArrow(run, schema_with(docs, "digest binary", "length bigint"))



def _record(rows: DataFrame) -> tuple[str, pa.DataType]:
    """Schema of the index's rows, and the type of their ids."""
    kind = rows.schema["keep_id"].dataType
    return f"digest binary, n bigint, length bigint, keep_id {kind.simpleString()}", to_arrow_type(kind)


def _better(length: int, doc_id: object, record: list) -> bool:
    """Whether (length, id) comes before the record's keeper."""
    if length != record[1]:
        return length > record[1]
    return doc_id is not None and (record[2] is None or doc_id < record[2])


def _merge(index: CuckooIndex, key: bytes, n: int, length: int, doc_id: object) -> None:
    record = index.find(key)
    if record is None:
        index.insert(key, [n, length, doc_id])
        return
    record[0] += n
    if _better(length, doc_id, record):
        record[1:] = [length, doc_id]
    if not record[0]:
        index.delete(key)


def _rows(index: CuckooIndex, ids: pa.DataType, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for key, record in index.items():
        rows.append((key, *record))
        if len(rows) == size:
            yield _batch(rows, ids)
            rows = []
    if rows:
        yield _batch(rows, ids)


def _batch(rows: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
    kinds = [("digest", pa.binary()), ("n", pa.int64()), ("length", pa.int64()), ("keep_id", ids)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])


def _indexed(limit: int | None, ids: pa.DataType):
    """Fold rows (digest, n, length, keep_id) through an index, sending it on whenever it holds ``limit`` keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        index = CuckooIndex()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("digest", "n", "length", "keep_id"))):
                _merge(index, *row)
            if limit and len(index) >= limit:
                yield from _rows(index, ids)
                index = CuckooIndex()
        yield from _rows(index, ids)

    return run


def live_digests(rows: DataFrame, shards: int) -> DataFrame:
    """Net live digests of rows (digest, n, length, keep_id).

    ``n`` may be negative: those occurrences are deleted, and a digest with none left goes. The keeper
    is the best row that was ever entered; ``living_keepers`` gives the best one still there.
    """
    schema, ids = _record(rows)
    folded = rows.select("digest", "n", "length", "keep_id").mapInArrow(_indexed(FOLD_KEYS, ids), schema)
    return folded.repartition(shards, "digest").mapInArrow(_indexed(None, ids), schema).filter("n > 0")


def living_keepers(rows: DataFrame, live: DataFrame) -> DataFrame:
    """The live digests, each with the best of its rows that were not deleted; for rows with deletions."""
    left = rows.groupBy("digest", "length", "keep_id").agg(F.sum("n").alias("n")).filter("n > 0")
    longest = left.groupBy("digest").agg(F.max("length").alias("length"))
    best = left.join(longest, ["digest", "length"]).groupBy("digest", "length").agg(F.min("keep_id").alias("keep_id"))
    return live.select("digest", "n").join(best, "digest").select("digest", "n", "length", "keep_id")


def shard_count(rows: DataFrame) -> int:
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows.count() // SHARD_ROWS))


def groups(digests: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(digest, keep_id, keep_length, group_size) of rows with ``digest`` and ``length``."""
    rows = digests.select("digest", F.lit(1).cast("bigint").alias("n"), "length", F.col(doc_id).alias("keep_id"))
    return live_digests(rows, shard_count(digests)).select("digest", "keep_id", F.col("length").alias("keep_length"), F.col("n").alias("group_size"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    digests = cut_lineage(with_digest(docs.select(doc_id, text), text).select(doc_id, "digest", "length"))
    return (
        digests.join(groups(digests, doc_id), "digest")
        .select(doc_id, "keep_id", "group_size", F.col(doc_id).eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", single: bool = False) -> DataFrame:
    """The documents that stay, with their columns as they were.

    ``single`` keeps one row of each group also where rows share their id or have none; else all rows
    that have the keeper's id stay, whatever their length.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    digests = cut_lineage(with_digest(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "digest", "length"))
    found = groups(digests)
    keeper = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if not single:
        return with_digest(rows).drop("text", "length").join(found, "digest").filter(keeper).select("row.*")
    best = keeper & (F.col("length") == F.col("keep_length"))
    # rows that share their id, or have none, can be best together
    several = cut_lineage(digests.join(found, "digest").filter(best).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"))
    stay = with_digest(rows).drop("text").join(found, "digest").filter(best)
    if several.isEmpty():
        return stay.select("row.*")
    one = stay.join(several, "digest", "left_semi").groupBy("digest").agg(F.first("row").alias("row"))
    return stay.join(several, "digest", "left_anti").select("row.*").unionByName(one.select("row.*"))
