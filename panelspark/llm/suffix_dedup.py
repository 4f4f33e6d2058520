"""Suffix-array dedup: remove every byte that a repeated string of ``LENGTH`` bytes covers.

A string is repeated if it starts anywhere else, in the same document or in another; matches
never cross documents, and all strings are judged on the input. The result is exact, up
to collisions of 64-bit hashes.

1. Each window of ``LENGTH`` bytes is named by the least hash of its ``GRAM``-byte strings.
   Runs of windows with one name are super-windows; equal windows have equal names, so
   repeats only have to be sought among the super-windows of one name. Names that occur once drop out.
2. A name whose super-windows are all the same string is settled: all of it is repeated.
3. The distinct strings of the other names are dealt out to shards by name. A shard builds
   suffix arrays of them by induced sorting and takes the permuted common prefixes: a
   window is repeated if its suffix shares ``LENGTH`` bytes with its neighbour in the array. Names with more
   than ``HOT_STRINGS`` distinct strings, or ``HOT_BYTES`` in them, which would fill a task, have their windows
   counted by content instead, with partial sums before the shuffle.
4. The repeated windows go back to all places of their strings, and the texts lose what they cover.

Null, empty and short texts lose nothing. Rows are told apart by a hash of id and text:
identical rows count as two places of the same string. Only (id, text) of the input is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import forget, raw_texts, slices
from .suffix_arrays import index_type, permuted_common_prefixes, prefix_sums, substring_hashes, suffix_array
from .words import key_groups, mix

LENGTH = 200
GRAM = 64
#: Windows of one super-window at most; longer runs are cut.
LONGEST = 1 << 12
#: Bytes of strings that one suffix array is built of; the strings of a name are never parted.
ARRAY_BYTES = 1 << 21
#: Distinct strings of a name, and their bytes, beyond which its windows are counted by content.
HOT_STRINGS, HOT_BYTES = 10_000, 1 << 22
_PLACE_BITS = 14


def sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` of each ``width`` neighbouring values, by doubling."""
    out, have = x, 1
    while 2 * have <= width:
        out = least(out[:-have], out[have:])
        have *= 2
    rest, n = width - have, len(x) - width + 1
    return least(out[:n], out[rest : rest + n])


def super_windows(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...] | None:
    """(name, hash of the string, first window, last window, whether repeats inside it are possible)."""
    if len(raw) < length:
        return None
    sums, down = prefix_sums(np.frombuffer(raw, np.uint8))
    at = np.arange(len(raw) - gram + 1)
    hashes = mix(substring_hashes(sums, down, at, at + gram))
    width = length - gram + 1
    names = sliding(hashes, width, np.minimum)
    new = np.concatenate([[True], names[1:] != names[:-1]])
    first = np.flatnonzero(new)
    if len(first) and max(np.diff(np.append(first, len(names)))) > LONGEST:
        since = np.arange(len(names)) - np.repeat(first, np.diff(np.append(first, len(names))))
        first = np.flatnonzero(new | (since % LONGEST == 0))
    last = np.append(first[1:], len(names)) - 1
    # a name that stands twice within the reach of one window, or of two next to each other, can make windows of one run equal
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    pad = np.zeros(width - 1, np.uint32)
    chosen = np.flatnonzero(sliding(np.concatenate([pad, (names >> np.uint64(32)).astype(np.uint32), pad]), width, np.maximum) == high)
    value = hashes[chosen]
    near = value[1:][(value[1:] == value[:-1]) & (np.diff(chosen) <= width)]
    inner = np.isin(names[first], near) if len(near) else np.zeros(len(first), bool)
    string = np.frombuffer(b"".join(blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(first.tolist(), (last + length).tolist())), np.int64)
    return names[first].view(np.int64), string, first, last, inner


def all_runs(rows: DataFrame) -> DataFrame:
    """(ref, name, string, place, inner) of rows (ref, text); ``place`` packs the first window and the number of further ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found = [super_windows(r) for r in raw_texts(batch)]
                refs = batch.column("ref").to_numpy(zero_copy_only=False)
                some = [i for i, f in enumerate(found) if f]
                if not some:
                    continue
                name, string, first, last, inner = (np.concatenate([found[i][k] for i in some]) for k in range(5))
                ref = np.repeat(refs[some], [len(found[i][0]) for i in some])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ref, name, string, first << _PLACE_BITS | last - first, inner)], names=["ref", "name", "string", "place", "inner"])

    return rows.mapInArrow(run, "ref bigint, name bigint, string bigint, place bigint, inner boolean")


def _first() -> Column:
    return F.shiftright("place", _PLACE_BITS)


def _more() -> Column:
    return F.col("place").bitwiseAND((1 << _PLACE_BITS) - 1)


def contested_strings(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """(name, string, n, content): each distinct string of contested runs once, with its number of places."""
    one = runs.groupBy("name", "string").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ref", "place")).alias("one"))
    wanted = one.select("name", "string", "n", "one.ref", "one.place").select("ref", F.struct("name", "string", "n", _first().alias("first"), _more().alias("more")).alias("want"))
    per_text = wanted.groupBy("ref").agg(F.collect_list("want").alias("wants"))
    raw = rows.select("ref", F.col("text").cast("binary").alias("raw")).join(per_text, "ref").dropDuplicates(["ref"])
    cut = F.transform("wants", lambda w: F.struct(w["name"].alias("name"), w["string"].alias("string"), w["n"].alias("n"), F.substring("raw", (w["first"] + 1).cast("int"), (w["more"] + LENGTH).cast("int")).alias("content")))
    return raw.select(F.explode(cut).alias("s")).select("s.*")


def _ranges(offsets: np.ndarray) -> list[dict[str, int]]:
    """Runs of consecutive offsets as first and last."""
    if not len(offsets):
        return []
    cut = np.flatnonzero(np.diff(offsets) > 1)
    return [{"first": int(a), "last": int(b)} for a, b in zip(offsets[np.concatenate([[0], cut + 1])], offsets[np.append(cut, len(offsets) - 1)])]


def repeated_in(strings: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """For each string the windows that occur again in the strings; all, if it has several places."""
    sizes = np.array([len(s) + 1 for s in strings])
    starts = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"\xff".join([*strings, b""]), np.uint8).astype(np.int16) + np.int16(2)
    text[text == 257] = 1  # the end of a string
    text = np.append(text, np.int16(0))
    order = suffix_array(text, 258)
    windows = sizes - LENGTH
    at = np.concatenate([np.arange(a, a + w, dtype=index_type(len(text))) for a, w in zip(starts, windows)])
    before, common = permuted_common_prefixes(text, order, at, LENGTH)
    again = np.zeros(len(text), bool)
    again[at[common >= LENGTH]] = True
    again[before[common >= LENGTH]] = True
    return [np.arange(w) if n > 1 else np.flatnonzero(again[a : a + w]) for a, w, n in zip(starts, windows, counts)]


_RANGES = "name bigint, string bigint, ranges array<struct<first:bigint,last:bigint>>"
_RANGE_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def repeats_by_arrays(strings: DataFrame) -> DataFrame:
    """(name, string, ranges) of repeated windows, from suffix arrays of whole names."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for group in key_groups(batches, "name"):
            held.append(group)
            size += group.column("content").nbytes
            if size >= ARRAY_BYTES:
                yield pa.concat_tables(held)
                held, size = [], 0
        if held:
            yield pa.concat_tables(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in arrays(batches):
            found = repeated_in(table.column("content").to_pylist(), table.column("n").to_pylist())
            names, strings_ = (table.column(c).combine_chunks() for c in ("name", "string"))
            ranges = pa.array([_ranges(f) for f in found], _RANGE_TYPE)
            del found
            forget()
            yield pa.RecordBatch.from_arrays([names, strings_, ranges], names=["name", "string", "ranges"])

    return strings.repartition("name").sortWithinPartitions("name").mapInArrow(run, _RANGES)


def repeats_by_counts(strings: DataFrame) -> DataFrame:
    """The same for names with very many strings: windows counted by content, split over all tasks."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "content", 1 << 18):
                names, ids, counts = (batch.column(c).to_numpy() for c in ("name", "string", "n"))
                for i, raw in enumerate(batch.column("content").to_pylist()):
                    sums, down = prefix_sums(np.frombuffer(raw, np.uint8))
                    at = np.arange(len(raw) - LENGTH + 1)
                    window = mix(substring_hashes(sums, down, at, at + LENGTH)).view(np.int64)
                    full = lambda x: np.full(len(at), x, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (full(names[i]), full(ids[i]), at, window, full(counts[i]))], names=["name", "string", "first", "window", "n"])

    each = strings.mapInArrow(windows, "name bigint, string bigint, first bigint, window bigint, n bigint")
    again = each.groupBy("name", "window").agg(F.sum("n").alias("times")).filter(F.col("times") > 1)
    found = each.join(again, ["name", "window"]).groupBy("name", "string").agg(F.collect_set(F.struct("first", F.col("first").alias("last"))).alias("ranges"))
    return found.select("name", "string", "ranges")


def repeated_windows(strings: DataFrame) -> DataFrame:
    """(name, string, ranges) of all contested strings (name, string, n, content)."""
    size = strings.groupBy("name").agg(F.count(F.lit(1)).alias("strings"), F.sum(F.octet_length("content")).alias("bytes"))
    hot = cut_lineage(size.filter((F.col("strings") > HOT_STRINGS) | (F.col("bytes") > HOT_BYTES)).select("name"))
    if hot.isEmpty():
        return repeats_by_arrays(strings)
    return repeats_by_arrays(strings.join(hot, "name", "left_anti")).unionByName(repeats_by_counts(strings.join(hot, "name", "left_semi")))


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(ref, spans): bytes [start, end) that repeated strings cover, of rows (ref, text); unmerged, in no order."""
    runs = cut_lineage(all_runs(rows))
    names = runs.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("string").alias("least"), F.max("string").alias("most"), F.max("inner").alias("inner"))
    open_ = (F.col("least") != F.col("most")) | F.col("inner")
    active = cut_lineage(runs.drop("inner").join(names.filter((F.col("n") > 1) | F.col("inner")).select("name", open_.alias("contested")), "name"))
    contested = active.filter("contested")
    found = cut_lineage(repeated_windows(cut_lineage(contested_strings(contested, rows))).filter(F.size("ranges") > 0))
    span = lambda first, last: F.struct(first.alias("start"), (last + LENGTH).alias("end"))
    settled = active.filter(~F.col("contested")).select("ref", span(_first(), _first() + _more()).alias("span"))
    marked = contested.join(found, ["name", "string"]).select("ref", _first().alias("at"), F.explode("ranges").alias("r"))
    spans = settled.unionByName(marked.select("ref", span(F.col("at") + F.col("r.first"), F.col("at") + F.col("r.last")).alias("span")))
    return spans.groupBy("ref").agg(F.collect_set("span").alias("spans"))


def merged(spans: list[dict[str, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, removed, kept): removed spans of bytes in order, and the bytes that are left."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("ref"), F.col(text).alias("text"))
    spans = repeated_spans(rows.select("ref", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                raws, removed, kept = raw_texts(batch), [], []
                for raw, own in zip(raws, batch.column("spans").to_pylist()):
                    cut = merged(own or [])
                    edges = [0, *(x for span in cut for x in span), len(raw)]
                    removed.append([{"start": a, "end": b} for a, b in cut])
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(r) for r in raws], pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "removed", "kept"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.join(spans, "ref", "left").drop("ref").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary")
