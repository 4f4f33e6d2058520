"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, one scan of each text.

Texts are lower-cased (A-Z) and cut into words; an item's windows are its runs of ``WINDOW``
words, or all its words if they are fewer. Words of the benchmark have numbers, windows are
entered as number sequences, and a document is scanned once as the sequence of its words'
numbers (0 for words that no item has). Every document word inside any occurrence of a
window is hit. Hits map back to code points of the original text.

Items with null or wordless text have no windows; items with a null id hit words but are
not listed. Null texts have no words and are clean. An empty benchmark hits nothing. Rows are
independent; the input's columns stay, and one named like an output is replaced.

The automaton is bounded: a benchmark of more than ``BLOCK_WORDS`` words is handled in
blocks, one scan each, and the hits of the blocks are united.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import raw_texts, resident, schema_with, slices, with_column

WINDOW = 13
BLOCK_WORDS = 400_000
#: One word in so many may be hit in a clean document; that share or more is contamination.
SHARE = 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of words as they are, A-Z lower-cased, all others to a space.
_NORMAL = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_NORMAL).split()


class Scanner:
    """The automaton of some items. ``items``: (id as text or None, text in UTF-8)."""

    def __init__(self, items: tuple[tuple[str | None, bytes], ...], window: int):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, raw in items:
            own = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words(raw))
            for i in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(own[i : i + window], set()).update([] if item is None else [item])
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, ids in found.items():
            self.automaton.add_word(key, (len(key), ids))
        self.automaton.make_automaton()
        self.any = bool(found)

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit runs of word positions [start, end), and the items that occur."""
        own, runs, items = words(raw), [], set()
        if self.any and own:
            get = self.number.get
            for last, (size, ids) in self.automaton.iter(tuple([get(w, 0) for w in own])):
                items |= ids
                start = last + 1 - size
                while runs and runs[-1][1] >= start:  # overlaps and touches: one run
                    start = min(start, runs.pop()[0])
                runs.append((start, last + 1))
        return len(own), runs, items


def blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> list[tuple[tuple[str | None, bytes], ...]]:
    """The items in blocks of at most ``limit`` bytes of text (an item is never cut)."""
    out, size = [[]], 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text)).distinct().coalesce(4).toLocalIterator():
        raw = (row[1] or "").encode()
        if size and size + len(raw) > limit:
            out.append([])
            size = 0
        out[-1].append((row[0], raw))
        size += len(raw)
    return [tuple(b) for b in out]


def original_offsets(text: str, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Code points [start, end) of runs of words in the text as it was."""
    if not runs:
        return []
    at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs]


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Append ``n_words``, ``n_hit``, ``items`` (sorted ids as text), ``spans`` (code points) and ``contaminated``."""
    schema = schema_with(docs, "n_words bigint", "n_hit bigint", "items array<string>", "spans array<struct<start:bigint,end:bigint>>", "runs array<struct<start:bigint,end:bigint>>")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    parts = blocks(benchmark, item, item_text, 8 * block_words)

    def passing(items: tuple, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = resident(Scanner, items, window)
            for whole in batches:
                for batch in slices(whole, text):
                    n, runs, ids, spans = [], [], [], []
                    earlier = [(), ()] if first else [batch.column(c).to_pylist() for c in ("runs", "items")]
                    for i, raw in enumerate(raw_texts(batch, text)):
                        count, own, found = known.scan(raw)
                        if not first:
                            own = united([*own, *((r["start"], r["end"]) for r in earlier[0][i])])
                            found |= set(earlier[1][i])
                        n.append(count)
                        runs.append(own)
                        ids.append(sorted(found))
                        spans.append(original_offsets(raw.decode(), own))
                    yield with_column(
                        batch,
                        n_words=pa.array(n, pa.int64()),
                        n_hit=pa.array([sum(b - a for a, b in r) for r in runs], pa.int64()),
                        items=pa.array(ids, pa.list_(pa.string())),
                        spans=pa.array(spans, span),
                        runs=pa.array([[{"start": a, "end": b} for a, b in r] for r in runs], span),
                    )

        return run

    out = docs
    for i, items in enumerate(parts):
        if i:
            out = cut_lineage(out)  # one automaton at a time in a worker
        out = out.mapInArrow(passing(items, i == 0), schema)
    return out.drop("runs").withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs in order, overlapping and touching ones made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
