"""Language-model scores from Brown class bigrams that exchange clustering learns.

The model gives a token the probability of its class after the class before it, times that
of the token within its class; both are smoothed by adding one. Tokens are the words of a
text with A-Z lower-cased, then one end; the end also stands before the first word.

Word counts, class transitions and emissions come from all training texts. Classes are
learnt for units: each of the ``FREQUENT`` most frequent words is a unit, the other words share
units by their spelling (first two, last three bytes), so that every word has a class
and the units stay bounded. A sweep counts, over the whole corpus, how often each unit has
each class before and after it; the exchange then moves one unit after the other to
the class that gains most likelihood, with the class transitions kept up to date. What reaches
the driver is bounded by units times classes.

Counts of frequent words go to the tasks with the model (``FREQUENT`` entries); those of the
other words, which grow with the corpus, are joined. Words are known by 64-bit hashes.

Null and empty texts are scored as their end alone. Without training texts all counts are 0.
Rows are independent: repeated rows and ties need no rule. Of the input only id, text and
the training flag are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import raw_texts, slices
from .words import mix, words_of

FREQUENT, SPELLINGS, CLASSES, SWEEPS = 1 << 16, 1 << 14, 32, 2
UNITS = FREQUENT + SPELLINGS
#: Units of one block of the counts, and tokens that a task counts at once.
BLOCK, HELD = 1024, 1_000_000
END = np.uint64(0xE5D0000000000001)


@dataclass
class Tokens:
    """Tokens of some texts, each text ending with its end."""

    hashes: np.ndarray
    spellings: np.ndarray
    starts: np.ndarray


def tokens_of(raws: list[bytes]) -> Tokens:
    words = words_of(raws)
    ends = words.first[1:]
    spelling = (mix(words.heads.astype(np.uint64) << np.uint64(24) | words.tails) % np.uint64(SPELLINGS)).astype(np.int64)
    return Tokens(np.insert(words.hashes, ends, END), np.insert(spelling, ends, 0), words.first[:-1] + np.arange(len(raws)))


def _summed(hashes: list[np.ndarray], spellings: list[np.ndarray]) -> pa.RecordBatch:
    word, at, n = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.concatenate(spellings)[at]), pa.array(n)], names=["word", "spelling", "n"])


def word_counts(training: DataFrame) -> DataFrame:
    """(word, spelling, n) of rows (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, spellings, size = [], [], 0
        for whole in batches:
            for batch in slices(whole):
                t = tokens_of(raw_texts(batch))
                hashes.append(t.hashes)
                spellings.append(t.spellings)
                size += len(t.hashes)
                if size >= HELD:
                    yield _summed(hashes, spellings)
                    hashes, spellings, size = [], [], 0
        if size:
            yield _summed(hashes, spellings)

    parts = training.select("text").mapInArrow(run, "word bigint, spelling bigint, n bigint")
    return parts.groupBy("word").agg(F.min("spelling").alias("spelling"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Frequent words in order of their hashes, with their counts and units."""

    words: np.ndarray
    counts: np.ndarray

    def look_up(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """The unit of each token, and its place among the frequent words or -1."""
        if not len(self.words):
            return FREQUENT + t.spellings, np.full(len(t.hashes), -1)
        at = np.minimum(np.searchsorted(self.words, t.hashes), len(self.words) - 1)
        known = self.words[at] == t.hashes
        return np.where(known, at, FREQUENT + t.spellings), np.where(known, at, -1)


def frequent_words(counts: DataFrame, frequent: int = FREQUENT) -> Vocabulary:
    rows = counts.select("word", "n").orderBy(F.desc("n"), "word").limit(min(frequent, FREQUENT)).collect()
    words = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(words)
    return Vocabulary(words[order], np.array([r[1] for r in rows], np.int64)[order])


def neighbour_classes(training: DataFrame, vocabulary: Vocabulary, classes: np.ndarray) -> np.ndarray:
    """How often each unit stands before (first half of a row) and after (second half) each class.

    Tasks count into a matrix of units by classes and send its blocks compressed; sums are
    taken block by block as the parts arrive, so no task holds more than its blocks.
    """
    import zstandard

    width = 2 * CLASSES

    def blocks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for i in range(0, len(total), BLOCK):
            part = total[i : i + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK], pa.int32()), pa.array([pack(part.tobytes())], pa.binary())], names=["block", "part"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(UNITS * width, np.int32)
        end = vocabulary.look_up(Tokens(np.array([END]), np.array([0]), np.array([0])))[0]
        for whole in batches:
            for batch in slices(whole):
                unit = np.concatenate([end, vocabulary.look_up(tokens_of(raw_texts(batch)))[0]])
                own = classes[unit].astype(np.int64)
                np.add.at(total, unit[:-1] * width + own[1:], 1)
                np.add.at(total, unit[1:] * width + CLASSES + own[:-1], 1)
        yield from blocks(total.reshape(UNITS, width))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist()):
                got = np.frombuffer(unpack(part), np.int32)
                sums[block] = sums[block] + got if block in sums else got.astype(np.int64)
        pack = zstandard.ZstdCompressor(level=1).compress
        for block, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pack(total.tobytes())], pa.binary())], names=["block", "part"])

    kind = "block int, part binary"
    summed = training.select("text").mapInArrow(count, kind).repartition("block").mapInArrow(add, kind)
    out = np.zeros((UNITS, width), np.int64)
    for block, part in summed.collect():  # UNITS / BLOCK rows, compressed
        got = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(part)), np.int64).reshape(-1, width)
        out[block * BLOCK : block * BLOCK + len(got)] = got
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(classes: np.ndarray, neighbours: np.ndarray) -> np.ndarray:
    """One sweep: each unit, most frequent first, moves to the class that gains most likelihood."""
    after, before = neighbours[:, :CLASSES].astype(float), neighbours[:, CLASSES:].astype(float)
    times = after.sum(axis=1)
    table = np.zeros((CLASSES, CLASSES))
    np.add.at(table, classes, after)
    out = classes.copy()
    for u in np.argsort(-times, kind="stable"):
        if not times[u]:
            break
        a, row, column = out[u], after[u], before[u]
        table[a] -= row
        table[:, a] -= column
        np.maximum(table, 0, out=table)
        rows, columns = table.sum(axis=1), table.sum(axis=0)
        gain = (_xlogx(table + row) - _xlogx(table)).sum(axis=1) + (_xlogx(table + column[:, None]) - _xlogx(table)).sum(axis=0)
        gain -= _xlogx(rows + row.sum()) - _xlogx(rows) + _xlogx(columns + column.sum()) - _xlogx(columns)
        best = int(gain.argmax())
        best = a if gain[a] >= gain[best] else best
        table[best] += row
        table[:, best] += column
        out[u] = best
    return out


@dataclass
class Model:
    vocabulary: Vocabulary
    classes: np.ndarray
    transition: np.ndarray  # log10 probability of a class after a class
    emission: np.ndarray  # log10 of what a word's count plus one is divided by, for each class
    tokens: int
    words: int


def fit(training: DataFrame, frequent: int = FREQUENT) -> tuple[Model, DataFrame]:
    """The model of rows (text), and the counts of its words."""
    counts = cut_lineage(word_counts(training))
    vocabulary = frequent_words(counts, frequent)
    units = np.arange(UNITS, dtype=np.uint64)
    classes = (mix(units) % np.uint64(CLASSES)).astype(np.uint8)
    for _ in range(SWEEPS):
        classes = exchange(classes, neighbour_classes(training, vocabulary, classes))
    last = neighbour_classes(training, vocabulary, classes)
    table = np.zeros((CLASSES, CLASSES))
    np.add.at(table, classes, last[:, :CLASSES].astype(float))
    transition = np.log10((table + 1) / (table.sum(axis=1, keepdims=True) + CLASSES))

    tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
    np.add.at(tokens, classes[: len(vocabulary.words)], vocabulary.counts)
    np.add.at(words, classes[: len(vocabulary.words)], 1)
    hot = counts.sparkSession.createDataFrame([(int(w),) for w in vocabulary.words.view(np.int64)], "word bigint")
    rare = counts.join(hot, "word", "left_anti").groupBy("spelling").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
    for r in rare:  # at most SPELLINGS rows
        tokens[classes[FREQUENT + r["spelling"]]] += r["n"]
        words[classes[FREQUENT + r["spelling"]]] += r["words"]
    return Model(vocabulary, classes, transition, np.log10(tokens + words + 1), int(tokens.sum()), int(words.sum())), counts


def _tails(doc: np.ndarray, word: np.ndarray, docs: int) -> pa.Array:
    """For each document its rare words with their numbers."""
    order = np.lexsort((word, doc))
    doc, word = doc[order], word[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])]) if len(doc) else np.empty(0, bool)
    at = np.flatnonzero(new)
    values = pa.StructArray.from_arrays([pa.array(word[at].view(np.int64)), pa.array(np.diff(np.append(at, len(doc))))], names=["word", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[at], np.arange(docs + 1)).astype(np.int32)), values)


def _partial_scores(rows: DataFrame, model: Model) -> DataFrame:
    """What follows without the rare words' counts, and those words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = np.log10(model.vocabulary.counts + 1.0)
        end_class = model.classes[model.vocabulary.look_up(Tokens(np.array([END]), np.array([0]), np.array([0])))[0]]
        for whole in batches:
            for batch in slices(whole):
                t = tokens_of(raw_texts(batch))
                unit, place = model.vocabulary.look_up(t)
                own = model.classes[unit]
                by_class = model.transition[np.concatenate([end_class, own[:-1]]), own] - model.emission[own]
                seen = place >= 0
                size = np.diff(np.append(t.starts, len(unit)))
                doc = np.repeat(np.arange(batch.num_rows), size)
                per_text = lambda x: pa.array(np.add.reduceat(x, t.starts))
                numerators = np.where(seen, log[place] if len(log) else 0.0, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("doc_id", "training", "row")), pa.array(size.astype(np.int64)), per_text(seen.astype(np.int64)), per_text(numerators), per_text(by_class), _tails(doc[~seen], t.hashes[~seen], batch.num_rows)],
                    names=["doc_id", "training", "row", "n_tokens", "known", "numerators", "by_class", "rare"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, training boolean, row bigint, n_tokens bigint, known bigint, numerators double, by_class double, rare array<struct<word:bigint,n:bigint>>")


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", training: str = "training", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, training, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row.

    The model learns from the rows whose ``training`` column is true.
    """
    model, counts = fit(docs.filter(F.col(training)).select(F.col(text).alias("text")), frequent)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(training, F.lit(False)).alias("training"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    parts = cut_lineage(_partial_scores(rows, model))
    rare = parts.select("row", F.explode("rare").alias("w")).select("row", "w.word", "w.n")
    found = rare.join(counts.select("word", F.col("n").alias("count")), "word").groupBy("row").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("count") + 1)).alias("rare_log"))
    whole = parts.drop("rare").join(found, "row", "left")
    numerators = F.col("numerators") + F.coalesce("rare_log", F.lit(0.0))
    total = numerators + F.col("by_class")
    return whole.select(
        "doc_id",
        "training",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (numerators - F.col("n_tokens") * F.log10(F.lit(float(model.tokens + model.words + 1)))).alias("base_score"),
        total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )
