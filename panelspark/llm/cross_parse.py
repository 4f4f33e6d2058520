"""Language ID by cross-parsing: the language whose sample needs fewest phrases wins.

Each language has a suffix automaton of the words of its labelled sample. A text is parsed into
phrases: the longest match in the automaton, then on from there; a letter that the sample does not
hold is a phrase of its own. Phrases end at word ends at the latest, which lets a worker keep the
costs of the words it met. Counts are normalised: a phrase costs the bits that name a place in the
language's sample, an unknown letter those of the largest sample, per letter of the text. Ties go
to the language that comes first.

The automata are fitted on a bounded sample: of each language the ``SAMPLE_DOCS`` documents with
the smallest hash of their id are read whole, and their words are taken from the most frequent
down, with ``SAMPLE_LETTERS`` letters in all words of all languages together, shared out evenly.
Every text is judged whole. A null text or one without letters is ``und`` with score 0; so is
every text if no labelled text has letters. The score is the winner's share of the weights that
the languages' normalised counts give. Rows are independent; the input's columns stay, and one
named like an output is replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BEYOND_LATIN1, latin1_pattern, resident, schema_with, slices, with_column

UNDETERMINED = "und"
SAMPLE_DOCS = 200
SAMPLE_LETTERS = 400_000
#: Words whose phrase counts a worker keeps.
KEPT_WORDS = 1 << 16
#: How fast a language's weight falls with its bits per letter above the best.
SHARPNESS = 8.0


FIELD = 44
#: Parts of a bit in which costs are counted.
PARTS = 16
_LATIN1_WORD = latin1_pattern(r"\p{L}+")


@lru_cache(maxsize=1)
def word_pattern():
    import regex

    return regex.compile(r"\p{L}[\p{L}\p{M}]*")


def letters(text: str) -> list[str]:
    """The words of a text, lower-cased."""
    low = text.lower()
    return (_LATIN1_WORD if BEYOND_LATIN1.search(low) is None else word_pattern()).findall(low)


class SuffixAutomaton:
    """All substrings of some words. A state is a dict: character -> the state after it."""

    def __init__(self, words: list[str]):
        self.chars = sum(map(len, words))
        length, link, out = [0], [-1], [{}]
        for word in words:
            last = 0
            for c in word:
                if c in out[last]:
                    q = out[last][c]
                    last = q if length[q] == length[last] + 1 else self._clone(last, c, q, length, link, out)
                    continue
                new = len(length)
                length.append(length[last] + 1)
                link.append(0)
                out.append({})
                p = last
                while p >= 0 and c not in out[p]:
                    out[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = out[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q, length, link, out)
                last = new
        for moves in out:
            for c in moves:
                moves[c] = out[moves[c]]
        self.root: dict[str, dict] = out[0]
        self.known = frozenset(out[0])

    @staticmethod
    def _clone(p: int, c: str, q: int, length: list, link: list, out: list) -> int:
        """A state for the strings of q that end with those of p and c."""
        new = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        out.append(dict(out[q]))
        link[q] = new
        while p >= 0 and out[p].get(c) == q:
            out[p][c] = new
            p = link[p]
        return new

    def phrases(self, word: str) -> int:
        root, n = self.root, 0
        state = root
        for c in word:
            to = state.get(c)
            if to is None:
                if state is not root:
                    n += 1  # the phrase so far ends; this character begins the next
                    to = root.get(c)
                if to is None:
                    n, to = n + 1, root
            state = to
        return n + (state is not root)

    def strange(self, word: str) -> int:
        """Letters that no word of the sample holds."""
        return 0 if self.known.issuperset(word) else sum(c not in self.known for c in word)


class Parser(dict):
    """word -> its letters and its cost in each language, each in a field of ``FIELD`` bits of one integer.

    Sums of such integers give all sums at once. It holds ``KEPT_WORDS`` at most, half of them as ``older`` ones: when the
    newer half is full it takes the place of the older one, and an older word that is met again is a newer one,
    so that frequent words stay known among ever so many rare ones.
    """

    def __init__(self, samples: tuple[tuple[str, tuple[str, ...]], ...]):
        super().__init__()
        self.langs = [lang for lang, _ in samples]
        self.automata = [SuffixAutomaton(list(words)) for _, words in samples]
        self.bits = [round(PARTS * math.log2(max(a.chars, 2))) for a in self.automata]
        self.unknown = [max(self.bits) - b for b in self.bits]
        self.older: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        packed = self.older.get(word)
        if packed is None:
            packed = self.cost(word)
        if 2 * len(self) >= KEPT_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = packed
        return packed

    def cost(self, word: str) -> int:
        packed = len(word)
        for i, a in enumerate(self.automata, 1):
            cost = a.phrases(word) * self.bits[i - 1]
            if self.unknown[i - 1]:
                cost += a.strange(word) * self.unknown[i - 1]
            packed |= cost << FIELD * i
        return packed

    def judge(self, text: str | None) -> tuple[str, float]:
        words = letters(text or "")
        if not words or not self.langs:
            return UNDETERMINED, 0.0
        packed = sum(map(self.__getitem__, words))
        size, *counts = (packed >> FIELD * i & (1 << FIELD) - 1 for i in range(len(self.langs) + 1))
        rates = [n / (PARTS * size) for n in counts]
        best = min(range(len(rates)), key=rates.__getitem__)
        return self.langs[best], 1 / sum(2 ** (SHARPNESS * (rates[best] - r)) for r in rates)


def samples(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[tuple[str, tuple[str, ...]], ...]:
    """For each language the words of its sample, within the stated bounds; a language whose sample has no letter is left out.

    Ids are chosen without reading texts; only the chosen documents' texts are then read, and their words counted in Spark.
    """
    named = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    order = Window.partitionBy(lang).orderBy(F.xxhash64(doc_id), doc_id)
    chosen = named.select(doc_id, lang).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SAMPLE_DOCS).select(doc_id).distinct()
    ids = [r[0] for r in chosen.collect()]
    if not ids:
        return ()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found: dict[str, Counter] = {}
                for name, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                    found.setdefault(name, Counter()).update(letters(t))
                rows = [(name, w, n) for name, words in found.items() for w, n in words.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    read = named.filter(F.col(doc_id).isin(ids)).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    words = read.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.col("n").desc(), F.xxhash64("word"), "word")
    # a word has a letter at least, so no more words than letters can be wanted
    ranked = words.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= SAMPLE_LETTERS)
    filled = ranked.withColumn("size", F.sum(F.length("word")).over(first.rowsBetween(Window.unboundedPreceding, 0)))
    found: dict[str, list] = {}
    for r in filled.filter(F.col("size") <= SAMPLE_LETTERS).orderBy("lang", "rank").collect():
        found.setdefault(r["lang"], []).append(r)
    share = SAMPLE_LETTERS // max(1, len(found))
    return tuple((name, tuple(r["word"] for r in rows if r["size"] <= share)) for name, rows in found.items() if rows[0]["size"] <= share)


def identify(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Append ``lang_pred`` and ``score``; the automata learn from ``labelled`` alone."""
    known = samples(labelled, doc_id, text, lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = resident(Parser, known).judge
        for whole in batches:
            for batch in slices(whole, text):
                found = [judge(t) for t in batch.column(text).to_pylist()]
                yield with_column(batch, lang_pred=pa.array([f[0] for f in found], pa.string()), score=pa.array([f[1] for f in found], pa.float64()))

    return docs.mapInArrow(run, schema_with(docs, "lang_pred string", "score double"))
