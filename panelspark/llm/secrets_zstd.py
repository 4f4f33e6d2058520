"""Secret scans: patterns of known kinds, and strings that zstandard cannot shorten.

The base kinds are patterns. The method adds spans of kind ``novel``: a long string of key
characters with letters and digits, close after a sensitive word and outside the base spans,
whose marginal compressed size is nearly that of random characters of its alphabet although the
compressor is primed with a dictionary of identifiers and the text around the string.
What the surrounding code or the dictionary explains compresses and is left alone; that holds
for a string that stands there itself, too. Strings are judged to their end, however long.

The dictionary holds common identifiers and the ``LEARNT`` most frequent parts of the identifiers,
paths and hosts of all documents, each identifier counted once however often it stands there.
Short strings give zstandard too little to find, so one whose letters and digits are words of the
dictionary for more than half (``getUserById2``, ``src/main/java``) is left alone beforehand.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Rows are
independent; the input's columns stay, and one named like an output is replaced.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident, schema_with, slices, texts, with_column

# The base patterns, the words that announce a secret, and identifiers of everyday code.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
SENSITIVE = re.compile(r"password|passwd|secret|token|api_?key|credential|private_?key|bearer|authorization", re.IGNORECASE | re.ASCII)
HINTS = ("passw", "secret", "token", "api", "credential", "private", "bearer", "authorization")
IDENTIFIERS = (
    "access account address application argument array authorization base boolean buffer bytes cache callback class client "
    "column config configuration connection const container content context count create credential data database date debug "
    "com default delete description directory element email encoding endpoint environment error event example exception export "
    "false file filter float format function get handler header host html http https import index init input instance integer item "
    "iterator java json label length level list local localhost logger main manager message method model module name null number "
    "object offset option org output package page param password path pattern port prefix private process property public query "
    "random record reference request response result return route row schema secret select self server service session "
    "settings size source src start state static status string struct system table target task test text thread time timeout "
    "token true type undefined update url user username utf-8 value variable vector version void width window www"
).split()

KINDS = ("assign", "access", "hex", "novel")
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
#: Code points between a sensitive word and the candidate, and around a candidate as its context.
NEAR, AROUND = 48, 256
#: Marginal bytes per byte of random characters from which a string counts as novel.
NOVELTY = 0.9
#: Sets of characters that a random string draws from; the first that holds a string's letters and digits is taken.
_HEX = (string.digits + "abcdef", string.digits + "ABCDEF")
_BASE32 = ("234567" + string.ascii_lowercase, "234567" + string.ascii_uppercase)
ALPHABETS = tuple(frozenset(a) for a in (*_HEX, *_BASE32, string.digits + string.ascii_lowercase, string.digits + string.ascii_uppercase, string.digits + string.ascii_letters))
#: Characters of random strings that are compressed at most; the size of longer ones is in proportion.
DRAWN = 1 << 14

#: A whole run of key characters that is an identifier of several words, a path or a host, without digits.
IDENTIFIER = r"(?<![A-Za-z0-9+/_.=-])(?:[A-Za-z][a-z]*(?:[A-Z][a-z]+){1,40}|[A-Za-z]+(?:[_./-]+[A-Za-z]+){1,40})(?![A-Za-z0-9+/_=-])"
#: Where identifiers are cut into words.
CUT = r"[_./-]+|(?<=[a-z])(?=[A-Z])"
#: Words that are learnt at most, and in how many different identifiers each must stand.
LEARNT, LEAST_IDENTIFIERS = 2048, 4
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

Span = tuple[str, int, int]


class Known:
    """Words of identifiers, and the bytes that prime the compressor with them; the commonest stand last, nearest to the text."""

    def __init__(self, learnt: tuple[str, ...] = ()):
        self.words = frozenset(IDENTIFIERS) | frozenset(learnt)
        self.primer = " ".join([*reversed(learnt), *IDENTIFIERS]).encode()

    def explains(self, candidate: str) -> bool:
        """True if more than half of the letters and digits stand in words of three letters or more that are known."""
        parts = PART.findall(candidate)
        return 2 * sum(len(p) for p in parts if len(p) > 2 and p.lower() in self.words) > sum(map(len, parts))


COMMON = Known()


def identifier_words(docs: DataFrame, text: str = "text") -> tuple[str, ...]:
    """The words that stand in the most different identifiers of all documents, the commonest first."""
    whole = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)))).alias("whole")).distinct()
    words = whole.select(F.explode(F.array_distinct(F.transform(F.split("whole", CUT), F.lower))).alias("word"))
    counted = words.filter(F.length("word").between(3, 24)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = counted.filter(F.col("n") >= LEAST_IDENTIFIERS).orderBy(F.col("n").desc(), "word").limit(LEARNT)
    return tuple(r["word"] for r in top.collect())


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds by start, then kind.

    Runs of the access and hex kinds are maximal, so asking for their least length in the
    pattern finds the same spans as dropping the short ones.
    """
    low = text.lower()
    found = [("hex", *m.span()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    if any(h in low for h in HINTS[:4]):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _size(raw: bytes, primed=None) -> int:
    """Compressed bytes beyond those of nothing."""
    import zstandard

    size = lambda data: len(zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False).compress(data))
    return size(raw) - size(b"")


@lru_cache(1 << 12)
def _random_size(alphabet: str, n: int) -> int:
    return _size("".join(random.Random(n).choices(alphabet, k=n)).encode())


def random_size(candidate: str) -> float:
    """Compressed bytes of random characters of the candidate's alphabet and length."""
    used = set(candidate)
    plain = {c for c in used if c.isalnum()}
    alphabet = "".join(sorted(next(a for a in ALPHABETS if plain <= a) | used))
    n = min(len(candidate), DRAWN)
    return _random_size(alphabet, n) * len(candidate) / n


def novelty(candidate: str, before: str, after: str, known: Known = COMMON) -> float:
    """Marginal compressed bytes, given identifiers and the text around, per byte of random characters alike."""
    import zstandard

    primed = zstandard.ZstdCompressionDict(known.primer + b" " + after.encode() + b" " + before.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return _size(candidate.encode(), primed) / random_size(candidate)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of key strings with letters and digits that start close after a sensitive word, for each word.

    A run of key characters that many words stand in is read once.
    """
    run_end = digit = letter = 0
    for word in SENSITIVE.finditer(text):
        at, limit = word.end(), word.end() + NEAR
        while (m := CANDIDATE.search(text, at, limit + LEAST)) and m.start() <= limit:
            start = m.start()
            if start >= run_end:
                run_end = CANDIDATE.match(text, start).end()
                digit = max(text.rfind(c, start, run_end) for c in string.digits)
                letter = max(text.rfind(c, start, run_end) for c in string.ascii_letters)
            if digit >= start and letter >= start:
                yield start, run_end
            at = run_end


def novel_spans(text: str, base: list[Span], known: Known = COMMON) -> list[Span]:
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    found, done = [], 0
    for start, end in candidates(text):
        if start < done or any(a < end and start < b for _, a, b in base):
            continue
        done = end
        if known.explains(text[start:end]):
            continue
        if novelty(text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND], known) >= NOVELTY:
            found.append(("novel", start, end))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, text: str = "text", learnt: tuple[str, ...] | None = None) -> DataFrame:
    """Append ``base`` and ``found``: arrays of (kind, start, end), the latter with the novel spans.

    ``learnt`` are words of identifiers as ``identifier_words`` gives them; they are counted in ``docs`` if not given.
    """
    words = identifier_words(docs, text) if learnt is None else learnt
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    shown = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = resident(Known, words)
        for whole in batches:
            for batch in slices(whole, text):
                base, every = [], []
                for t in texts(batch, text):
                    own = base_spans(t)
                    base.append(shown(own))
                    every.append(shown(in_order(own + novel_spans(t, own, known))))
                yield with_column(batch, base=pa.array(base, kind), found=pa.array(every, kind))

    struct = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.mapInArrow(run, schema_with(docs, f"base {struct}", f"found {struct}"))
