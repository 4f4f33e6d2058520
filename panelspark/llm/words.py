"""Words of many texts as 64-bit hashes, found and hashed with array operations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import SPACE, forget

#: Bytes that are hashed at once; a chunk ends at white space, so a longer word makes a longer one.
CHUNK = 1 << 18
#: Bytes of a word whose random numbers are kept in a table.
_TABLE_BYTES = 64
_SEED = 0x9FB21C651E98DF25
_IS_SPACE = np.isin(np.arange(256), list(SPACE))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _drawn(place: np.ndarray) -> np.ndarray:
    """A random number for each (position in the word, byte), packed into one."""
    return mix(mix(place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(_SEED)))


_TABLE = _drawn(np.arange(_TABLE_BYTES << 8, dtype=np.uint64))


def hashed_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of the random numbers of a word's bytes at their positions, mixed with its length.

    Numbers of different positions have nothing in common, so words that are built of the same
    parts in another order do not meet by their structure, as they do with powers of a base modulo 2**64.
    """
    size = end - start
    if not len(size):
        return np.empty(0, np.uint64)
    first = np.cumsum(size) - size
    total = int(size.sum())
    inside = np.arange(total) - np.repeat(first, size)
    place = inside << 8 | buf[np.repeat(start, size) + inside]
    long = inside >= _TABLE_BYTES
    drawn = _TABLE[np.where(long, 0, place)] if long.any() else _TABLE[place]
    drawn[long] = _drawn(place[long].astype(np.uint64))
    return mix(np.add.reduceat(drawn, first) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Words:
    """Words of some texts, text after text. ``first[i]`` and ``first[i + 1]`` bound those of text i."""

    hashes: np.ndarray
    first: np.ndarray
    heads: np.ndarray
    tails: np.ndarray


def _chunks(data: bytes) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(data):
        stop = min(start + CHUNK, len(data))
        while stop < len(data) and data[stop] not in SPACE:
            stop += 1
        yield start, stop
        start = stop


def words_of(raws: list[bytes]) -> Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each text with A-Z lower-cased.

    ``heads`` and ``tails`` are codes of the first two and the last three bytes of each word.
    """
    forget()
    data = b" ".join([*raws, b""]).lower()
    found: list[tuple[np.ndarray, ...]] = []
    for a, b in _chunks(data):
        buf = np.frombuffer(data, np.uint8, b - a, a)
        space = np.concatenate([[True], _IS_SPACE[buf], [True]])
        edge = np.flatnonzero(space[1:] != space[:-1])
        start, end = edge[::2], edge[1::2]
        size = end - start
        h = hashed_words(buf, start, end)
        wide = buf.astype(np.uint32)
        head = wide[start] << 8 | np.where(size > 1, wide[np.minimum(start + 1, len(buf) - 1)] if len(buf) else 0, 0)
        tail = wide[end - 1] | np.where(size > 1, wide[end - 2], 0) << 8 | np.where(size > 2, wide[np.maximum(end - 3, 0)], 0) << 16
        found.append((h, start + a, head, tail))
    hashes, starts, heads, tails = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.uint32))
    begins = np.cumsum([0, *(len(r) + 1 for r in raws)])
    return Words(hashes, np.searchsorted(starts, begins), heads, tails)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of fewer words, all as one."""
    n = min(size, len(hashes))
    if not n:
        return np.empty(0, np.uint64)
    h = np.full(len(hashes) - n + 1, n, np.uint64)
    for i in range(n):
        h = mix(h + hashes[i : len(hashes) - n + 1 + i])
    return np.unique(h)


def key_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, of batches in which equal keys stand together."""
    forget()
    pending: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if pending and keys[a] != last:
                yield pa.Table.from_batches(pending)
                pending = []
            pending.append(batch.slice(a, b - a))
            last = keys[a]
    if pending:
        yield pa.Table.from_batches(pending)
