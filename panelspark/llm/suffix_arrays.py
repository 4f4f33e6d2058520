"""Suffix arrays by induced sorting, and permuted common prefixes, with array operations."""

from __future__ import annotations

import numpy as np

_OF_BYTE = np.random.Generator(np.random.PCG64(20240917)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9FB21C651E98DF25
#: Powers that are kept at least.
_KEPT = (1 << 20) + 4096
#: Suffixes whose common prefixes are sought at once.
COMPARED = 1 << 16


class _Powers:
    """Powers of the base and of its inverse, modulo 2**64, as far as they were needed.

    Short substrings only may be told apart by them: from 1,024 bytes on, texts of two letters in
    an order without repetition meet for every base.
    """

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, _KEPT)
            fill = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]))
            self.up, self.down = fill(_BASE), fill(pow(_BASE, -1, 1 << 64))
        return self.up[:n], self.down


_POWERS = _Powers()


def index_type(n: int) -> type:
    """The type of places in a text of ``n`` symbols; half as wide where that is enough."""
    return np.int32 if n < 1 << 31 else np.int64


def prefix_sums(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the hash of any substring follows, and the factors that make it free of its place."""
    up, down = _POWERS.to(len(text))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_OF_BYTE[text & 0xFF] * up)]), down


def substring_hashes(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * down[start]


def smaller_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the sentinel at the end counts as smaller."""
    n = len(text)
    settled = np.where(text[:-1] != text[1:], np.arange(n - 1, dtype=index_type(n)), index_type(n)(n))
    settled = np.minimum.accumulate(settled[::-1])[::-1]
    return np.concatenate([(text[:-1] < text[1:])[np.minimum(settled, n - 2)], [True]])


class _Buckets:
    """Suffixes that wait in the bucket of their first symbol, in order of arrival."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.text, self.waiting = text, [[] for _ in range(symbols)]

    def deal(self, suffixes: np.ndarray) -> None:
        if len(suffixes):
            first = self.text[suffixes]
            order = np.argsort(first, kind="stable")
            suffixes, first = suffixes[order], first[order]
            cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
            for symbol, part in zip(first[np.concatenate([[0], cuts])].tolist(), np.split(suffixes, cuts)):
                self.waiting[symbol].append(part)

    def take(self, symbol: int) -> np.ndarray:
        parts, self.waiting[symbol] = self.waiting[symbol], []
        return np.concatenate(parts) if parts else np.empty(0, np.int32)


def _induced(text: np.ndarray, smaller: np.ndarray, symbols: int, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes, induced from leftmost-smaller ones in the given order.

    Larger suffixes are induced from left to right, smaller ones from right to left. A bucket's
    suffixes that induce others in the same bucket are handled wave by wave.
    """

    def swept(buckets: _Buckets, symbol: int, kind: bool) -> np.ndarray:
        done, wave = [], buckets.take(symbol)
        while len(wave):
            done.append(wave)
            before = wave[wave > 0] - 1
            before = before[smaller[before] == kind]
            here = text[before] == symbol
            buckets.deal(before[~here])
            wave = before[here]
        return np.concatenate(done) if done else np.empty(0, np.int32)

    def induce(buckets: _Buckets, suffixes: np.ndarray, kind: bool) -> None:
        before = suffixes[suffixes > 0] - 1
        buckets.deal(before[smaller[before] == kind])

    seeds, larger, small = _Buckets(text, symbols), _Buckets(text, symbols), _Buckets(text, symbols)
    seeds.deal(leftmost)
    of_larger = []
    for symbol in range(symbols):
        of_larger.append(swept(larger, symbol, False))
        induce(larger, seeds.take(symbol), False)
    small.deal(np.array([len(text) - 1], leftmost.dtype))
    out = []
    for symbol in reversed(range(symbols)):
        out.append(swept(small, symbol, True))
        out.append(of_larger[symbol][::-1])
        induce(small, out[-1], True)
    return np.concatenate(out)[::-1]


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Suffixes in order. ``text`` ends with its only 0; other values lie below ``symbols``.

    The leftmost-smaller substrings are sorted by inducing and named; pairs of neighbouring
    names are named again until all differ, which orders the leftmost-smaller suffixes. These
    induce the rest.
    """
    smaller = smaller_types(text)
    is_leftmost = np.concatenate([[False], smaller[1:] & ~smaller[:-1]])
    places = np.flatnonzero(is_leftmost).astype(index_type(len(text)))
    first = _induced(text, smaller, symbols, places)
    ordered = first[is_leftmost[first]]
    sums, down = prefix_sums(text)
    number = np.empty(len(text), places.dtype)
    number[places] = np.arange(len(places))
    end = np.append(places[1:] + 1, places.dtype.type(len(text)))[number[ordered]]
    hashes = substring_hashes(sums, down, ordered, end)
    del sums, first
    new = (hashes[1:] != hashes[:-1]) | (np.diff(end - ordered) != 0)
    name = np.empty(len(places), np.int64)
    name[number[ordered]] = np.concatenate([[1], 1 + np.cumsum(new)])
    reach = 1
    while reach < len(name) and name.max() < len(name):
        after = np.zeros(len(name), np.int64)
        after[:-reach] = name[reach:]
        name = np.unique(name * (len(name) + 1) + after, return_inverse=True)[1] + 1
        reach *= 2
    return _induced(text, smaller, symbols, places[np.argsort(name)])


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, at: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes ``at`` (in order of the text): the one before in the array, and the common prefix up to ``limit``.

    Only pairs with ``limit`` symbols left are compared; the others get 0.
    """
    sums, down = prefix_sums(text)
    before = np.full(len(text), -1, order.dtype)
    before[order[1:]] = order[:-1]
    other, common = before[at], np.zeros(len(at), at.dtype)
    for i in range(0, len(at), COMPARED):
        mine, theirs = at[i : i + COMPARED], other[i : i + COMPARED]
        fits = (theirs >= 0) & (np.maximum(theirs, mine) <= len(text) - limit)
        a, b = mine[fits], theirs[fits]
        have = np.zeros(len(a), at.dtype)
        step = 1 << (limit.bit_length() - 1)
        while step:
            start, stop = have, np.minimum(have + step, limit)
            same = substring_hashes(sums, down, a + start, a + stop) == substring_hashes(sums, down, b + start, b + stop)
            have = np.where(same, stop, have)
            step >>= 1
        common[i : i + COMPARED][fits] = have
    return other, common
