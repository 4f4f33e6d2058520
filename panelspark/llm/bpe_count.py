"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made.

A tokenizer file of the tokenizers library (byte-level BPE) gives the merge ranks, the split
pattern of the byte-level pre-tokenizer and the added tokens. Special strings inside a text
count as the library takes them: one token each. For every other piece the lowest-rank adjacent
pair is popped from a heap and merged in a linked list until none is left; the count is the
number of initial symbols minus the merges.

Null and empty texts have no tokens. Rows are independent; the input's columns stay, and one
named like an output is replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import byte_characters
from .common import BEYOND_LATIN1, latin1_pattern, resident, schema_with, slices, texts, with_column

#: Fixed value: the pattern of the byte-level pre-tokenizer.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose counts a worker keeps.
KEPT_PIECES = 1 << 18


class PieceCounts(dict):
    """piece -> number of tokens, found on first use; emptied when it holds ``KEPT_PIECES``."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, before = told["model"], told["pre_tokenizer"]
        simple = before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and told["normalizer"] is None
        if model["type"] != "BPE" or not simple or model.get("unk_token") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("a plain byte-level BPE file is needed")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        number = {token: i for i, token in enumerate(model["vocab"])}
        # symbols are small numbers here; they name the parts of a merge and never leave this object
        self.merges = {(number[a], number[b]): (rank, number[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.symbol = [number[c] for c in byte_characters()]
        if any(a[k] for a in told["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("added tokens with options are not supported")
        added = sorted((a["content"] for a in told["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.split, self.library = latin1_pattern(BYTE_LEVEL_PATTERN).findall, Tokenizer.from_file(path).pre_tokenizer

    def __missing__(self, piece: str) -> int:
        if len(self) >= KEPT_PIECES:
            self.clear()
        self[piece] = n = self.merged(piece.encode())
        return n

    def merged(self, piece: bytes) -> int:
        """Symbols left after popping the lowest-rank adjacent pair again and again."""
        merges, symbols = self.merges, [self.symbol[b] for b in piece]
        after, before = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
        heap = [(*found, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (found := merges.get(pair))]
        heapify(heap)
        count = len(symbols)
        while heap:
            rank, made, i = heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j < 0 or merges.get((symbols[i], symbols[j])) != (rank, made):
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = made, -1
            count -= 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get((made, symbols[k])):
                    heappush(heap, (*found, i))
            if (h := before[i]) >= 0 and (found := merges.get((symbols[h], made))):
                heappush(heap, (*found, h))
        return count

    def plain(self, text: str) -> int:
        if BEYOND_LATIN1.search(text) is None:
            return sum(map(self.__getitem__, self.split(text)))
        return sum(self[text[a:b]] for _, (a, b) in self.library.pre_tokenize_str(text))

    def of(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


def count_tokens(docs: DataFrame, path: str, limit: int, text: str = "text") -> DataFrame:
    """Append ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = resident(PieceCounts, path)
        for whole in batches:
            for batch in slices(whole, text):
                values = texts(batch, text)
                n = [counts.of(v) for v in values]
                yield with_column(batch, n_bytes=pa.array([len(v.encode()) for v in values], pa.int64()), n_tokens=pa.array(n, pa.int64()), over_limit=pa.array([x > limit for x in n], pa.bool_()))

    return docs.mapInArrow(run, schema_with(docs, "n_bytes bigint", "n_tokens bigint", "over_limit boolean"))
