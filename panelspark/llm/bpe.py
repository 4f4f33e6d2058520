"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (base64 token and rank per line) becomes a tokenizers model: each byte is shown as
one printable character, each token of two or more bytes gets the merge that byte-pair merging
makes from its lower-ranked parts, and the split pattern isolates the pieces that are merged
separately. A piece that is itself a token is taken whole.

Pieces repeat throughout a
corpus, so each worker keeps the ids and offsets of the pieces it met last and the library
encodes only the others, in batches.

Null and empty texts give no tokens. Memory follows ``SLICE_BYTES`` and the longest text. The
columns of the input stay (one of the same name as an output is replaced), rows are
independent, and ties and repeated rows need no rule.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BEYOND_LATIN1, latin1_pattern, resident, schema_with, slices, texts, with_column

#: Pieces whose ids a worker keeps.
KEPT_PIECES = 1 << 17


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The character that shows each byte: itself if printable, else one from 256 upward."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown, free = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in shown:
            shown[b], free = chr(free), free + 1
    return [shown[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge gives the token; None if lower ranks don't leave two parts."""
    own, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, i = min((ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= own:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def library_tokenizer(path: str):
    """A tokenizers object that merges one piece by the ranks of the file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    ranks, shown = read_ranks(path), byte_characters()
    show = lambda token: "".join(shown[b] for b in token)
    merges = [last_merge(t, ranks) for t in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__)]
    out = Tokenizer(models.BPE(vocab={show(t): r for t, r in ranks.items()}, merges=[(show(a), show(b)) for a, b in filter(None, merges)], ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    out.decoder = decoders.ByteLevel()
    return out


@lru_cache(maxsize=4)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """The pieces of a text. The library's own split is used where Unicode versions may differ."""
    from tokenizers import Regex, pre_tokenizers

    split, library = latin1_pattern(pattern).findall, pre_tokenizers.Split(Regex(pattern), "isolated")

    def pieces(text: str) -> list[str]:
        if BEYOND_LATIN1.search(text) is None:
            return split(text)
        return [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]

    return pieces


class Pieces(dict):
    """piece -> its ids as packed 32-bit integers; emptied when it holds ``KEPT_PIECES``."""

    def __init__(self, path: str):
        super().__init__()
        self.library, self.begins = library_tokenizer(path), byte_table(path)[1]

    def learn(self, pieces: set[str]) -> None:
        new = list(pieces.difference(self))
        if len(self) + len(new) > KEPT_PIECES:
            self.clear()
            new = list(pieces)
        for piece, e in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False)):
            ids = e.ids
            self[piece] = pack(f"<{len(ids)}i", *ids)


def encode_texts(values: list[str], path: str, pattern: str) -> list[np.ndarray]:
    """The ids of each text."""
    split, known = splitter(pattern), resident(Pieces, path)
    cut = [split(v) for v in values]
    known.learn(set(chain.from_iterable(cut)))
    return [np.frombuffer(b"".join(map(known.__getitem__, own)), np.int32) for own in cut]


def character_offsets(text: str, ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The code points [start, end) of each token; tokens that share a split character all carry it whole."""
    begins = resident(Pieces, path).begins
    ends = np.cumsum(begins[ids + 1] - begins[ids])
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    character = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
    return character[starts].astype(np.int32), (character[ends - 1] + 1).astype(np.int32)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.empty(0, np.int32), type=kind))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = True) -> DataFrame:
    """Append ``ids`` and, if asked for, ``starts`` and ``ends``: the code points each token covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                values = texts(batch, text)
                ids = encode_texts(values, path, pattern)
                new = {"ids": lists(ids, pa.int32())}
                if offsets:
                    spans = [character_offsets(v, i, path) for v, i in zip(values, ids)]
                    new |= {"starts": lists([s for s, _ in spans], pa.int32()), "ends": lists([e for _, e in spans], pa.int32())}
                yield with_column(batch, **new)

    return docs.mapInArrow(run, schema_with(docs, "ids array<int>", *(["starts array<int>", "ends array<int>"] if offsets else [])))


def byte_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes in one array, and where each id's bytes begin."""
    ranks = read_ranks(path)
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)])


def decode_ids(flat: np.ndarray, ends: np.ndarray, path: str) -> pa.Array:
    """Binary values of the id lists that ``ends`` marks in ``flat``."""
    table, begins = resident(byte_table, path)
    first, size = begins[flat], begins[flat + 1] - begins[flat]
    out = np.cumsum(np.concatenate([[0], size]))
    where = np.arange(out[-1]) + np.repeat(first - out[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(out[ends].astype(np.int32)), pa.py_buffer(table[where])])


def decode(encoded: DataFrame, path: str, ids: str = "ids", drop_ids: bool = False) -> DataFrame:
    """Append ``decoded`` (the bytes), ``decoded_text`` and ``ids_le`` (ids as little-endian 32-bit integers).

    Bytes of a character that was split between tokens meet again in ``decoded``; in
    ``decoded_text`` an incomplete one shows as the replacement character. Null ids give nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                lengths = np.array(batch.column(ids).value_lengths().fill_null(0))
                flat, ends = np.asarray(batch.column(ids).flatten(), dtype=np.int64), np.cumsum(np.concatenate([[0], lengths]))
                got = decode_ids(flat, ends, path)
                packed = flat.astype("<u4").tobytes()
                new = {"decoded": got, "decoded_text": pa.array([b.decode("utf-8", "replace") for b in got.to_pylist()], pa.string()), "ids_le": pa.array([packed[4 * a : 4 * b] for a, b in zip(ends, ends[1:])], pa.binary())}
                out = with_column(batch, **new)
                yield out.drop_columns([ids]) if drop_ids else out

    return encoded.mapInArrow(run, schema_with(encoded, "decoded binary", "decoded_text string", "ids_le binary", drop=(ids,) if drop_ids else ()))
