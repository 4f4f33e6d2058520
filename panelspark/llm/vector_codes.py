"""Product codes of vectors, learnt and assigned with whole numbers.

Each component x becomes floor(1024 * x). A vector is cut into ``parts`` consecutive parts, each
with a codebook that starts as that part of the vectors with the smallest ids. A round assigns
every part to its nearest entry and replaces each used entry by the floor of the mean.

The vectors of a part are sorted along a Hilbert curve and stored once in flat blocks with their
box (least and largest value of each component) and sums. In a round, a block compares its box
with the entries: an entry whose least distance to the box is beyond the least of the largest
distances cannot be nearest to any row, so only the others are looked at. One entry left takes the
block's sums as they are; else the rows' distances are computed exactly, in 53-bit floats
where all sums fit them and in 64-bit integers where not.

Tasks read blocks and send at most one row for each entry; the driver holds the codebooks only.
Blocks are cut from ranges of (part, Hilbert number, row number), so equal vectors spread over
tasks like others.

Rules: rows whose vector is null or holds a null or a component that is not finite are dropped. The
dimension is that of most rows left, the larger of two. Rows of another dimension, and rows with a
component beyond ``limit``, cannot be coded: they stay with a null code and error and take no part.
Where the dimension is no multiple of ``parts``, parts differ by one component. Of rows with one
id, the lesser vector comes first; null ids come last. With fewer rows than entries, codebooks are
smaller. An empty table stays empty. A column named like an output (``code``, ``error``) is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import forget

SCALE = 1024
#: Rows of a block.
BLOCK = 256
#: Bits of a Hilbert number.
KEY_BITS = 62


@dataclass(frozen=True)
class Shape:
    """Dimension and parts of the vectors."""

    dimension: int
    parts: int

    def bounds(self, part: int) -> tuple[int, int]:
        return self.dimension * part // self.parts, self.dimension * (part + 1) // self.parts

    @property
    def limit(self) -> int:
        """Largest magnitude of a component with which no distance or block sum leaves 64 bits."""
        return 1 << (60 - max(1, self.dimension).bit_length()) // 2


def hilbert_keys(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Numbers of rows along a Hilbert curve over a grid of equal cells between ``low`` and ``high``.

    All components share ``KEY_BITS``; beyond as many components the first ones decide.
    """
    x, low, high = x[:, :KEY_BITS], low[:KEY_BITS], high[:KEY_BITS]
    n = x.shape[1]
    if not n:
        return np.zeros(len(x), np.int64)
    bits = max(1, min(16, KEY_BITS // n))
    cells = ((x - low) * (1 << bits) // np.maximum(high - low + 1, 1)).astype(np.int64).T.copy()
    # from the coordinates to the transposed number: undo excess work, then take the Gray code
    q = 1 << bits - 1
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (cells[i] & q) != 0
            swap = np.where(flip, 0, (cells[0] ^ cells[i]) & p)
            cells[0] ^= np.where(flip, p, swap)
            if i:
                cells[i] ^= swap
        q >>= 1
    for i in range(1, n):
        cells[i] ^= cells[i - 1]
    gray, q = np.zeros(cells.shape[1], np.int64), 1 << bits - 1
    while q > 1:
        gray ^= np.where(cells[n - 1] & q, q - 1, 0)
        q >>= 1
    cells ^= gray
    key = np.zeros(cells.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (cells[i] >> b & 1)
    return key


def shortlist(entries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Ascending indexes of the entries that may be nearest to a row in the box."""
    under, over = low - entries, entries - high
    near = np.maximum(np.maximum(under, over), 0)
    far = np.maximum(np.abs(entries - low), np.abs(high - entries))
    least, most = (near * near).sum(1), (far * far).sum(1)
    return np.flatnonzero(least <= most.min(initial=np.iinfo(np.int64).max))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry (the first of several) and the squared distance, exactly."""
    top = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * top * top < 1 << 53 else np.int64
    x, c = x.astype(kind), entries.astype(kind)
    distance = (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T)
    best = distance.argmin(1)
    return best, distance[np.arange(len(x)), best].astype(np.int64)


def assign(block: dict, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each row of a block."""
    x = block["rows"]
    chosen = shortlist(entries, block["low"], block["high"])
    best, distance = nearest(x, entries[chosen])
    return chosen[best], distance


def entry_sums(block: dict, entries: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(entry, rows, sums) of a block's rows."""
    chosen = shortlist(entries, block["low"], block["high"])
    if len(chosen) == 1:
        yield int(chosen[0]), len(block["rows"]), block["sums"]
        return
    best, _ = nearest(block["rows"], entries[chosen])
    order = np.argsort(best, kind="stable")
    used, first = np.unique(best[order], return_index=True)
    totals = np.add.reduceat(block["rows"][order], first, axis=0)
    for entry, n, total in zip(chosen[used], np.diff([*first, len(order)]), totals):
        yield int(entry), int(n), total


_BLOCK = "part int, width int, low binary, high binary, sums binary, ids binary, vectors binary"


def _vectors(batch: pa.RecordBatch, column: str, width: int, kind: type) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, width)


def _blocks_of(batch: pa.RecordBatch) -> Iterator[tuple[int, dict]]:
    """(part, block) of rows of ``_BLOCK``."""
    for part, width, low, high, sums, ids, vectors in zip(*(c.to_pylist() for c in batch.columns)):
        read = lambda raw: np.frombuffer(raw, np.int64)
        ids = read(ids)
        rows = np.frombuffer(vectors, np.int32).astype(np.int64).reshape(len(ids), width)
        yield part, {"low": read(low), "high": read(high), "sums": read(sums), "ids": ids, "rows": rows}


def whole_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has finite components only, with ``ints`` of bigint; null where one is out of range."""
    v = F.col(vector)
    finite = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) != float("inf")))
    number = lambda x: F.floor(x.cast("double") * SCALE)
    fits = F.forall(v, lambda x: F.abs(x) < float(1 << 40))
    return rows.filter(finite).withColumn("ints", F.when(fits, F.transform(v, number)))


def _ranges(ints: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """By dimension: rows, and the least and largest value of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        found: dict[int, list] = {}
        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            for size in np.unique(sizes):
                x = _vectors(batch.filter(pa.array(sizes == size)), "ints", size, np.int64)
                n, low, high = found.get(int(size), (0, x[0], x[0]))
                found[int(size)] = (n + len(x), np.minimum(low, x.min(0)), np.maximum(high, x.max(0)))
        for size, (n, low, high) in found.items():
            yield pa.RecordBatch.from_pydict({"size": [size] * (size + 1), "at": range(-1, size), "low": [n, *low.tolist()], "high": [n, *high.tolist()]}, pa.schema([("size", pa.int32()), ("at", pa.int32()), ("low", pa.int64()), ("high", pa.int64())]))

    parts = ints.select("ints").mapInArrow(run, "size int, at int, low bigint, high bigint")
    # the row at -1 holds the number of vectors; there are as many sizes as the most common one needs
    counts = parts.filter("at = -1").groupBy("size").agg(F.sum("low").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not counts:
        return {}
    size, n = counts[0]
    rows = parts.filter((F.col("size") == size) & (F.col("at") >= 0)).groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("at").collect()
    return {size: (n, np.array([r["low"] for r in rows], np.int64), np.array([r["high"] for r in rows], np.int64))}


def part_blocks(ints: DataFrame, shape: Shape, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """Blocks of rows (id, ints) along the curve of each part; the result is to be written."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            x = _vectors(batch, "ints", shape.dimension, np.int32)
            for part in range(shape.parts):
                a, b = shape.bounds(part)
                piece = np.ascontiguousarray(x[:, a:b])
                key = hilbert_keys(piece.astype(np.int64), low[a:b], high[a:b])
                offsets = np.arange(len(x) + 1, dtype=np.int32) * (b - a) * 4
                vectors = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(piece)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), part, np.int32)), pa.array(key), batch.column("id"), vectors], names=["part", "key", "id", "vector"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: dict[int, list] = {}

        def block(part: int, ids: list[int], vectors: list[bytes]) -> pa.RecordBatch:
            a, b = shape.bounds(part)
            raw = b"".join(vectors)
            x = np.frombuffer(raw, np.int32).astype(np.int64).reshape(len(ids), b - a)
            row = (part, b - a, x.min(0).tobytes(), x.max(0).tobytes(), x.sum(0).tobytes(), np.array(ids, np.int64).tobytes(), raw)
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["part", "width", "low", "high", "sums", "ids", "vectors"])

        for batch in batches:
            for part, id_, vector in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "vector"))):
                ids, vectors = held.setdefault(part, ([], []))
                ids.append(id_)
                vectors.append(vector)
                if len(ids) == BLOCK:
                    yield block(part, *held.pop(part))
        for part in list(held):
            yield block(part, *held.pop(part))

    sorted_ = ints.select("id", "ints").mapInArrow(keyed, "part int, key bigint, id bigint, vector binary").repartitionByRange("part", "key", "id").sortWithinPartitions("part", "key", "id")
    return sorted_.mapInArrow(cut, _BLOCK)


def next_codebooks(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round."""
    width = max(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros((len(b), width), np.int64) for b in books]
        for batch in batches:
            for part, block in _blocks_of(batch):
                for entry, n, total in entry_sums(block, books[part]):
                    counts[part][entry] += n
                    sums[part][entry, : len(total)] += total
        for part, n in enumerate(counts):
            used = np.flatnonzero(n)
            columns = [pa.array(np.full(len(used), part, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used]), *(pa.array(sums[part][used, i]) for i in range(width))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *(f"s{i}" for i in range(width))])

    names = ["n", *(f"s{i}" for i in range(width))]
    folded = blocks.mapInArrow(run, "part int, entry int, " + ", ".join(f"{c} bigint" for c in names))
    found = folded.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in names)).collect()
    out = [b.copy() for b in books]
    for r in found:
        book = out[r["part"]]
        book[r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(book.shape[1])]
    return out


def assigned(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(id, part, entry, distance) of every part of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part, block in _blocks_of(batch):
                entry, distance = assign(block, books[part])
                yield pa.RecordBatch.from_arrays([pa.array(block["ids"]), pa.array(np.full(len(entry), part, np.int32)), pa.array(entry.astype(np.int32)), pa.array(distance)], names=["id", "part", "entry", "distance"])

    return blocks.mapInArrow(run, "id bigint, part int, entry int, distance bigint")


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(rows: DataFrame, vector: str, order: Sequence[Column], parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, list[np.ndarray]]:
    """The rows that are kept with ``code`` and ``error``, and the final codebooks.

    ``order`` names the columns whose smallest values give the first entries.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("an entry is named by two hex digits")
    packed = rows.select(F.struct(*rows.columns).alias("row"), F.col(vector).alias("vector"), F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order))).alias("at"))
    kept = cut_lineage(whole_vectors(packed, "vector").drop("vector").withColumn("id", F.monotonically_increasing_id()))
    found = _ranges(kept.filter("ints is not null"))
    columns = [F.col("row").getField(c).alias(c) for c in rows.columns if c not in ("code", "error")]
    if not found:
        return kept.select(*columns, F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")), []
    ((dimension, (_, low, high)),) = found.items()
    shape = Shape(dimension, parts)
    fit = kept.filter((F.size("ints") == dimension) & ~F.exists("ints", lambda x: F.abs(x) > shape.limit))
    low, high = np.maximum(low, -shape.limit), np.minimum(high, shape.limit)
    first = fit.orderBy(*(F.col("at").getField(f"_{i}").asc_nulls_last() for i in range(len(order))), "ints").limit(entries).select("ints").collect()
    start = np.array([r["ints"] for r in first], np.int64).reshape(len(first), dimension)
    books = [start[:, slice(*shape.bounds(p))].copy() for p in range(parts)]
    if not len(first):
        return kept.select(*columns, F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")), books
    blocks = cut_lineage(part_blocks(fit, shape, low, high))
    for _ in range(rounds):
        books = next_codebooks(blocks, books)
    digits = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("part") == p, F.col("entry"))))), 2, "0") for p in range(parts)]
    coded = assigned(blocks, books).groupBy("id").agg(F.concat(*digits).alias("code"), F.sum("distance").alias("error"))
    return kept.select("id", "row").join(coded, "id", "left").select(*columns, "code", "error"), books


def with_group_error(coded: DataFrame, label: str, name: str = "label_error") -> DataFrame:
    """Append the sum of ``error`` over the rows of one label; null labels are one group.

    The sums are computed once from partial sums and joined, so a label may hold most rows.
    """
    sums = coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias(name))
    return coded.drop(name).join(sums, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
