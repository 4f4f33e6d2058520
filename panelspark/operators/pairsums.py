"""Sums over all pairs of places by distance, with two trees walked side by side.

Places are sorted along a space-filling curve and stored in blocks with their vectors (a sum and a
count for each event). Blocks that come within the last edge of each other meet once, for
all events. Inside, both blocks are halved again and again: two runs of places that lie wholly in one
distance bin add the products of their sums, two that lie wholly beyond the last edge add nothing, and only runs
across an edge are opened, down to small ones whose distances are computed pair by pair.

A task adds up what it has met and sends one row for each event and bin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .spatial import EARTH_KM, pairs_within

#: Places and numbers of a block at most.
BLOCK_PLACES, BLOCK_NUMBERS = 1024, 1 << 19
#: Places of a run that is not halved further.
LEAF = 256


def curve_key(lat: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Places near each other get near numbers: the bits of latitude and longitude, interleaved."""
    out = np.zeros(len(lat), np.int64)
    cells = [np.clip((v + half) / (2 * half) * (1 << 20), 0, (1 << 20) - 1).astype(np.int64) for v, half in ((lat, 90.0), ((long + 180.0) % 360.0 - 180.0, 180.0))]
    for bit in range(19, -1, -1):
        for c in cells:
            out = out << 1 | (c >> bit & 1)
    return out


@dataclass
class Run:
    """A run of places of a block: where it is and its sums."""

    start: int
    stop: int
    centre: np.ndarray
    radius: float
    sums: np.ndarray
    counts: np.ndarray
    halves: tuple[Run, Run] | None = None


@dataclass
class Block:
    """Places as unit vectors, with a sum and a count for each event."""

    units: np.ndarray
    sums: np.ndarray
    counts: np.ndarray

    @classmethod
    def read(cls, raw: bytes, events: int) -> Block:
        table = np.frombuffer(raw).reshape(-1, 3 + 2 * events)
        return cls(np.ascontiguousarray(table[:, :3]), np.ascontiguousarray(table[:, 3 : 3 + events].T), np.ascontiguousarray(table[:, 3 + events :].T))

    def tree(self, start: int = 0, stop: int | None = None) -> Run:
        stop = len(self.units) if stop is None else stop
        centre, radius = cap(self.units[start:stop])
        run = Run(start, stop, centre, radius, self.sums[:, start:stop].sum(1), self.counts[:, start:stop].sum(1))
        if stop - start > LEAF:
            middle = (start + stop) // 2
            run.halves = (self.tree(start, middle), self.tree(middle, stop))
        return run


def cap(units: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and angular radius of a cap that holds all points, a little wide."""
    centre = units.mean(0)
    norm = np.linalg.norm(centre)
    centre = centre / norm if norm > 1e-9 else np.array([0.0, 0.0, 1.0])
    chord = np.sqrt(((units - centre) ** 2).sum(1).max())
    return centre, 2 * math.asin(min(1.0, chord / 2)) + 1e-9


class BinSums:
    """Adds up sums and numbers of pairs by event and distance bin; bins are right-closed."""

    def __init__(self, edges: Sequence[float], events: int, radius_km: float = EARTH_KM):
        self.edges, self.radius_km = np.array(edges), radius_km
        # squared chords grow with the distance, so the edges are compared as such
        self.chords = (2 * np.sin(np.minimum(self.edges / radius_km, math.pi) / 2)) ** 2
        self.sums = np.zeros((events, len(edges) + 1))
        self.counts = np.zeros((events, len(edges) + 1))

    def _bin(self, km: float) -> int:
        return int(np.searchsorted(self.edges, km, "left"))

    def meet(self, a: Block, b: Block, x: Run, y: Run) -> None:
        """All pairs of a place of one run and one of the other."""
        angle = 2 * math.asin(min(1.0, math.sqrt(((x.centre - y.centre) ** 2).sum()) / 2))
        reach = x.radius + y.radius + 1e-9
        nearest = self._bin(max(0.0, angle - reach) * self.radius_km)
        if nearest == len(self.edges):
            return
        if nearest == self._bin((angle + reach) * self.radius_km):
            self.sums[:, nearest] += x.sums * y.sums
            self.counts[:, nearest] += x.counts * y.counts
        elif x.halves and (x.radius >= y.radius or not y.halves):
            for half in x.halves:
                self.meet(a, b, half, y)
        elif y.halves:
            for half in y.halves:
                self.meet(a, b, x, half)
        else:
            self._pairs(a, b, x, y)

    def within(self, a: Block, x: Run) -> None:
        """All unordered pairs of a run."""
        if x.halves:
            left, right = x.halves
            self.within(a, left)
            self.within(a, right)
            self.meet(a, a, left, right)
        else:
            self._pairs(a, a, x, x)

    def _pairs(self, a: Block, b: Block, x: Run, y: Run) -> None:
        u, v = a.units[x.start : x.stop], b.units[y.start : y.stop]
        chord2 = sum((u[:, i, None] - v[None, :, i]) ** 2 for i in range(3))
        number = np.searchsorted(self.chords, chord2, "left")
        own = x is y
        chosen = np.triu_indices(len(u), 1) if own else None
        flat = number[chosen] if own else number.ravel()
        size = len(self.edges) + 1
        for sums, left, right in ((self.sums, a.sums, b.sums), (self.counts, a.counts, b.counts)):
            for e in range(len(sums)):
                product = left[e, x.start : x.stop, None] * right[e, None, y.start : y.stop]
                sums[e] += np.bincount(flat, product[chosen] if own else product.ravel(), size)


def place_blocks(places: DataFrame, events: int, lat: str, long: str) -> DataFrame:
    """(block, lat, long, radius_km, raw) of rows (lat, long, e, s, n), one for each place and event."""
    places_of_block = max(1, min(BLOCK_PLACES, BLOCK_NUMBERS // (2 * events)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = curve_key(batch.column("lat").to_numpy(), batch.column("long").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns], names=["key", *batch.schema.names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, []

        def block(table: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            first = np.concatenate([[True], (table[1:, :2] != table[:-1, :2]).any(1)])
            at = np.cumsum(first) - 1
            phi, lam = np.radians(table[first, 0]), np.radians(table[first, 1])
            out = np.zeros((len(phi), 3 + 2 * events))
            out[:, :3] = np.stack([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)], 1)
            event = table[:, 2].astype(np.int64)
            out[at, 3 + event], out[at, 3 + events + event] = table[:, 3], table[:, 4]
            (x, y, z), radius = cap(out[:, :3])
            row = (part << 32 | number, math.degrees(math.asin(max(-1.0, min(1.0, z)))), math.degrees(math.atan2(y, x)), radius * EARTH_KM, out.tobytes())
            number += 1
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds)], names=["block", "lat", "long", "radius_km", "raw"])

        rest = np.zeros((0, 5))
        for batch in batches:
            table = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lat", "long", "e", "s", "n")], 1)
            rest = np.concatenate([rest, table])
            starts = np.flatnonzero(np.concatenate([[True], (rest[1:, :2] != rest[:-1, :2]).any(1)]))
            # a block ends where the next place begins, so the last place waits for its other rows
            done = 0
            while len(starts) - done > places_of_block:
                yield block(rest[starts[done] : starts[done + places_of_block]])
                done += places_of_block
            rest = rest[starts[done] :] if done else rest
        if len(rest):
            yield block(rest)

    rows = places.select(F.col(lat).cast("double").alias("lat"), F.col(long).cast("double").alias("long"), F.col("e").cast("int").alias("e"), "s", F.col("n").cast("double").alias("n"))
    dealt = rows.mapInArrow(keyed, "key bigint, lat double, long double, e int, s double, n double").repartitionByRange("key", "lat", "long").sortWithinPartitions("key", "lat", "long")
    return dealt.mapInArrow(cut, "block bigint, lat double, long double, radius_km double, raw binary")


def sums_by_distance(places: DataFrame, events: int, edges: Sequence[float], lat: str = "lat", long: str = "long") -> DataFrame:
    """(e, distance_bin, xx, pairs) over unordered pairs of different places up to the last edge.

    ``places`` has one row (lat, long, e, s, n) for each place and event number: the sum of values
    and their count. ``xx`` adds products of sums, ``pairs`` products of counts.
    """
    blocks = cut_lineage(place_blocks(places, events, lat, long))
    spark = places.sparkSession
    widest = blocks.agg(F.max("radius_km")).first()[0] or 0.0
    centres = blocks.select("block", "lat", "long")
    met = pairs_within(centres, "block", edges[-1] + 2 * widest + 1e-6).select("block", "block_dest")
    met = met.unionByName(centres.select("block", F.col("block").alias("block_dest")))
    one, two = blocks.select("block", "raw"), blocks.select(F.col("block").alias("block_dest"), F.col("raw").alias("raw_dest"))
    # the work is in the pairs, not in their bytes: the partition count is stated
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.join(one, "block").join(two, "block_dest").repartition(tasks, "block", "block_dest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, known = BinSums(edges, events), {}

        def tree(id_: int, raw: bytes) -> tuple[Block, Run]:
            if id_ not in known:
                if len(known) > 8:
                    known.clear()
                block = Block.read(raw, events)
                known[id_] = (block, block.tree())
            return known[id_]

        for batch in batches:
            for i, j, raw, raw_dest in zip(*(batch.column(c).to_pylist() for c in ("block", "block_dest", "raw", "raw_dest"))):
                a, x = tree(i, raw)
                if i == j:
                    found.within(a, x)
                else:
                    b, y = tree(j, raw_dest)
                    found.meet(a, b, x, y)
        event, number = np.nonzero(found.counts[:, :-1])
        columns = [pa.array(event.astype(np.int32)), pa.array(number.astype(np.int32)), pa.array(found.sums[event, number]), pa.array(found.counts[event, number])]
        yield pa.RecordBatch.from_arrays(columns, names=["e", "distance_bin", "xx", "pairs"])

    parts = dealt.mapInArrow(run, "e int, distance_bin int, xx double, pairs double")
    return parts.groupBy("e", "distance_bin").agg(F.sum("xx").alias("xx"), F.sum("pairs").alias("pairs"))
