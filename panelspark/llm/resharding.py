"""Resharding with as few bytes moved as possible, by a minimum-cost flow.

Rows lie in old shards. Each new shard has a capacity in rows: its share of all rows, rounded down
or up, so that shards of one weight hold counts at most one apart. Where nothing is moved nothing
is paid; a row that changes its shard costs its size.

The rows of an old shard are ranked by size. Three blocks of ranks stand for it in the flow: the
rows that its capacity forces out in any case, the one row that leaves unless the shard is rounded
up, and the rest. The flow has a node for each block and shard, so the driver solves a problem of
the size of the shards, not of the rows. Of equally cheap flows the one that moves fewer rows, rounds
up the first shards and moves to near numbers is taken, so the result is unique.

Ranks come from one range shuffle of the rows: a running number that is written with them, less
the number at which a shard begins in each partition. The shares of the flow are ranges of ranks;
a shard's slots continue from one range to the next, which needs no further shuffle.

Rules: a row without an old shard, or with one that is no longer wanted, is moved and paid for. A
null size counts as 0. Rows tie by ``order``; identical rows may trade places. An empty table
stays empty. Columns named like an output (``old_shard``, ``shard``, ``slot``) are replaced.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: The old shard of rows that have none.
NOWHERE = -1
#: Old and new shards that the flow is solved for; beyond it the plan itself would strain the driver.
MAX_SHARDS = 2_000


class Flow:
    """A network with integer capacities and costs."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for u, v, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def used(self, edge: int) -> int:
        return self.room[edge ^ 1]

    def _cheapest(self, source: int, sink: int) -> list[int]:
        """Edges of a cheapest path with room left, from the sink back; empty if there is none."""
        best: list[int | None] = [None] * len(self.out)
        by, waiting, queue = [-1] * len(self.out), [False] * len(self.out), deque([source])
        best[source] = 0
        while queue:
            a = queue.popleft()
            waiting[a] = False
            for e in self.out[a]:
                b = self.to[e]
                if self.room[e] and (best[b] is None or best[a] + self.cost[e] < best[b]):
                    best[b], by[b] = best[a] + self.cost[e], e
                    if not waiting[b]:
                        waiting[b] = True
                        queue.append(b)
        path, at = [], sink
        while by[at] >= 0 and at != source:
            path.append(by[at])
            at = self.to[by[at] ^ 1]
        return path

    def solve(self, source: int, sink: int) -> int:
        """Send all that fits along cheapest paths; the amount sent."""
        sent = 0
        while path := self._cheapest(source, sink):
            n = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= n
                self.room[e ^ 1] += n
            sent += n
        return sent


@dataclass(frozen=True)
class Share:
    """Ranks [start, stop) of an old shard that go to a new one, from ``slot`` on."""

    old: int
    shard: int
    start: int
    stop: int
    slot: int


def lower_bounds(rows: int, weights: Sequence[int]) -> list[int]:
    return [rows * w // sum(weights) for w in weights]


def solve_transfers(blocks: dict[int, list[tuple[int, int]]], weights: Sequence[int]) -> dict[tuple[int, int], int]:
    """Rows to send from each old to each new shard; blocks are (rows, bytes of one) by old shard."""
    new, olds = len(weights), sorted(blocks)
    rows = sum(n for of in blocks.values() for n, _ in of)
    least = lower_bounds(rows, weights)
    # levels of cost in one integer: bytes, rows moved, the numbers of the shards rounded up, distances
    far = (max([new, *olds]) - min([0, *olds])) ** 2 * rows + 1
    up, row = far, far * (new * new + 1)
    byte = row * (rows + 1)
    source, sink, rounded, first_old = 2 * new, 2 * new + 1, 2 * new + 2, 2 * new + 3
    net = Flow(first_old + len(olds) + sum(map(len, blocks.values())))
    moves, stays = {}, {}
    node = first_old + len(olds)
    for k, old in enumerate(olds):
        leaving = first_old + k
        for n, size in blocks[old]:
            net.edge(source, node, n)
            if 0 <= old < new:
                stays[old, node] = net.edge(node, old, n)
            net.edge(node, leaving, n, size * byte + row)
            node += 1
        for shard in range(new):
            if shard != old:
                moves[old, shard] = net.edge(leaving, shard, rows, (old - shard) ** 2)
    for shard in range(new):
        net.edge(shard, sink, least[shard])
        net.edge(shard, rounded, 1, shard * up)
    net.edge(rounded, sink, rows - sum(least))
    assert net.solve(source, sink) == rows
    sent = {k: net.used(e) for k, e in moves.items()}
    for (old, _), e in stays.items():
        sent[old, old] = sent.get((old, old), 0) + net.used(e)
    return {k: n for k, n in sent.items() if n}


def shares(sent: dict[tuple[int, int], int], counts: dict[int, int]) -> list[Share]:
    """Ranges of ranks: what moves has the lowest ranks, by new shard; what stays the highest."""
    ranges = []
    for old in counts:
        start = 0
        for shard in sorted((s for o, s in sent if o == old), key=lambda s: (s == old, s)):
            ranges.append((old, shard, start, start := start + sent[old, shard]))
    out, filled = [], {}
    for old, shard, start, stop in sorted(ranges):
        out.append(Share(old, shard, start, stop, filled.get(shard, 0)))
        filled[shard] = filled.get(shard, 0) + stop - start
    return out


def ranked(rows: DataFrame, group: str, order: Sequence[str], rank: str = "rank") -> DataFrame:
    """Append the 0-based rank of each row in its group, and a written table of the parts it came from.

    The groups may be few and large: rows are dealt by ranges of (group, order) and a last running
    number, so equal rows spread as well.
    """
    keys = [group, *order, "_seq"]
    dealt = rows.withColumn("_seq", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = cut_lineage(dealt.withColumn("_no", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_no", 33)))
    parts = numbered.groupBy(group, "_part").agg(F.min("_no").alias("_first"), F.count("*").alias("_n"))
    # one row for each group and partition
    before = F.sum("_n").over(_so_far(group)) - F.col("_n")
    return numbered.join(parts.select(group, "_part", (before - F.col("_first")).alias("_shift")), [group, "_part"]).withColumn(rank, F.col("_no") + F.col("_shift")).drop("_seq", "_no", "_part", "_shift")


def _so_far(group: str):
    from pyspark.sql import Window

    return Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _blocks(rows: DataFrame, counts: dict[int, int], weights: Sequence[int]) -> dict[int, list[tuple[int, int]]]:
    """(rows, bytes of one) of the block that must leave, of the row that may, and of the rest."""
    spark, total = rows.sparkSession, sum(counts.values())
    least = lower_bounds(total, weights)
    bound = []
    for old, n in counts.items():
        keep = least[old] if 0 <= old < len(weights) else 0
        bound.append((old, max(0, n - keep - 1) if 0 <= old < len(weights) else n, max(0, n - keep)))
    cuts = spark.createDataFrame(bound, "old_shard int, _forced bigint, _free bigint")
    block = F.when(F.col("rank") < F.col("_forced"), 0).when(F.col("rank") < F.col("_free"), 1).otherwise(2)
    # the largest size prices a block: the first leaves at any price, the rest is dearer than what may leave
    found = rows.join(F.broadcast(cuts), "old_shard").groupBy("old_shard", block.alias("block")).agg(F.count("*").alias("n"), F.max("size").alias("most")).collect()
    out: dict[int, list[tuple[int, int]]] = {old: [] for old in counts}
    for r in sorted(found, key=lambda r: (r["old_shard"], r["block"])):
        out[r["old_shard"]].append((r["n"], r["most"]))
    return out


def reshard(rows: DataFrame, old: Column, size: Column, weights: Sequence[int], order: Iterable[Column] = ()) -> DataFrame:
    """The rows with ``old_shard``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``weights`` gives the capacities of shards 0, 1, ... as parts of all rows.
    """
    if not weights or min(weights) < 0 or not sum(weights) or len(weights) > MAX_SHARDS:
        raise ValueError(f"weights must be 1 to {MAX_SHARDS} numbers of 0 or more, not all 0")
    keys = list(order)
    packed = rows.select(
        F.struct(*rows.columns).alias("row"),
        F.coalesce(old.cast("int"), F.lit(NOWHERE)).alias("old_shard"),
        F.coalesce(size.cast("bigint"), F.lit(0)).alias("size"),
        *(c.alias(f"_by{i}") for i, c in enumerate(keys)),
    )
    placed = ranked(packed, "old_shard", ["size", *(f"_by{i}" for i in range(len(keys)))])
    found = placed.groupBy("old_shard").count().orderBy("old_shard").limit(MAX_SHARDS + 1).collect()
    if len(found) > MAX_SHARDS:
        raise ValueError(f"more than {MAX_SHARDS} old shards")
    counts = {r["old_shard"]: r["count"] for r in found}
    plan = shares(solve_transfers(_blocks(placed, counts, weights), weights), counts) if counts else []
    table = rows.sparkSession.createDataFrame([(s.old, s.shard, s.start, s.stop, s.slot) for s in plan], "old_shard int, shard int, _start bigint, _stop bigint, _slot bigint")
    # at most one share for each pair of shards
    within = (placed["old_shard"] == table["old_shard"]) & (placed["rank"] >= table["_start"]) & (placed["rank"] < table["_stop"])
    dealt = placed.join(F.broadcast(table), within).select("row", placed["old_shard"], "shard", (F.col("rank") - F.col("_start") + F.col("_slot")).alias("slot"))
    kept = [F.col("row").getField(c).alias(c) for c in rows.columns if c not in ("old_shard", "shard", "slot")]
    return dealt.select(*kept, "old_shard", "shard", "slot")


def rewrite(planned: DataFrame, folder: str, target: str) -> dict[int, str]:
    """Write the shards that lose or gain rows to ``target``; where each shard of the new layout lies.

    ``folder`` holds the old layout as ``shard=0``, ``shard=1``, ...; shards without a move keep
    their files there. Files of a rewritten shard hold runs of slots.
    """
    pairs = planned.groupBy("old_shard", "shard").agg(F.count("*").alias("n")).collect()
    touched = {s for r in pairs if r["old_shard"] != r["shard"] for s in (r["old_shard"], r["shard"])}
    new = sorted({r["shard"] for r in pairs})
    if touched:
        planned.filter(F.col("shard").isin(sorted(touched))).drop("old_shard").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(target)
    return {s: f"{target if s in touched else folder}/shard={s}" for s in new}
