"""Near-duplicates by a chosen-path set similarity join over shingle sets.

Documents with one shingle set are one class, so copies cost nothing further. Each class has
``TREES * DEPTH`` minwise tokens. A tree branches its classes by its first token, and a node that is still large
by the next token, and so on. Within a small node all classes are compared by
their tokens and size; pairs that may reach the threshold tie classes to candidate clusters.
A node that stays large to the last level holds near-copies; its classes are tied without a look.
``TREES`` independent trees repeat this: a pair at the threshold
misses them all with probability (1 - 0.85) ** 16, about 1e-13, where its nodes are small, and
(1 - 0.85 ** 4) ** 16, about 1e-5, where all are large to the end.

Clusters only say where to look. The full sets of a cluster's classes are brought together
once, and exact intersections decide the links. Within a block, two classes already
connected are not compared again. A cluster beyond a block's bounds is split into blocks that
share some of its classes as hubs. If it then still falls apart, the classes outside its largest
part and those inside it are dealt to sub-blocks of half a block, and a task compares two of them: every
class outside meets every other one, so no link is lost and no task holds more than a block.

Null, empty and blank texts have empty sets and are linked with nothing. Ids may be of any type that
has an order. Rows with a null id take part; a component of such rows alone has a null id. Rows that share an id are judged
each by its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import raw_texts, slices
from .graph import connected_components
from .words import key_groups, mix, shingle_set, words_of

TREES, DEPTH = 16, 4
#: Classes of a node that are compared with each other; larger nodes branch on.
NODE_LIMIT = 64
#: Classes, and shingles in all, that one block of a cluster holds on average.
BLOCK_CLASSES, BLOCK_SHINGLES = 4096, 3_000_000
#: Classes, about, that all blocks of a cluster share.
HUBS = 16
#: Standard deviations that the agreement of two sketches may stay under its mean at the threshold.
SLACK = 5.0

_RANDOM = np.random.Generator(np.random.PCG64(7141))
_FLIP = _RANDOM.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minwise_tokens(shingles: np.ndarray) -> np.ndarray:
    """The minwise token of each hash function, as 32 bits of the least value."""
    least = [((shingles[i : i + 8192, None] ^ _FLIP) * _TIMES).min(axis=0) for i in range(0, len(shingles), 8192)]
    return (np.min(least, axis=0) >> np.uint64(32)).astype(np.uint32)


def class_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def reference(doc_id: str, text: str) -> Column:
    """A value that finds a row's text again."""
    return F.xxhash64(doc_id, text)


def sketches(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, ref, n, class, sketch) of rows (doc_id, ref, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                words = words_of(raw_texts(batch))
                sets = [shingle_set(words.hashes[a:b], size) for a, b in zip(words.first, words.first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("ref"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([class_of(s) for s in sets], pa.binary()),
                        pa.array([minwise_tokens(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "ref", "n", "class", "sketch"],
                )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ref bigint, n bigint, class binary, sketch binary")


def paths(classes: DataFrame) -> DataFrame:
    """(p0 .. p3, class): for each tree the nodes on the class's path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                tokens = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, TREES, DEPTH).astype(np.uint64)
                node, levels = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), tokens.shape[:2]), []
                for d in range(DEPTH):
                    node = mix(node + tokens[:, :, d])
                    levels.append(pa.array(node.ravel().view(np.int64)))
                who = np.repeat(np.arange(batch.num_rows), TREES)
                yield pa.RecordBatch.from_arrays([*levels, batch.column("class").take(pa.array(who))], names=[*(f"p{d}" for d in range(DEPTH)), "class"])

    return classes.mapInArrow(run, ", ".join(f"p{d} bigint" for d in range(DEPTH)) + ", class binary")


def _node_sizes(rows: DataFrame, level: str) -> DataFrame:
    members = F.bit_xor(F.xxhash64("class")).alias("members")
    return rows.groupBy(level).agg(F.count(F.lit(1)).alias("size"), members).filter(F.col("size") > 1)


def _small_nodes(rows: DataFrame, sizes: DataFrame, level: str) -> DataFrame:
    """(node, class) of small nodes; of those with the same classes in several trees, one stays."""
    one = sizes.filter(F.col("size") <= NODE_LIMIT).groupBy("size", "members").agg(F.min(level).alias(level))
    return rows.select(level, "class").join(one.select(level), level).select(F.col(level).alias("node"), "class")


def tree_nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Small nodes as (node, class), and ties (a, b) of the classes of nodes that stay large."""
    small, ties = None, None
    for d in range(DEPTH):
        level = f"p{d}"
        sizes = cut_lineage(_node_sizes(rows, level))
        own = _small_nodes(rows, sizes, level)
        small = own if small is None else small.unionByName(own)
        large = sizes.filter(F.col("size") > NODE_LIMIT).select(level)
        if large.isEmpty():
            break
        rows = rows.join(large, level)
        if d + 1 < DEPTH:
            rows = cut_lineage(rows)
        else:
            hub = rows.groupBy(level).agg(F.min("class").alias("a"))
            ties = rows.join(hub, level).select("a", F.col("class").alias("b"))
    return small, ties


def plausible_ties(members: DataFrame, percent: int) -> DataFrame:
    """Ties (a, b) within nodes, of rows (node, class, n, sketch): all pairs compared by tokens and size."""
    mean = TREES * DEPTH * percent / 100
    least = int(mean - SLACK * (mean * (1 - percent / 100)) ** 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, "node"):
            n = group.column("n").to_numpy()
            tokens = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint32).reshape(len(n), -1)
            near = (tokens[:, None, :] == tokens[None, :, :]).sum(axis=2) >= least
            near &= 100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n)
            label = np.arange(len(n))
            while True:
                lower = np.where(near, label, len(n)).min(axis=1)
                if (lower == label).all():
                    break
                label = lower
            tied = np.flatnonzero(label != np.arange(len(n)))
            if len(tied):
                classes = group.column("class").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([classes[i] for i in label[tied]], pa.binary()), pa.array([classes[i] for i in tied], pa.binary())], names=["a", "b"])

    return members.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a binary, b binary")


def candidate_clusters(classes: DataFrame, percent: int) -> DataFrame:
    """(class, cluster): every link that is to be found lies inside one cluster."""
    small, ties = tree_nodes(paths(classes))
    edges = plausible_ties(small.join(classes.select("class", "n", "sketch"), "class"), percent)
    return connected_components(edges if ties is None else edges.unionByName(ties), "class", "cluster")


def _no_side() -> Column:
    return F.lit(-1).cast("bigint").alias("side")


def full_sets(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(class, cluster, n, shingles) of the wanted (class, cluster, ref); shingles packed and sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                words = words_of(raw_texts(batch))
                sets = [shingle_set(words.hashes[a:b], size) for a, b in zip(words.first, words.first[1:])]
                right = [i for i, (s, c) in enumerate(zip(sets, batch.column("class").to_pylist())) if class_of(s) == c]
                part = batch.take(pa.array(right, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("class"), part.column("cluster"), pa.array([len(sets[i]) for i in right], pa.int64()), pa.array([sets[i].tobytes() for i in right], pa.binary())],
                    names=["class", "cluster", "n", "shingles"],
                )

    found = rows.select("ref", "text").join(wanted, "ref").select("class", "cluster", "text")
    return found.mapInArrow(run, "class binary, cluster binary, n bigint, shingles binary").dropDuplicates(["class"])


def exact_links(members: DataFrame, percent: int) -> DataFrame:
    """(class, part) of rows (block, class, part, side, shingles): parts united by exact links within blocks.

    A class that stands in several blocks is given once for each. Classes of one side are not
    compared with each other, except those of side -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, "block"):
            classes, parts = group.column("class").to_pylist(), group.column("part").to_pylist()
            sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
            label = unite(sets, parts, percent, group.column("side").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), pa.array([parts[i] for i in label], pa.binary())], names=["class", "part"])

    return members.repartition("block").sortWithinPartitions("block").mapInArrow(run, "class binary, part binary")


def unite(sets: list[np.ndarray], parts: list[bytes], percent: int, side: np.ndarray) -> np.ndarray:
    """For each set the index of one that stands for its part, after all links between parts (and sides)."""
    first: dict[bytes, int] = {}
    label = np.array([first.setdefault(p, i) for i, p in enumerate(parts)])
    size = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    # one sort in place and a search for each sorted set take half the memory of np.unique with its inverse
    every = np.concatenate(sets)
    every.sort()
    values = every[np.concatenate([[True], every[1:] != every[:-1]])[: len(every)]]
    del every
    at = np.concatenate([np.searchsorted(values, s).astype(np.int32) for s in sets])
    number = len(values)
    del values
    for i in range(len(sets) - 1):
        other = label[i + 1 :] != label[i]
        if side[i] >= 0:
            other &= side[i + 1 :] != side[i]
        other &= 100 * np.minimum(size[i], size[i + 1 :]) >= percent * np.maximum(size[i], size[i + 1 :])
        if not other.any():
            continue
        mark = np.zeros(number, np.uint8)
        mark[at[starts[i] : starts[i] + size[i]]] = 1
        common = np.add.reduceat(mark[at[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1], dtype=np.int64)
        union = size[i] + size[i + 1 :] - common
        for old in set(label[i + 1 :][other & (100 * common >= percent * union)].tolist()):
            label[label == old] = label[i]
    return label


def sub_block_pairs(rows: DataFrame) -> DataFrame:
    """(block, class, part, side, shingles) of rows (cluster, main, class, part, n, shingles): what remains to be compared.

    The classes outside the part ``main`` are dealt to sub-blocks of half a block's size, and those inside to
    further ones. A block is a pair of sub-blocks whose first is outside; each sub-block outside is
    compared with itself in one of its pairs only.
    """
    outside = F.col("part") != F.col("main")
    halves = lambda some: F.greatest(F.lit(1), F.ceil(2 * F.count(F.when(some, 1)) / BLOCK_CLASSES), F.ceil(2 * F.sum(F.when(some, F.col("n"))) / BLOCK_SHINGLES)).cast("bigint")
    shape = cut_lineage(rows.groupBy("cluster").agg(halves(outside).alias("out"), halves(~outside).alias("in")))
    deal = lambda n: F.pmod(F.xxhash64("class", F.lit(2)), n)
    own = F.when(outside, deal(F.col("out"))).otherwise(F.col("out") + deal(F.col("in")))
    last = F.when(outside, F.col("out") + F.col("in")).otherwise(F.col("out")) - 1
    met = rows.join(shape, "cluster").withColumn("own", own).withColumn("met", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).filter("met != own")
    side = F.when(F.col("met") == F.col("own") + 1, F.lit(-1).cast("bigint")).otherwise(F.col("own"))
    return met.select(F.xxhash64("cluster", F.least("own", "met"), F.greatest("own", "met")).alias("block"), "class", "part", side.alias("side"), "shingles")


def linked_parts(sets: DataFrame, percent: int) -> DataFrame:
    """(class, part) of rows (class, cluster, n, shingles): the components of the exact links."""
    shape = sets.groupBy("cluster").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("classes") / BLOCK_CLASSES), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    shape = cut_lineage(shape.select("cluster", blocks.alias("blocks")))
    placed = sets.join(shape, "cluster")
    block = lambda b: F.xxhash64("cluster", b)
    whole = placed.filter(F.col("blocks") == 1).select(block(F.lit(0)).alias("block"), "class", F.col("class").alias("part"), _no_side(), "shingles")
    done = exact_links(whole, percent)
    large = shape.filter(F.col("blocks") > 1)
    if large.isEmpty():
        return done

    rows = cut_lineage(sets.join(large, "cluster").withColumn("own", F.pmod(F.xxhash64("class"), "blocks")))
    home = lambda some: some.select("cluster", "class", "part", "shingles", F.col("own").alias("b"))
    everywhere = lambda some: some.select("cluster", "class", "part", "shingles", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1)).alias("b"))
    pairs = lambda some: some.select(F.col("class").alias("a"), F.col("part").alias("b"))

    def joined(labelled: DataFrame, blocks: DataFrame) -> DataFrame:
        """Components after the classes of each block have met."""
        found = exact_links(blocks, percent)
        return connected_components(pairs(found).distinct().unionByName(pairs(labelled)), "class", "part")

    hub = F.pmod(F.xxhash64("class", F.lit(1)), F.col("blocks") * (BLOCK_CLASSES // HUBS)) == 0
    single = rows.withColumn("part", F.col("class"))
    sent = home(single).unionByName(everywhere(single.filter(hub))).dropDuplicates(["cluster", "b", "class"])
    parts = joined(single, sent.select(block(F.col("b")).alias("block"), "class", "part", _no_side(), "shingles"))
    labelled = cut_lineage(rows.join(parts, "class", "left").withColumn("part", F.coalesce("part", "class")))
    sizes = labelled.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("size", "part"))["part"].alias("main"), F.count(F.lit(1)).alias("parts"))
    open_ = labelled.join(main.filter(F.col("parts") > 1), "cluster")
    if not open_.isEmpty():
        parts = joined(open_, sub_block_pairs(open_)).unionByName(parts.join(open_.select("class"), "class", "left_anti"))
    rest = labelled.select("class").join(parts, "class", "left").select("class", F.coalesce("part", "class").alias("part"))
    return done.unionByName(rest)


def near_groups(docs: DataFrame, size: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ref, class, part, n_shingles, component_id) for each row; ``part`` names the component."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), reference(doc_id, text).alias("ref"), F.col(text).alias("text"))
    drawn = cut_lineage(sketches(rows, size))
    classes = cut_lineage(drawn.filter(F.col("n") > 0).groupBy("class").agg(F.min("doc_id").alias("first_id"), F.min("ref").alias("ref"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    clusters = candidate_clusters(classes, percent)
    sets = cut_lineage(full_sets(rows, classes.join(clusters, "class").select("ref", "class", "cluster"), size))
    parts = cut_lineage(linked_parts(sets, percent))
    named = classes.select("class", "first_id").join(parts, "class", "left").withColumn("part", F.coalesce("part", "class"))
    component = named.groupBy("part").agg(F.min("first_id").alias("component_id"))
    of_class = named.join(component, "part").select("class", "part", "component_id")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return drawn.select("doc_id", "ref", "n", "class").join(of_class, "class", "left").select("doc_id", "ref", "class", "part", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def drop_near_copies(docs: DataFrame, size: int, percent: int, doc_id: str = "doc_id", text: str = "text", single: bool = False) -> DataFrame:
    """The documents with the smallest id of their component, with their columns as they were.

    Rows without an id stay where their component has none with one. Rows that share an id may stay
    together; with ``single`` one row of each component stays, and all rows without words.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), reference(doc_id, text).alias("ref"))
    if not single:
        ids = near_groups(docs, size, percent, doc_id, text).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        return rows.join(ids.select("ref").distinct(), "ref", "left_semi").select("row.*")
    found = cut_lineage(near_groups(docs, size, percent, doc_id, text))
    some = found.filter("n_shingles > 0")
    one = some.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ref"))["ref"].alias("ref"))
    kept = cut_lineage(one.select("ref").unionByName(found.filter("n_shingles = 0").select("ref")).distinct())
    rows = rows.join(kept, "ref", "left_semi")
    # rows that are equal in id and text
    several = cut_lineage(some.join(one, ["part", "ref"], "left_semi").groupBy("ref").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("ref"))
    if several.isEmpty():
        return rows.select("row.*")
    equal = rows.join(several, "ref", "left_semi").groupBy("ref").agg(F.first("row").alias("row"))
    return rows.join(several, "ref", "left_anti").select("row.*").unionByName(equal.select("row.*"))
