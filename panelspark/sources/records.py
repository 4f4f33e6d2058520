"""CSV records cut on bytes: quoted line breaks stay in their record, texts are decoded by charset.

Large files are read in splits by many tasks. A task cannot know whether its split starts inside
quotes, so a first scan notes for each split what it does to either state; the notes of a file, one row
for each split, are folded in order. The second scan cuts and parses. A record that goes on in the next split
is sent on in pieces and joined; one that covers a whole split is no record but a stray quote, and
is rejected like other bad records.

Bad records are returned with a reason, not dropped: more cells than the header has columns, bytes that the
charset does not know, a quote that is never closed. Records with fewer cells are filled with nulls;
empty cells are null; empty lines are skipped.
"""

from __future__ import annotations

import codecs
import csv
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Splits whose starting state is sent to all tasks; more are joined by a shuffle.
SENT_SPLITS = 100_000
_BOM = b"\xef\xbb\xbf"


@dataclass(frozen=True)
class Dialect:
    """How records are written. The charset must write separator, quote and line end as ASCII does.

    ``unicode_escape`` is Latin-1 with Python's escapes, which are resolved in each cell.
    """

    sep: str = ","
    quote: str = '"'
    encoding: str = "UTF-8"
    header: bool = True

    def __post_init__(self):
        for c in (self.sep, self.quote, "\n", "\r"):
            if c.encode("ascii").decode(self.encoding, "replace") != c:
                raise ValueError(f"records in {self.encoding} cannot be cut on bytes")

    @property
    def escaped(self) -> bool:
        return codecs.lookup(self.encoding).name == "unicode_escape"


def read_lines(spark: SparkSession, source: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    """(path, block, line) of all lines as bytes; ``block`` is where the split begins."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True)
    lines = (reader.option("pathGlobFilter", pattern) if pattern else reader).text(source)
    meta = F.col("_metadata")
    return lines.select(meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), F.col("value").cast("binary").alias("line"))


def ends_inside(line: bytes, inside: bool, sep: bytes, quote: bytes) -> tuple[bool, bool]:
    """Whether quotes are open after a line, and whether any were closed in it.

    Quotes open at the start of a field only; doubled ones inside are text.
    """
    at, closed = 0, False
    if not inside and line.startswith(quote):
        inside, at = True, 1
    while True:
        if inside:
            at = line.find(quote, at)
            while at >= 0 and line[at + 1 : at + 2] == quote:
                at = line.find(quote, at + 2)
            if at < 0:
                return True, closed
            inside, closed, at = False, True, at + 1
        at = line.find(sep, at)
        if at < 0:
            return False, closed
        at += 1
        if line[at : at + 1] == quote:
            inside, at = True, at + 1


def _by_split(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """(place, line) in order; place is (path, block, ...)."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("path", "block", *more)]
        yield from zip(zip(*columns), batch.column("line").to_pylist())


def split_notes(lines: DataFrame, dialect: Dialect) -> DataFrame:
    """One row per split: the state after it from either state before, whether open quotes are closed, the first record."""
    sep, quote = dialect.sep.encode(), dialect.quote.encode()
    fields = [("path", pa.string()), ("block", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_()), ("closes", pa.bool_()), ("head", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda: pa.RecordBatch.from_arrays([pa.array([v], k) for v, (_, k) in zip((*at, outside, inside, closes, None if head is None else b"\n".join(head)), fields)], names=[n for n, _ in fields])
        at, outside, inside, closes, head, heading = None, False, True, False, None, False
        for place, line in _by_split(batches):
            if place != at:
                if at is not None:
                    yield row()
                at, outside, inside, closes = place, False, True, False
                heading = place[1] == 0
                head = [] if heading else None
            if heading and not head and not line.removesuffix(b"\r"):
                continue
            if quote in line:
                outside, _ = ends_inside(line, outside, sep, quote)
                inside, closed = ends_inside(line, inside, sep, quote)
                closes |= closed
            if heading:
                head.append(line)
                heading = outside
        if at is not None:
            yield row()

    return lines.mapInArrow(run, "path string, block bigint, outside boolean, inside boolean, closes boolean, head binary")


def split_states(notes: DataFrame) -> DataFrame:
    """(path, block, opened, head): the split in which the quotes open at a split's start were opened, null if none are."""
    splits = F.sort_array(F.collect_list(F.struct("block", "outside", "inside", "closes"))).alias("splits")
    files = notes.groupBy("path").agg(splits, F.max("head").alias("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, splits, head in zip(*(batch.column(c).to_pylist() for c in ("path", "splits", "head"))):
                opened, states = None, []
                for s in splits:
                    states.append(opened)
                    if not (s["outside"] if opened is None else s["inside"]):
                        opened = None
                    elif opened is None or s["closes"]:
                        opened = s["block"]
                n = len(splits)
                columns = [pa.array([path] * n, pa.string()), pa.array([s["block"] for s in splits], pa.int64()), pa.array(states, pa.int64()), pa.array([head] * n, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "block", "opened", "head"])

    return files.mapInArrow(run, "path string, block bigint, opened bigint, head binary")


def header_names(head: bytes, dialect: Dialect) -> list[str]:
    """Column names of a header record; an empty name gets its number, a repeated one a count."""
    text = head.removeprefix(_BOM).removesuffix(b"\r").decode(dialect.encoding, "replace")
    out: list[str] = []
    for i, name in enumerate(next(csv.reader([text], delimiter=dialect.sep, quotechar=dialect.quote), [])):
        base = name.strip() or f"_c{i}"
        again = sum(1 for n in out if n == base or n.startswith(f"{base}."))
        out.append(f"{base}.{again}" if again else base)
    return out


#: Result of one record: cells, or its text and why it is rejected.
Parsed = tuple["list[str | None] | None", "str | None", "str | None"]


def parse_record(raw: bytes, dialect: Dialect, width: int | None) -> Parsed | None:
    """Cells of a record, or its text and a reason; None for an empty line."""
    raw = raw.removesuffix(b"\r")
    if not raw:
        return None
    csv.field_size_limit(sys.maxsize)
    try:
        text = raw.decode("latin-1" if dialect.escaped else dialect.encoding)
        cells = next(csv.reader([text], delimiter=dialect.sep, quotechar=dialect.quote), [])
        if dialect.escaped:
            cells = [c.encode("latin-1").decode(dialect.encoding) if "\\" in c else c for c in cells]
    except UnicodeDecodeError:
        return None, raw.decode("latin-1" if dialect.escaped else dialect.encoding, "replace"), "charset"
    except csv.Error:
        return None, text, "line break"
    if width is not None and len(cells) > width:
        return None, text, "too many cells"
    return [c or None for c in cells], None, None


_OUT = [("path", pa.string()), ("layout", pa.int32()), ("cells", pa.list_(pa.string())), ("text", pa.string()), ("reason", pa.string())]
_OUT_DDL = "path string, layout int, cells array<string>, text string, reason string"
_PIECE = [("path", pa.string()), ("layout", pa.int32()), ("opened", pa.int64()), ("block", pa.int64()), ("raw", pa.binary()), ("closed", pa.bool_())]
_PIECE_DDL = "path string, layout int, opened bigint, block bigint, raw binary, closed boolean"


def _batched(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]], size: int = 2000, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    volume = 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*held), fields)], names=[n for n, _ in fields])
    for row in rows:
        held.append(row)
        volume += sum(map(len, filter(None, row[2]))) if isinstance(row[2], list) else len(row[3] or "") if isinstance(row[3], str) else 0
        if len(held) >= size or volume >= limit:
            yield make()
            held.clear()
            volume = 0
    if held:
        yield make()


def _records(batches: Iterator[pa.RecordBatch], dialect: Dialect) -> Iterator[tuple]:
    """("record" | "tail" | "head" | "middle", path, layout, opened, block, raw) of the lines of a task."""
    sep, quote = dialect.sep.encode(), dialect.quote.encode()
    at, held, inside, first, heading, skip = None, [], False, False, False, False

    def over() -> Iterator[tuple]:
        if held:
            path, block, opened, layout = at
            kind = "middle" if heading else "tail"
            yield kind, path, layout, opened if heading else block, block, b"\n".join(held)

    for place, line in _by_split(batches, "opened", "layout"):
        if place != at:
            yield from over()
            at, held = place, []
            inside = heading = place[2] is not None
            first = place[1] == 0
            skip = first and dialect.header
        path, block, opened, layout = place
        if first and not held:
            line = line.removeprefix(_BOM)
            first = not line.removesuffix(b"\r")
        held.append(line)
        if inside or quote in line:
            inside, _ = ends_inside(line, inside, sep, quote)
        if not inside:
            raw = b"\n".join(held) if len(held) > 1 else line
            held = []
            if heading:
                yield "head", path, layout, opened, block, raw
                heading = False
            elif skip and raw.removesuffix(b"\r"):
                skip = False
            else:
                yield "record", path, layout, None, block, raw
    yield from over()


def parse_lines(lines: DataFrame, dialect: Dialect, widths: Sequence[int | None], straddled: bool) -> DataFrame:
    """(path, layout, cells, text, reason) of all records of lines (path, block, line, opened, layout)."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for kind, path, layout, _, _, raw in _records(batches, dialect):
                if kind == "record":
                    parsed = parse_record(raw, dialect, widths[layout])
                    if parsed is not None:
                        yield path, layout, *parsed
                elif kind == "middle" or not straddled:
                    yield path, layout, None, raw.decode(dialect.encoding, "replace"), "open quote"

        yield from _batched(rows(), _OUT)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for kind, path, layout, opened, block, raw in _records(batches, dialect):
                if kind != "record":
                    yield path, layout, opened, block, b"" if kind == "middle" else raw, {"head": True, "tail": False}.get(kind)

        yield from _batched(rows(), _PIECE, size=1)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path, layout, parts in zip(*(batch.column(c).to_pylist() for c in ("path", "layout", "parts"))):
                    if len(parts) == 2 and parts[1]["closed"]:
                        parsed = parse_record(b"\n".join(p["raw"] for p in parts), dialect, widths[layout])
                        if parsed is not None:
                            yield path, layout, *parsed
                    else:
                        for p in parts:
                            if p["raw"]:
                                yield path, layout, None, p["raw"].decode(dialect.encoding, "replace"), "open quote"

        yield from _batched(rows(), _OUT)

    found = lines.mapInArrow(whole, _OUT_DDL)
    if not straddled:
        return found
    parts = F.sort_array(F.collect_list(F.struct("block", "raw", "closed"))).alias("parts")
    cut = lines.mapInArrow(pieces, _PIECE_DDL).groupBy("path", "opened").agg(F.first("layout").alias("layout"), parts)
    return found.unionByName(cut.mapInArrow(joined, _OUT_DDL))


def scan_records(spark: SparkSession, source: str | Sequence[str], dialect: Dialect, pattern: str | None = None, columns: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Records as (path, cells, text, reason), and the names of the cells.

    With ``columns`` cells go by position. Else each file's header names its cells: the columns of
    all files in order of their names' first file layout, null where a file lacks one.
    """
    lines = read_lines(spark, source, pattern)
    states = cut_lineage(split_states(split_notes(lines, dialect)))
    if columns is not None:
        layouts, names = [list(range(len(columns)))], list(columns)
        states = states.withColumn("layout", F.lit(0))
    else:
        heads = sorted(r["head"] for r in states.select("head").distinct().collect() if r["head"] is not None)
        headers = [header_names(h, dialect) for h in heads]
        names = list(dict.fromkeys(n for h in headers for n in h))
        layouts = [[names.index(n) for n in h] for h in headers]
        # files have few layouts, if many names; an empty file has none and no records either
        table = spark.createDataFrame([(h, i) for i, h in enumerate(heads)], "head binary, layout int")
        states = states.join(table, "head", "left").withColumn("layout", F.coalesce("layout", F.lit(0)))
    widths = [len(x) for x in layouts] or [0]
    states = states.select("path", "block", "opened", "layout")
    straddled = not states.filter("opened IS NOT NULL").isEmpty()
    if not straddled and len(layouts) <= 1:
        told = lines.select("*", F.lit(None).cast("bigint").alias("opened"), F.lit(0).alias("layout"))
    elif states.limit(SENT_SPLITS + 1).count() <= SENT_SPLITS:
        told = lines.join(F.broadcast(states), ["path", "block"])
    else:
        keys = ["path", "block"]
        told = lines.withColumn("_n", F.monotonically_increasing_id()).join(states, keys).repartition(*keys).sortWithinPartitions(*keys, "_n").drop("_n")
    parsed = parse_lines(told.select("path", "block", "line", "opened", "layout"), dialect, widths, straddled)
    if all(x == list(range(len(names))) for x in layouts):
        return parsed.drop("layout"), names
    # the place of each column in each layout, as one literal table
    where = F.array(*(F.array(*(F.lit(x.index(c) if c in x else None).cast("int") for c in range(len(names)))) for x in layouts))
    aligned = F.transform(F.get(where, F.col("layout")), lambda i: F.get("cells", i))
    return parsed.withColumn("cells", F.when(F.col("cells").isNotNull(), aligned)).drop("layout"), names
