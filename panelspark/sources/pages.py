"""Tables inside HTML pages, GeoJSON features and nested poll JSON."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PARTS = {"thead", "tbody", "tfoot"}


# The largest spans that HTML allows.
_MOST_COLUMNS, _MOST_ROWS = 1000, 65534


@dataclass(slots=True)
class _Cell:
    header: bool
    columns: int
    rows: int
    parts: list[str] = field(default_factory=list)

    @property
    def text(self) -> str | None:
        return _one_line(self.parts) or None


@dataclass(slots=True)
class _Table:
    """One open table: its title and rows, and the cell that is being read."""

    order: int
    heading: str
    caption: list[str] | None = None
    in_caption: bool = False
    cell: _Cell | None = None
    row: list[_Cell] | None = None
    part: str = ""
    #: (part, number of the part, cells) of each row; a part is thead, tbody, tfoot or none
    rows: list[tuple[str, int, list[_Cell]]] = field(default_factory=list)
    parts: int = 0

    def start_part(self, part: str) -> None:
        self.cell = self.row = None
        self.part, self.parts = part, self.parts + 1

    def start_row(self) -> None:
        self.cell, self.row = None, []
        self.rows.append((self.part, self.parts, self.row))

    def start_cell(self, header: bool, attrs: list[tuple[str, str | None]]) -> None:
        if self.row is None:
            self.start_row()
        if not attrs:
            self.cell = _Cell(header, 1, 1)
            self.row.append(self.cell)
            return
        span = {k: int(v) for k, v in attrs if k in ("colspan", "rowspan") and v and v.isascii() and v.isdigit()}
        self.cell = _Cell(header, min(max(1, span.get("colspan", 1)), _MOST_COLUMNS), min(max(1, span.get("rowspan", 1)), _MOST_ROWS))
        self.row.append(self.cell)


def _one_line(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


#: A tag without anything unusual: a short name, attributes with plain values.
_PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \n]+[a-zA-Z]+=(?:[a-zA-Z0-9]+|"[^"<>&=]*"))*)>""")
_PLAIN_ATTRIBUTE = re.compile(r"""([a-zA-Z]+)=(?:([a-zA-Z0-9]+)|"([^"]*)")""")
#: Elements whose content is not read as tags, or by rules of its own.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext", "svg", "math"}


class _Collector:
    """Collects the tables of one page.

    Tables may stand in cells of others: tags and texts belong to the innermost open table. Missing
    end tags are supplied by the next row, cell or part, and by the end of the page.
    """

    def __init__(self) -> None:
        self.heading, self.into_heading = "", None
        self.open: list[_Table] = []
        self.done: list[_Table] = []
        self.hidden = None

    def handle_starttag(self, tag, attrs):
        top = self.open[-1] if self.open else None
        if top is not None and tag in ("td", "th"):
            top.in_caption = False
            top.start_cell(tag == "th", attrs)
        elif top is not None and tag == "tr":
            top.in_caption = False
            top.start_row()
        elif tag in ("script", "style"):
            self.hidden = tag
        elif tag in _HEADINGS:
            self.into_heading = []
        elif tag == "table":
            self.open.append(_Table(len(self.done) + len(self.open), self.heading))
        elif tag == "br":
            self.handle_data(" ")
        elif top is None:
            return
        elif tag == "caption":
            top.cell = top.row = None
            if top.caption is None:
                top.caption, top.in_caption = [], True
        elif tag in _PARTS:
            top.in_caption = False
            top.start_part(tag)

    def handle_endtag(self, tag):
        top = self.open[-1] if self.open else None
        if top is not None and tag in ("td", "th"):
            top.cell = None
        elif top is not None and tag == "tr":
            top.cell = top.row = None
        elif tag == self.hidden:
            self.hidden = None
        elif tag in _HEADINGS and self.into_heading is not None:
            self.heading, self.into_heading = _one_line(self.into_heading), None
        elif top is None:
            return
        elif tag == "caption":
            top.in_caption = False
        elif tag in _PARTS:
            top.start_part("")
        elif tag == "table":
            self.done.append(self.open.pop())

    def handle_data(self, data):
        if self.hidden:
            return
        if self.into_heading is not None:
            self.into_heading.append(data)
        top = self.open[-1] if self.open else None
        if top is not None and top.in_caption:
            top.caption.append(data)
        elif top is not None and top.cell is not None:
            top.cell.parts.append(data)

    def end(self) -> list[_Table]:
        """The tables, those that were never closed too."""
        while self.open:
            self.done.append(self.open.pop())
        return self.done


class _Tables(_Collector, HTMLParser):
    def __init__(self) -> None:
        HTMLParser.__init__(self, convert_charrefs=True)
        _Collector.__init__(self)


def _read(html: str) -> list[_Table]:
    """The tables of a page. Where all its tags are plain, they are found by one search; other pages are parsed."""
    tokens = _PLAIN_TAG.split(html)
    if html.count("<") == len(tokens) // 4:
        tags = [t.lower() for t in tokens[2::4]]
        if _RAW.isdisjoint(tags):
            page = _Collector()
            start, end, data = page.handle_starttag, page.handle_endtag, page.handle_data
            if tokens[0]:
                data(unescape(tokens[0]))
            for close, tag, attributes, text in zip(tokens[1::4], tags, tokens[3::4], tokens[4::4]):
                if not close:
                    start(tag, [(name.lower(), plain or quoted) for name, plain, quoted in _PLAIN_ATTRIBUTE.findall(attributes)] if attributes else ())
                elif attributes:
                    break
                else:
                    end(tag)
                if text:
                    data(unescape(text))
            else:
                return page.end()
    parser = _Tables()
    parser.feed(html)
    parser.close()
    return parser.end()


def _spread(rows: list[list[_Cell]]) -> list[tuple[bool, list]]:
    """Cells by column, those that span several repeated; whether all are header cells.

    A cell from above comes before the row's own cell that reaches its column; those further right
    than the row goes follow at its end.
    """
    if not any([c.rows > 1 or c.columns > 1 for row in rows for c in row]):
        return [(all([c.header for c in row]), [c.text for c in row]) for row in rows if row]
    above: list[tuple[int, _Cell, int]] = []
    out = []
    for row in rows:
        cells: list[_Cell] = []
        below: list[tuple[int, _Cell, int]] = []

        def take(up_to: int | None) -> None:
            while above and (up_to is None or above[0][0] <= len(cells)):
                at, cell, left = above.pop(0)
                cells.append(cell)
                if left > 1:
                    below.append((at, cell, left - 1))

        for cell in row:
            take(len(cells))
            for _ in range(cell.columns):
                if cell.rows > 1:
                    below.append((len(cells), cell, cell.rows - 1))
                cells.append(cell)
        take(None)
        above = sorted(below, key=lambda x: x[0])
        if cells:
            out.append((all(c.header for c in cells), [c.text for c in cells]))
    return out


def _header_and_rows(table: _Table) -> tuple[list, list[list]]:
    """Header cells and data rows: the header is the part named so, else the first rows of header cells only."""
    parts: dict[int, tuple[str, list]] = {}
    for part, number, cells in table.rows:
        parts.setdefault(number, (part, []))[1].append(cells)
    spread = [(part, row) for part, rows in parts.values() for row in _spread(rows)]
    top = [row for part, (_, row) in spread if part == "thead"]
    body = [r for part, r in spread if part not in ("thead", "tfoot")] + [r for part, r in spread if part == "tfoot"]
    if not top:
        while body and body[0][0]:
            top.append(body.pop(0)[1])
    data = [c for _, c in body if any(v is not None for v in c)]
    named = [c for c in top if any(v is not None for v in c)] or top
    if named:
        return named[min(1, len(named) - 1)], data
    return [str(i) for i in range(max(map(len, data), default=0))], data


def page_tables(html: str) -> list[tuple[int, str, list, int, list]]:
    """(table number, title, header, row number, cells) of every data row of a page, tables by where they begin."""
    out, seen = [], {}
    for number, table in enumerate(sorted(_read(html or ""), key=lambda t: t.order), start=1):
        title = _one_line(table.caption or []) or table.heading or f"table_{number}"
        seen[title] = seen.get(title, 0) + 1
        title = title if seen[title] == 1 else f"{title} ({seen[title]})"
        header, data = _header_and_rows(table)
        header = ["Dates" if h == "Date" else h for h in header]
        out += [(number, title, header, i, c) for i, c in enumerate(data)]
    return out


#: Pages whose rows a task holds at once.
_PAGES = 1024


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lists = pa.list_(pa.string())
    for whole in batches:
        for start in range(0, whole.num_rows, _PAGES):
            batch = whole.slice(start, _PAGES)
            rows = [(i, *row) for i, html in enumerate(batch.column("html").to_pylist()) for row in page_tables(html)]
            at, numbers, titles, headers, inside, cells = zip(*rows) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id").take(pa.array(at, pa.int64())),
                    *(pa.array(c, t) for c, t in ((numbers, pa.int32()), (titles, pa.string()), (headers, lists), (inside, pa.int32()), (cells, lists))),
                ],
                names=["page_id", "table_no", "title", "header", "row_no", "cells"],
            )


def scan_html_tables(pages: DataFrame) -> DataFrame:
    """Rows of all tables of the pages (page_id, html), one Arrow batch of pages at a time, no shuffle."""
    schema = "page_id bigint, table_no int, title string, header array<string>, row_no int, cells array<string>"
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(_parse, schema)


def table_columns(rows: DataFrame, names: list[str], surplus: str | None = None) -> DataFrame:
    """Named columns from header and cells; a name absent in a table, or a cell absent in a row, is null.

    Of columns with one name the first is taken. ``surplus`` names a column for the cells
    beyond the header.
    """
    cell = lambda n: F.get("cells", F.array_position("header", F.lit(n)).cast("int") - 1)
    rest = F.when(F.size("cells") > F.size("header"), F.slice("cells", F.size("header") + 1, F.size("cells"))).otherwise(F.array().cast("array<string>"))
    return rows.select("page_id", "table_no", "title", "row_no", *[cell(n).alias(n) for n in names], *([rest.alias(surplus)] if surplus else []))


# ---- GeoJSON ----

_RING = "array<array<array<double>>>"


def polygons_of(geometry: str = "geometry"):
    """array<polygon> of a Polygon or MultiPolygon geometry given as JSON text."""
    kind = F.get_json_object(geometry, "$.type")
    coords = F.get_json_object(geometry, "$.coordinates")
    return F.when(kind == "Polygon", F.array(F.from_json(coords, _RING))).when(kind == "MultiPolygon", F.from_json(coords, f"array<{_RING}>"))


def scan_geojson(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """(code, name, polygons) of every feature of GeoJSON files.

    A file holding one document is read whole by one task; collections written one per
    line (``one_per_line``) split like text.
    """
    schema = "features array<struct<properties: struct<code: string, name: string>, geometry: string>>"
    raw = spark.read.schema(schema).option("multiLine", not one_per_line).json(path)
    f = raw.select(F.explode("features").alias("_f")).select("_f.properties.code", "_f.properties.name", F.col("_f.geometry").alias("geometry"))
    return f.select("code", "name", polygons_of("geometry").alias("polygons"))


# ---- nested polls ----

# Field names of the nested polls.
POLL_SCHEMA = (
    "tours array<struct<tour: string, hypotheses: array<struct<sous_echantillon: bigint, candidats: array<struct<"
    "candidat: string, parti: array<string>, intentions: double, erreur_sup: double, erreur_inf: double>>>>>>"
)


def explode_polls(polls: DataFrame, keys: list[str], candidates: list[str], first_round: str = "Premier tour") -> DataFrame:
    """First-round intentions per (poll, scenario, candidate); unknown candidates are summed under Autres."""
    rounds = polls.select(*keys, F.explode("tours").alias("_t")).where(F.col("_t.tour") == first_round)
    scenarios = rounds.select(*keys, F.posexplode("_t.hypotheses").alias("scenario", "_h"))
    rows = scenarios.select(*keys, "scenario", F.col("_h.sous_echantillon").alias("sample"), F.explode("_h.candidats").alias("_c"))
    name = F.when(F.col("_c.candidat").isin(candidates), F.col("_c.candidat")).otherwise(F.lit("Autres"))
    return rows.groupBy(*keys, "scenario", "sample", name.alias("candidate")).agg(F.sum("_c.intentions").alias("intentions"))


def polls_wide(long: DataFrame, keys: list[str], candidates: list[str]) -> DataFrame:
    names = [*candidates, "Autres"]
    return long.groupBy(*keys, "scenario", "sample").pivot("candidate", names).agg(F.first("intentions"))
