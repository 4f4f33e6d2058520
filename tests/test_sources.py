import csv
import io
import random

import pytest
from pyspark.sql import types as T

from panelspark.sources import files, pages, records

PAIR = T.StructType([T.StructField("x", T.StringType()), T.StructField("n", T.IntegerType())])


def test_state_after_a_line():
    ends = lambda line, inside=False: records.ends_inside(line, inside, b",", b'"')
    assert ends(b'a,"b') == (True, False) and ends(b'a,"b"') == (False, True) and ends(b'a,"b""') == (True, False)
    assert ends(b'5" pipe,"x') == (True, False) and ends(b'5" pipe,3"') == (False, False)
    assert ends(b'more"",text', True) == (True, False) and ends(b'end",5"', True) == (False, True) and ends(b'end","new', True) == (True, True)


def test_latin1_header_and_values(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes('libellé;n\nforêt;1\nlibellé;n\n"deux\nlignes ""à"" droite; ";2\r\n\r\ncourt\ntrop;1;2\nmot;x\n'.encode("latin-1"))
    (tmp_path / "g.csv").write_bytes("autre;m\nété;3\nlibellé;4".encode("latin-1"))
    good, bad = files.scan_csv_tolerant(spark, str(tmp_path), PAIR, ";", "ISO-8859-1")
    assert sorted((r["x"], r["n"] or 0) for r in good.collect()) == [("court", 0), ('deux\nlignes "à" droite; ', 2), ("forêt", 1), ("libellé", 4), ("été", 3)]
    assert sorted((r["_corrupt"], r["reason"]) for r in bad.collect()) == [("libellé;n", "type"), ("mot;x", "type"), ("trop;1;2", "too many cells")]
    good, _ = files.scan_csv_tolerant(spark, str(tmp_path / "g.csv"), PAIR, ";", "ISO-8859-1", header=False)
    assert good.count() == 2


def test_charset_rejects_and_escapes(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes(b"\xef\xbb\xbfx,n\nok,1\nb\xe9,2\n\"open,3\nrest,4\n")
    good, bad = files.scan_csv_tolerant(spark, str(tmp_path), PAIR)
    assert [tuple(r) for r in good.collect()] == [("ok", 1)]
    assert sorted((r["_corrupt"], r["reason"]) for r in bad.collect()) == [('"open,3\nrest,4', "open quote"), ("b�,2", "charset")]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "f.csv").write_bytes(b"x,n\ncaf\\xe9 \\u2013 \xe9,1\n")
    good, _ = files.scan_csv_tolerant(spark, str(tmp_path / "g"), PAIR, encoding="unicode_escape")
    assert good.first()["x"] == "café – é"
    with pytest.raises(ValueError):
        records.Dialect(encoding="UTF-16")


@pytest.mark.parametrize("seed", [1, 2])
def test_records_over_split_ends(spark, tmp_path, seed):
    """Small splits: every record, whatever it holds, comes back once."""
    rnd = random.Random(seed)
    rows = [[str(i), "".join(rnd.choice(["é", "a", ",", '"', "\n", "\r\n", " ", "bc"]) for _ in range(rnd.choice([0, 3, 20, 90]))) or "-", str(i * 2)] for i in range(400)]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_MINIMAL).writerows([["i", "t", "j"], *rows])
    (tmp_path / "f.csv").write_bytes(out.getvalue().encode("latin-1"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        parsed, names = records.scan_records(spark, str(tmp_path), records.Dialect(encoding="ISO-8859-1"))
        got = parsed.collect()
        assert records.read_lines(spark, str(tmp_path)).select("block").distinct().count() > 20
        sent, records.SENT_SPLITS = records.SENT_SPLITS, 0
        assert sorted(map(str, records.scan_records(spark, str(tmp_path), records.Dialect(encoding="ISO-8859-1"))[0].collect())) == sorted(map(str, got))
    finally:
        records.SENT_SPLITS = 100_000
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert names == ["i", "t", "j"]
    assert sorted(r["cells"] for r in got if r["reason"] is None) == sorted(rows)
    assert all(r["reason"] is None for r in got)


def test_stray_quote_is_rejected_in_bounded_pieces(spark, tmp_path):
    lines = ["x,n", "a,1", '"stray,2', *(f"row {i} of some length,{i}" for i in range(200))]
    (tmp_path / "f.csv").write_text("\n".join(lines))
    (tmp_path / "g.csv").write_text("x,n\nb,2\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        good, bad = files.scan_csv_tolerant(spark, str(tmp_path), PAIR)
        assert sorted(tuple(r) for r in good.collect()) == [("a", 1), ("b", 2)]
        found = bad.collect()
        assert {r["reason"] for r in found} == {"open quote"} and len(found) > 5 and max(len(r["_corrupt"]) for r in found) < 1100
        assert sorted("\n".join(r["_corrupt"] for r in found).split("\n")) == sorted(lines[2:])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_tree_in_another_charset(spark, tmp_path):
    root = tmp_path / "in"
    for name, text, code in (("2017/f.csv", "libellé;voix\nforêt;1\n", "latin-1"), ("2018/f.csv", 'voix;libellé;"à\npart"\n2;été;x\n3;y;z;w\n', "latin-1")):
        (root / "pres" / name).parent.mkdir(parents=True)
        (root / "pres" / name).write_bytes(text.encode(code))
    bad = files.csv_tree_to_parquet(spark, str(root), f"{tmp_path}/out", ";", encoding="ISO-8859-1")
    got = {r["year"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert (got[2017]["libellé"], got[2017]["voix"], got[2017]["à\npart"]) == ("forêt", "1", None)
    assert (got[2018]["libellé"], got[2018]["voix"], got[2018]["à\npart"]) == ("été", "2", "x")
    assert [(r["_corrupt"], r["reason"]) for r in bad.collect()] == [("3;y;z;w", "too many cells")]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        files.csv_tree_to_parquet(spark, str(tmp_path / "none"), f"{tmp_path}/out2")


def rows_of(html):
    return [(n, title, header, cells) for n, title, header, _, cells in pages.page_tables(html)]


def test_nested_and_unclosed_tables():
    assert rows_of("<table><tr><td>outer<table><tr><td>inner</td></tr></table> end</td><td>b</td></tr></table>") == [(1, "table_1", ["0", "1"], ["outer end", "b"]), (2, "table_2", ["0"], ["inner"])]
    assert rows_of("<h2>T</h2><table><tr><th>A<tr><td>1<tr><td>2") == [(1, "T", ["A"], ["1"]), (1, "T", ["A"], ["2"])]
    assert rows_of("<table><td>a<table><tr><td>b<table><td>c") == [(1, "table_1", ["0"], ["a"]), (2, "table_2", ["0"], ["b"]), (3, "table_3", ["0"], ["c"])]
    assert rows_of("</td></tr></table><td>x<table></table><tr>") == []
    assert rows_of("<table><tr><td>a</td></tr><td>b</td></table>") == [(1, "table_1", ["0"], ["a"]), (1, "table_1", ["0"], ["b"])]
    assert rows_of(None) == rows_of("") == []


def test_captions_headings_and_parts():
    html = "<h1>H <i>one</i></h1><table><caption>Cap<table><caption>In</caption><td>i</table>tion</caption><tfoot><tr><td>sum</tr></tfoot><thead><tr><td>Date</td></tr></thead><tbody><tr><td>d</td></tr></tbody></table>"
    assert rows_of(html) == [(1, "Caption", ["Dates"], ["d"]), (1, "Caption", ["Dates"], ["sum"]), (2, "In", ["0"], ["i"])]
    assert rows_of("<table><thead><tr><th> </th></tr><tr><th>A</th></tr><tr><th>B</th></tr></thead><tr><td>1<script>x<td></script></td></tr></table>") == [(1, "table_1", ["B"], ["1"])]


def test_spans():
    html = "<table><tr><td rowspan=2>a<td>b<td rowspan=3>c<tr><td>d<tr><td>e</table>"
    assert [r[3] for r in rows_of(html)] == [["a", "b", "c"], ["a", "d", "c"], ["e", "c"]]
    assert [r[3] for r in rows_of("<table><tr><td colspan=2 rowspan=2>a<td>b<tr><td>c</table>")] == [["a", "a", "b"], ["a", "a", "c"]]
    assert len(rows_of("<table><tr><td colspan=99999999999>a</table>")[0][3]) == 1000
    assert [r[3] for r in rows_of("<table><tbody><tr><td rowspan=9>a<td>b<tbody><tr><td colspan=x rowspan=0>c</table>")] == [["a", "b"], ["c"]]


def grid(rnd, depth):
    """A table without spans as (rows of texts with inner tables), its html, and all tables in order."""
    rows = [[f"{rnd.randint(0, 99)}" for _ in range(rnd.randint(1, 3))] for _ in range(rnd.randint(1, 3))]
    html, inner = "<table>", []
    for row in rows:
        html += "<tr>"
        for i, text in enumerate(row):
            html += f"<td>{text}"
            if depth and rnd.random() < 0.4:
                sub, tables = grid(rnd, depth - 1)
                html += sub
                inner += tables
            html += rnd.choice(["</td>", ""])
        html += rnd.choice(["</tr>", ""])
    return html + "</table>", [rows, *inner]


@pytest.mark.parametrize("seed", range(30))
def test_random_nesting(seed):
    html, tables = grid(random.Random(seed), 3)
    found = {}
    for n, _, _, _, cells in pages.page_tables(html):
        found.setdefault(n, []).append(cells)
    assert [found[n] for n in sorted(found)] == tables
