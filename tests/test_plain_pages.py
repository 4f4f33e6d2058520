"""Pages of plain tags are read by one search, with the same tables as the parser gives."""

import random

import pytest

from panelspark.sources import pages

PARTS = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "</TH>", "<td rowspan=2>", '<TD COLSPAN="3" class="a b">', "<td colspan=2\nrowspan=x>", "<thead>", "</thead>", "<tbody>", "<tfoot>", "<caption>", "</caption>", "<h2>", "</h2>", "<H3>", "</h3>", "<br>", "<i>", "</i>", "Date", " a \n b ", "x &amp; y", "&lt;td&gt;", "&notit;", "1 > 0", "\x1c\u00a0z", "&", "&#233"]
ODD = ["<td", "<br/>", "<!-- <td> -->", "<script>if (a<b) x</script>", "</td x=1>", "a < b", "<td title='<tr>'>", "<style>", "<textarea><td></textarea>", "<td a=1 a>", "<?x>", "<title>t</title>", "</>", "<td colspan = 2>"]


def parsed(html, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(pages, "_RAW", {"table", "td", "tr", "br", "i", "h2", *pages._RAW})
        return pages.page_tables("<br>" + html)


@pytest.mark.parametrize("parts", [PARTS, PARTS + ODD])
def test_equal_to_the_parser(parts, monkeypatch):
    rnd = random.Random(len(parts))
    for _ in range(3000):
        html = "<br>" + "".join(rnd.choice(["", "<table>"])) + "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))
        assert pages.page_tables(html) == parsed(html[4:], monkeypatch), html


def test_plain_pages_need_no_parser(monkeypatch):
    monkeypatch.setattr(pages, "_Tables", None)
    html = '<h2>T</h2><table class="a"><tr><th colspan=2>Top</th></tr><tr><th>Date</th><th>A &amp; B</th></tr><tr><td>1 > 0</td><td> x\n y</td></tr></table>'
    assert pages.page_tables(html) == [(1, "T", ["Dates", "A & B"], 0, ["1 > 0", "x y"])]
    assert pages.page_tables(None) == pages.page_tables("no tags") == []


def test_rows_of_pages_with_nulls(spark):
    rows = [(None, "<table><td>a"), (2**60 + 1, "<table><tr><th>h<th>i<tr><td>b<td>"), (3, None), (4, "")]
    got = pages.scan_html_tables(spark.createDataFrame(rows, "page_id bigint, html string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(None, 1, "table_1", ["0"], 0, ["a"]), (2**60 + 1, 1, "table_1", ["h", "i"], 0, ["b", None])], key=repr)
    assert pages.scan_html_tables(spark.createDataFrame([], "page_id int, html string")).count() == 0
