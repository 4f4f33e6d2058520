"""Source and sink queries: the shared tables are written in the wanted layout and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import spatial
from ..operators.schema import split_annotations
from ..session import cut_lineage, shared_folder
from ..sources import files, pages
from .base import PANEL_SQL, panel, r, table
from .q_spatial import PLACES_SQL, places
from .registry import query


def scratch(spark) -> str:
    return f"{shared_folder(spark)}/layout-{uuid.uuid4().hex}"


@query("s1_parquet_scan", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_returnflag IN ('A', 'R') AND l_linestatus <> 'O'")
def _(spark, sf):
    filters = [("l_quantity", ">=", 30.0), ("l_returnflag", "in", ["A", "R"]), ("l_linestatus", "!=", "O")]
    return files.scan_parquet(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_quantity"], filters)


@query("s2_csv_scan", f"WITH {PANEL_SQL} SELECT entity, period, valid_amount FROM panel WHERE valid_amount IS NOT NULL")
def _(spark, sf):
    path = scratch(spark)
    files.write_csv(panel(spark, sf).select("entity", "period", "valid_amount"), path, ";")
    return files.scan_csv(spark, path, ";", "entity bigint, period bigint, valid_amount double", drop_null_rows=True)


@query(
    "s3_csv_tolerant",
    "SELECT 'good' AS kind, CAST(count(*) FILTER (WHERE o_orderstatus <> 'P') AS BIGINT) AS n FROM orders UNION ALL SELECT 'rejected', CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) FROM orders",
)
def _(spark, sf):
    path = scratch(spark)
    o = table(spark, sf, "orders")
    amount = F.when(F.col("o_orderstatus") == "P", F.lit("n/a,too,many")).otherwise(F.col("o_totalprice").cast("string"))
    o.select(F.concat_ws(",", "o_orderkey", amount).alias("value")).write.text(path)
    want = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.DoubleType())])
    good, bad = files.scan_csv_tolerant(spark, path, want, header=False)
    n = F.count(F.lit(1)).alias("n")
    return good.groupBy(F.lit("good").alias("kind")).agg(n).unionByName(bad.groupBy(F.lit("rejected").alias("kind")).agg(n))


def raw_csv(df, path, header, encoding="ISO-8859-1"):
    """Lines written as they are, in another charset, each file with the header.

    The writer would quote a line break, so a record of two lines is written as two rows.
    """
    out = df.select(F.explode(F.split("line", "\n")).alias(header)).write.option("header", True).option("encoding", encoding)
    out.option("quote", "").option("escapeQuotes", False).option("sep", "\u0001").csv(path)


# a label with accents, and for some a line break, quotes and a separator inside quotes
_LABEL_SQL = "CASE o_orderstatus WHEN 'F' THEN 'forêt ' || o_orderpriority ELSE 'deux' || chr(10) || 'lignes, \"à\" ' || o_orderpriority END"


def labelled_lines(spark, sf):
    """Orders as (line): good ones, ones with a cell too many, and some that equal the header."""
    o = table(spark, sf, "orders")
    label = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("forêt "), "o_orderpriority")).otherwise(F.concat(F.lit('"deux\nlignes, ""à"" '), F.col("o_orderpriority"), F.lit('"')))
    good = F.concat_ws(",", F.col("o_orderkey").cast("string"), label, F.year("o_orderdate").cast("string"))
    line = F.when(F.col("o_orderstatus") == "P", F.concat_ws(",", F.col("o_orderkey").cast("string"), F.lit("é"), F.lit("1"), F.lit("2"))).otherwise(good)
    return o.select(F.explode(F.when(F.col("o_orderkey") % 32 == 1, F.array(line, F.lit("clé,libellé,année"))).otherwise(F.array(line))).alias("line"))


@query(
    "s3_csv_latin1",
    f"SELECT CAST(o_orderkey AS BIGINT) AS k, {_LABEL_SQL} AS label, CAST(year(o_orderdate) AS INTEGER) AS year, NULL AS reason FROM orders WHERE o_orderstatus <> 'P' "
    "UNION ALL SELECT NULL, o_orderkey || ',é,1,2', NULL, 'too many cells' FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT NULL, 'clé,libellé,année', NULL, 'type' FROM orders WHERE o_orderkey % 32 = 1",
)
def _(spark, sf):
    path = scratch(spark)
    raw_csv(labelled_lines(spark, sf), path, "clé,libellé,année")
    want = T.StructType([T.StructField("k", T.LongType()), T.StructField("label", T.StringType()), T.StructField("year", T.IntegerType())])
    good, bad = files.scan_csv_tolerant(spark, path, want, encoding="ISO-8859-1")
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad.select("reason", F.col("_corrupt").alias("label")), allowMissingColumns=True)


@query(
    "s4_csv_tree_latin1",
    f"SELECT 'presidentiel' AS election_type, CAST(2017 AS INTEGER) AS year, CAST(o_orderkey AS VARCHAR) AS \"clé\", {_LABEL_SQL} AS \"libellé\", CAST(year(o_orderdate) AS VARCHAR) AS \"année\", NULL AS \"région\" FROM orders WHERE o_orderstatus <> 'P' "
    "UNION ALL SELECT 'presidentiel', 2017, 'clé', 'libellé', 'année', NULL FROM orders WHERE o_orderkey % 32 = 1 "
    "UNION ALL SELECT 'referendum', 2005, CAST(n_nationkey AS VARCHAR), 'côté ' || n_name, NULL, CAST(n_regionkey AS VARCHAR) FROM nation",
)
def _(spark, sf):
    source, target = scratch(spark), scratch(spark)
    raw_csv(labelled_lines(spark, sf), f"{source}/presidentiel/2017", "clé,libellé,année")
    line = F.concat_ws(",", F.concat(F.lit("côté "), "n_name"), F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"))
    raw_csv(table(spark, sf, "nation").select(line.alias("line")), f"{source}/referendum/2005", "libellé,région,clé")
    files.csv_tree_to_parquet(spark, source, target, encoding="ISO-8859-1")
    return spark.read.parquet(target).drop("source_file")


def event_tree(spark, sf, fmt):
    """The whole panel laid out by kind, year and event; even years have other columns, in another order."""
    root = scratch(spark)
    event = F.concat(F.lit("ev"), F.col("period").cast("string"), F.lit("_csv"))
    p = panel(spark, sf).withColumns({"code": event, "even": F.col("period") % 2 == 0})
    p = cut_lineage(p.select("entity", "kind", F.col("period").alias("year"), "code", "even", "size", "participants", "valid", "vote_g", "amount"))
    odd = p.where("NOT even").select("entity", "size", "participants", "valid", "vote_g", "kind", "year", "code")
    even = p.where("even").select("vote_g", "amount", "entity", "valid", "size", "kind", "year", "code")
    for rows in (odd, even):
        keys = ["kind", "year", "code"] if fmt == "parquet" else ["kind", "year"]
        out = (rows if fmt == "parquet" else rows.drop("code")).repartition(*keys).write.mode("append").partitionBy(*keys)
        out.parquet(root) if fmt == "parquet" else out.option("header", True).csv(root)
    return root


@query(
    "s4_csv_tree_to_parquet",
    f"WITH {PANEL_SQL} SELECT kind AS election_type, CAST(period AS INTEGER) AS year, CAST(entity AS VARCHAR) AS entity, CAST(size AS VARCHAR) AS size, CASE WHEN period % 2 = 1 THEN CAST(participants AS VARCHAR) END AS participants, CAST(valid AS VARCHAR) AS valid, CAST(vote_g AS VARCHAR) AS vote_g, CASE WHEN period % 2 = 0 THEN round(amount, 2) END AS amount FROM panel",
)
def _(spark, sf):
    target = scratch(spark)
    files.csv_tree_to_parquet(spark, event_tree(spark, sf, "csv"), target)
    return spark.read.parquet(target).drop("source_file").withColumn("amount", F.round(F.col("amount").cast("double"), 2))


@query(
    "s5_event_tree",
    f"WITH {PANEL_SQL} SELECT kind, period, 'ev' || period AS event, lpad(CAST(entity AS VARCHAR), 5, '0') AS entity, size, vote_g, CAST(NULL AS DOUBLE) AS vote_td FROM panel WHERE kind <> 'MACHINERY'",
)
def _(spark, sf):
    rows = files.scan_event_tree(spark, event_tree(spark, sf, "parquet"), {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4})
    return rows.select("kind", "period", "event", "entity", "size", "vote_g", "vote_td")


@query(
    "s6_route_by_level",
    "SELECT 'entity' AS level, CAST(count(*) AS BIGINT) AS n FROM customer UNION ALL SELECT 'region', CAST(count(*) AS BIGINT) FROM nation",
)
def _(spark, sf):
    root = scratch(spark)
    for name, source in {"communes_pop": "customer", "departements_pop": "nation", "codes_communes": "region"}.items():
        table(spark, sf, source).write.parquet(f"{root}/{name}.parquet")
    out = None
    for level, paths in files.route_by_level(spark, root).items():
        for path in paths:
            part = spark.read.parquet(path).select(F.lit(level).alias("level"))
            out = part if out is None else out.unionByName(part)
    return out.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s7_link_layout",
    "WITH l AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'pres' WHEN 'O' THEN 'leg' ELSE 'age' END AS p, year(o_orderdate) AS y, o_orderkey AS k FROM orders), "
    "n AS (SELECT p || y || 't' || k AS code, p, y FROM l UNION ALL SELECT 'leg1946Nov', 'leg', 1946 FROM l UNION ALL SELECT 'leg1871juil', 'leg', 1871 FROM l), "
    "m AS (SELECT 'https://x.example.org/' || code || CASE WHEN p = 'age' THEN '_csp.zip' ELSE '_csv.zip' END AS url, CASE p WHEN 'pres' THEN 'presidentiel' WHEN 'leg' THEN 'legislative' END AS kind, CASE WHEN p <> 'age' THEN y + CASE WHEN y < 1995 THEN 1 ELSE 0 END END AS year, CASE WHEN y < 1995 THEN left(code, 7) ELSE code END AS code FROM n) "
    "SELECT url, kind, CAST(year AS INTEGER) AS year, code, concat_ws('/', kind, year, code) AS target FROM m",
)
def _(spark, sf):
    s = F.col("o_orderstatus")
    prefix = F.when(s == "F", "pres").when(s == "O", "leg").otherwise("age")
    end = F.when(s.isin("F", "O"), "_csv.zip").otherwise("_csp.zip")
    link = F.concat(F.lit("https://x.example.org/"), prefix, F.year("o_orderdate").cast("string"), F.lit("t"), F.col("o_orderkey").cast("string"), end)
    # archives glued into one text: of all kinds, of no known kind, late ones, and other files
    late = "https://x.example.org/leg1946Nov_csv.ziphttps://x.example.org/readme.pdfhttps://x.example.org/leg1871juil_csv.zip"
    text = F.concat(link, F.lit(late))
    return files.link_layout(table(spark, sf, "orders").select(text.alias("links")), "links")


@query(
    "s8_geojson",
    f"WITH {PLACES_SQL} SELECT CAST(entity AS VARCHAR) AS code, 'n' || entity AS name, round(lat, 8) AS lat, round(long, 8) AS long FROM places",
)
def _(spark, sf):
    path = scratch(spark)
    x, y = F.col("long"), F.col("lat")
    ring = F.array(*[F.array(x + a, y + b) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
    simple = F.col("entity") % 2 == 0
    geometry = F.when(
        simple, F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    ).otherwise(F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring)).alias("coordinates"))))
    head = F.concat(F.lit('{"features":[{"properties":{"code":"'), F.col("entity").cast("string"), F.lit('","name":"n'), F.col("entity").cast("string"), F.lit('"},"geometry":'))
    doc = places(spark, sf).select(F.concat(head, geometry, F.lit("}]}")).alias("value"))
    doc.write.text(path)
    out = spatial.polygon_centroids(pages.scan_geojson(spark, path, one_per_line=True), "code", "polygons")
    return out.select("code", "name", r("lat", 8).alias("lat"), r("long", 8).alias("long"))


@query(
    "s9_html_tables",
    "SELECT event_id AS page_id, CAST(1 AS INTEGER) AS table_no, 'Sondages ' || event_id AS title, event_type AS \"Sondeur\", CAST(CAST(ts AS DATE) AS VARCHAR) AS \"Dates\" FROM events UNION ALL SELECT event_id, CAST(2 AS INTEGER), 'Sondages ' || event_id || ' (2)', CAST(user_id AS VARCHAR), 'a & b' FROM events",
)
def _(spark, sf):
    who, day = F.col("event_id").cast("string"), F.to_date("ts").cast("string")
    text = [
        F.lit("<h2>Sondages "), who, F.lit("</h2><table><thead><tr><th colspan=2>Tout</th></tr><tr><th>Sondeur</th><th>Date</th></tr></thead><tr><td>"),
        F.col("event_type"), F.lit("</td><td>"), day, F.lit("</td></tr><tr><td></td><td> </td></tr></table><table><caption>Sondages "), who,
        F.lit("</caption><tr><th>Sondeur</th><th>Dates</th></tr><tr><td>"), F.col("user_id").cast("string"), F.lit("</td><td>a &amp; b</td></tr></table>"),
    ]
    # the narrow rows are dealt out: a file of few row groups would leave the pages to few tasks
    events = table(spark, sf, "events").select("event_id", "ts", "event_type", "user_id").repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    html = events.select(F.col("event_id").alias("page_id"), F.concat(*text).alias("html"))
    return pages.table_columns(pages.scan_html_tables(html), ["Sondeur", "Dates"]).drop("row_no")


@query(
    "s9_pages_tables",
    "WITH p AS (SELECT page_id, url, CAST(page_id % 3 AS INTEGER) AS k FROM pages) "
    "SELECT page_id, 1 AS table_no, 'Page' AS title, 'Adresse|Rang|Dates' AS header, 0 AS row_no, url || '|' || page_id || '|hier' AS cells FROM p "
    "UNION ALL SELECT page_id, 1, 'Page', 'Adresse|Rang|Dates', 1, 'a & b|' || page_id || '|x' FROM p "
    "UNION ALL SELECT page_id, 2, 'Page (2)', 'clé|valeur', 0, 'k|' || k FROM p UNION ALL SELECT page_id, 3, 'Dernier', '0', 0, url || ' fin' FROM p WHERE k < 2 UNION ALL SELECT page_id, 4, 'Page (3)', '0', 0, 'dedans' FROM p WHERE k = 0",
)
def _(spark, sf):
    """Tables around what the pages hold: a span, an inner table with its own header, missing end tags, a table never closed."""
    url, k = F.replace("url", F.lit("&"), F.lit("&amp;")), F.col("page_id") % 3
    inner = F.concat(F.lit("<table><tr><th>clé<th>valeur<tr><td>k<td>"), k.cast("string"), F.lit("</table>"))
    last = F.when(k == 0, F.concat(F.lit("<table><caption>Dernier</caption><td>"), url, F.lit("<table><td>dedans</table> fin"))).when(k == 1, F.concat(F.lit("<table><caption>Dernier</caption><tr><td>"), url, F.lit(" fin"))).otherwise("")
    text = F.concat(
        F.lit("<h2>Page</h2><table><thead><tr><th colspan=3> </th></tr><tr><th>Adresse</th><th>Rang</th><th>Date</th></tr></thead><tbody><tr><td>"), url, F.lit("</td><td rowspan=2>"), F.col("page_id").cast("string"),
        inner, F.lit("</td><td>hier</tr><tr><td>a &amp; b</td><td>x</td></tr></tbody></table>"), last,
    )
    rows = pages.scan_html_tables(table(spark, sf, "pages").select("page_id", text.alias("html")))
    return rows.withColumns({c: F.array_join(c, "|") for c in ("header", "cells")})


@query(
    "p27_page_annotations",
    "SELECT event_type, 'note' AS kind, CAST(count(*) AS BIGINT) AS n FROM events WHERE value > 5 GROUP BY event_type UNION ALL SELECT event_type, 'data', CAST(count(*) AS BIGINT) FROM events GROUP BY event_type",
)
def _(spark, sf):
    """Each page has a row of data, and some a note over all columns."""
    kind = F.col("event_type")
    note = F.when(F.col("value") > 5, F.concat(F.lit("<tr><td colspan=3>"), kind, F.lit("</td></tr>"))).otherwise("")
    html = F.concat(F.lit("<table><tr><th>a<th>b<th>c</tr>"), note, F.lit("<tr><td>"), kind, F.lit("<td></td><td>x"))
    rows = pages.scan_html_tables(table(spark, sf, "events").select(F.col("event_id").alias("page_id"), html.alias("html")))
    data, notes = split_annotations(rows, "cells")
    both = [d.select(F.get("cells", F.lit(0)).alias("event_type"), F.lit(k).alias("kind")) for d, k in ((notes, "note"), (data, "data"))]
    return both[0].unionByName(both[1]).groupBy("event_type", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s10_nested_polls",
    "WITH t AS (SELECT user_id AS poll, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'Autres' END AS candidate, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS v FROM events GROUP BY 1, 2) SELECT poll, round(max(v) FILTER (WHERE candidate = 'click'), 6) AS click, round(max(v) FILTER (WHERE candidate = 'view'), 6) AS \"view\", round(max(v) FILTER (WHERE candidate = 'Autres'), 6) AS \"Autres\" FROM t GROUP BY poll",
)
def _(spark, sf):
    cents = (F.sum(F.round(F.col("value") * 100).cast("bigint")).cast("double") / 100).alias("v")
    sums = table(spark, sf, "events").groupBy(F.col("user_id").alias("poll"), "event_type").agg(cents)
    cand = F.struct(F.col("event_type").alias("candidat"), F.array(F.lit("p")).alias("parti"), F.col("v").alias("intentions"), F.lit(1.0).alias("erreur_sup"), F.lit(1.0).alias("erreur_inf"))
    per = sums.groupBy("poll").agg(F.collect_list(cand).alias("c"))
    hyp = F.array(F.struct(F.lit(1000).cast("bigint").alias("sous_echantillon"), F.col("c").alias("candidats")))
    tours = F.array(F.struct(F.lit("Premier tour").alias("tour"), hyp.alias("hypotheses")), F.struct(F.lit("Deuxième tour").alias("tour"), hyp.alias("hypotheses")))
    text = per.select("poll", F.to_json(F.struct(tours.alias("tours"))).alias("json"))
    nested = text.select("poll", F.from_json("json", pages.POLL_SCHEMA).alias("_j")).select("poll", "_j.tours")
    wide = pages.polls_wide(pages.explode_polls(nested, ["poll"], ["click", "view"]), ["poll"], ["click", "view"])
    return wide.select("poll", *[r(c).alias(c) for c in ("click", "view", "Autres")])


@query("s11_read_partition", "SELECT o_orderkey, CAST(3 AS BIGINT) AS distance_bin, 300000.0 AS lower, 400000.0 AS upper FROM orders WHERE o_totalprice >= 300000 AND o_totalprice < 400000")
def _(spark, sf):
    path = scratch(spark)
    o = table(spark, sf, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 100000).cast("int").alias("distance_bin"))
    files.write_partitioned(o, path, "distance_bin", files_per_key=4)
    bounds = spark.createDataFrame([(i, i * 1e5, (i + 1) * 1e5) for i in range(6)], "distance_bin int, lower double, upper double")
    out = files.read_partition(spark, path, "distance_bin", 3, bounds)
    return out.select("o_orderkey", F.col("distance_bin").cast("bigint").alias("distance_bin"), "lower", "upper")


@query("s12_partitioned_sink", "SELECT year(o_orderdate) AS period, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def _(spark, sf):
    path = scratch(spark)
    files.write_partitioned(table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("period")), path, "period", files_per_key=2)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("period").cast("bigint").alias("period")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("s13_parquet_sink", f"WITH {PANEL_SQL} SELECT entity, period, amount FROM panel")
def _(spark, sf):
    path = files.write_parquet(panel(spark, sf).select("entity", "period", "amount"), scratch(spark), "processed")
    return spark.read.parquet(path)


@query("s14_csv_sink", f"WITH {PANEL_SQL} SELECT entity, period, size FROM panel")
def _(spark, sf):
    path = scratch(spark)
    files.write_csv(panel(spark, sf).select("entity", "period", "size"), path)
    return files.scan_csv(spark, path, schema="entity bigint, period bigint, size double")


@query("s15_build_once", f"WITH {PANEL_SQL} SELECT kind, sum(size) AS size FROM panel GROUP BY kind")
def _(spark, sf):
    """The second build would give other sums, and must not run."""
    path = scratch(spark)
    build = lambda times: lambda: panel(spark, sf).groupBy("kind").agg((F.sum("size") * times).alias("size"))
    files.build_once(spark, path, build(1))
    return files.build_once(spark, path, build(2))


_TYPES = {
    "AUTOMOBILE": {"type": "count", "unit": "orders", "level": "entity", "years": [1995, 1996]},
    "BUILDING": {"type": "proportion", "unit": "percent", "level": "entity", "years": [1997]},
    "FURNITURE": {"type": "count", "unit": "orders", "level": "region", "years": []},
}


@query(
    "s18_feature_catalogue",
    "SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'count' WHEN 'BUILDING' THEN 'proportion' WHEN 'FURNITURE' THEN 'count' END AS type, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'entity' WHEN 'BUILDING' THEN 'entity' WHEN 'FURNITURE' THEN 'region' END AS level FROM customer",
)
def _(spark, sf):
    catalogue = files.feature_catalogue(spark, _TYPES)
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("feature"))
    return c.join(catalogue, "feature", "left").select("c_custkey", "type", "level")

