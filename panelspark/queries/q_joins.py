"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, reshape
from ..session import cut_lineage
from .base import BALLOTS_SQL, PANEL_SQL, REGION_SQL, ballots, panel, region_panel, table
from .q_schema import _LONG_SQL, ALL_YEARS, yearly_wide
from .registry import query

KINDS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "j1_left_enrich",
    "SELECT l_orderkey, l_linenumber, l_partkey, s_name, n_name, p_brand FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN part ON l_partkey = p_partkey",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    s, n, p = table(spark, sf, "supplier"), table(spark, sf, "nation"), table(spark, sf, "part")
    joined = (
        lines.join(s, lines.l_suppkey == s.s_suppkey, "left")
        .join(n, s.s_nationkey == n.n_nationkey, "left")
        .join(p, lines.l_partkey == p.p_partkey, "left")
    )
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "s_name", "n_name", "p_brand")


@query(
    "j2_many_way_outer",
    "WITH a AS (SELECT o_custkey AS k, CAST(count(*) AS BIGINT) AS orders_n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), b AS (SELECT o_custkey AS k, CAST(count(*) AS BIGINT) AS urgent_n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey), "
    "c AS (SELECT user_id AS k, CAST(count(*) AS BIGINT) AS events_n FROM events GROUP BY user_id) SELECT coalesce(a.k, b.k, c.k) AS k, orders_n, urgent_n, events_n FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON coalesce(a.k, b.k) = c.k",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    done = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("orders_n"))
    urgent = o.where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("urgent_n"))
    seen = table(spark, sf, "events").groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("events_n"))
    return joins.outer_on_keys({"a": done, "b": urgent, "c": seen}, ["k"])


@query("j3_inner", "SELECT o_orderkey, l_linenumber, l_partkey, o_orderstatus, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return o.join(lines, o.o_orderkey == lines.l_orderkey).drop("l_orderkey")


@query(
    "j6_two_sided_lookup",
    "WITH e AS (SELECT DISTINCT l_orderkey, l_suppkey AS src, l_partkey AS dst FROM lineitem), v AS (SELECT s_suppkey AS k, s_acctbal AS x FROM supplier) "
    "SELECT l_orderkey, src, dst, a.x AS x_src, b.x AS x_dst FROM e JOIN v a ON a.k = src JOIN v b ON b.k = dst",
)
def _(spark, sf):
    pairs = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    values = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("x"))
    return joins.two_sided_lookup(pairs, values, "k", "x", "src", "dst").select("l_orderkey", "src", "dst", "x_src", "x_dst")


@query("j7_checked_join", "SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return joins.checked_join(o, c, ["o_custkey"], "left", "m:1")


@query(
    "j8_own_or_parent",
    "SELECT e.event_id, coalesce(o.c_acctbal, p.c_acctbal) AS c_acctbal FROM (SELECT event_id, user_id * 20 AS code, user_id AS parent FROM events) e LEFT JOIN customer o ON o.c_custkey = e.code LEFT JOIN customer p ON p.c_custkey = e.parent",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") * 20).alias("code"), F.col("user_id").alias("parent"))
    values = table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), "c_acctbal")
    return joins.own_or_parent(e, values, "code", "parent", "c_acctbal").select("event_id", "c_acctbal")


@query(
    "j9_crosswalk",
    "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(p_size + 1000000, l_partkey) AS code FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_brand < 'Brand#15') ON l_partkey = p_partkey",
)
def _(spark, sf):
    mapping = table(spark, sf, "part").where("p_brand < 'Brand#15'").select("p_partkey", (F.col("p_size") + 1000000).cast("bigint").alias("new_code"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").alias("code"))
    return joins.crosswalk(lines, mapping, "code", "p_partkey", "new_code")


@query("j10_anti_join", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)")
def _(spark, sf):
    seen = table(spark, sf, "events").select(F.col("user_id").alias("o_custkey"))
    return table(spark, sf, "orders").select("o_custkey").distinct().join(seen, "o_custkey", "left_anti")


@query("j11_semi_join", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def _(spark, sf):
    buyers = table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(buyers, "o_custkey", "left_semi")


@query(
    "j12_region_features",
    f"WITH {PANEL_SQL}, f AS (SELECT region, period, sum(size) AS region_size FROM panel WHERE kind <> 'BUILDING' GROUP BY region, period HAVING sum(size) > 10) SELECT entity, p.period, p.size, region_size FROM panel p JOIN f ON p.region = f.region AND p.period = f.period",
)
def _(spark, sf):
    p = panel(spark, sf).select("entity", "region", "kind", "period", "size")
    f = p.where("kind <> 'BUILDING'").groupBy("region", "period").agg(F.sum("size").alias("region_size")).where("region_size > 10")
    return p.drop("kind").join(f, ["region", "period"]).drop("region")


@query(
    "j13_asof_backfill",
    f"WITH {PANEL_SQL}, w AS (SELECT entity, y AS period FROM (SELECT DISTINCT entity FROM panel), (SELECT unnest(range(1995, 2005)) AS y)), "
    "m AS (SELECT w.entity, w.period, p.valid_amount, p.period AS f, row_number() OVER (PARTITION BY w.entity, w.period ORDER BY p.period DESC) AS k FROM w LEFT JOIN panel p ON p.entity = w.entity AND p.valid_amount IS NOT NULL AND p.period <= w.period AND p.period >= w.period - 3) "
    "SELECT entity, period, valid_amount, CAST(f AS BIGINT) AS valid_amount_from FROM m WHERE k = 1",
)
def _(spark, sf):
    facts = panel(spark, sf).select("entity", "period", "valid_amount")
    wanted = facts.select("entity").distinct().withColumn("period", F.explode(F.sequence(F.lit(1995).cast("bigint"), F.lit(2004).cast("bigint"))))
    return joins.latest_within(facts, wanted, ["entity"], "period", "valid_amount", 3)


@query(
    "j14_previous_event",
    f"WITH {BALLOTS_SQL}, d AS (SELECT DISTINCT kind, period FROM ballots WHERE kind <> 'BUILDING' OR period <> 1998) SELECT kind, period, lag(period, 1) OVER w AS previous, lag(period, 2) OVER w AS previousprevious FROM d WINDOW w AS (PARTITION BY kind ORDER BY period)",
)
def _(spark, sf):
    b = ballots(spark, sf).where("kind <> 'BUILDING' OR period <> 1998")
    return joins.previous_event(b, "kind", "period")


@query(
    "j14_previous_event_values",
    f"WITH {REGION_SQL}, x AS (SELECT * FROM rpanel WHERE kind <> 'BUILDING' OR period <> 1998), d AS (SELECT kind, period, lag(period) OVER (PARTITION BY kind ORDER BY period) AS previous FROM (SELECT DISTINCT kind, period FROM x)) "
    "SELECT x.region, x.kind, x.period, x.valid, y.valid AS previous_valid FROM x JOIN d ON x.kind = d.kind AND x.period = d.period LEFT JOIN x y ON y.region = x.region AND y.kind = x.kind AND y.period = d.previous",
)
def _(spark, sf):
    x = region_panel(spark, sf).where("kind <> 'BUILDING' OR period <> 1998").select("region", "kind", "period", "valid")
    before = x.select("region", "kind", F.col("period").alias("previous"), F.col("valid").alias("previous_valid"))
    dated = x.join(joins.previous_event(x, "kind", "period").drop("previousprevious"), ["kind", "period"])
    return dated.join(before, ["region", "kind", "previous"], "left").select("region", "kind", "period", "valid", "previous_valid")


@query(
    "j15_period_pairs",
    f"WITH {REGION_SQL} SELECT x.region, x.kind, x.period AS period_a, y.period AS period_b, x.valid AS valid_a, y.valid AS valid_b FROM rpanel x JOIN rpanel y ON x.region = y.region AND x.kind = y.kind AND x.period < y.period",
)
def _(spark, sf):
    pairs = joins.same_key_pairs(region_panel(spark, sf).select("region", "kind", "period", "valid"), ["region", "kind"], "period", "valid")
    return pairs.select(
        "region", "kind", F.col("a.t").alias("period_a"), F.col("b.t").alias("period_b"), F.col("a.v").alias("valid_a"), F.col("b.v").alias("valid_b")
    )


@query(
    "j16_year_back_columns",
    f"{_LONG_SQL}, s AS (SELECT entity, period + i AS period, CASE WHEN i = 0 THEN feature ELSE feature || '|minus_' || i END AS feature, raw FROM long, (SELECT unnest(range(0, 3)) AS i)) "
    "SELECT entity, period, "
    + ", ".join(f"max(raw) FILTER (WHERE feature = 'accounts/{n}{t}') AS \"raw_accounts/{n}{t}\"" for n in ("amount", "orders") for t in ("", "|minus_1", "|minus_2"))
    + " FROM s GROUP BY entity, period",
)
def _(spark, sf):
    long = reshape.unpivot_years(yearly_wide(spark, sf), "entity", "accounts")
    names = [f"accounts/{n}{t}" for n in ("amount", "orders") for t in ("", "|minus_1", "|minus_2")]
    return reshape.pivot_values(reshape.shift_periods(long, "period", "feature", 2), ["entity", "period"], "feature", names, ["raw"])


@query(
    "j17_side_by_side",
    f"WITH {REGION_SQL} SELECT region, "
    + ", ".join(f"sum(valid) FILTER (WHERE period = {y} AND kind = '{k}') AS valid_{k.lower()}_{y}" for k in KINDS for y in ALL_YEARS)
    + " FROM rpanel GROUP BY region",
)
def _(spark, sf):
    p = cut_lineage(region_panel(spark, sf).select("region", "kind", "period", "valid"))
    by_kind = {k: p.where(F.col("kind") == k).groupBy("region").pivot("period", ALL_YEARS).agg(F.first("valid")) for k in KINDS}
    parts = {k: t.select("region", *[F.col(f"`{y}`").alias(f"valid_{k.lower()}_{y}") for y in ALL_YEARS]) for k, t in by_kind.items()}
    return joins.outer_on_keys(parts, ["region"])


# entity codes 100..119 are arrondissements of city "9001", 120..139 of "9002"
_CITIES = {"9001": (100, 119), "9002": (120, 139)}


@query(
    "j18_district_mapping",
    f"WITH {PANEL_SQL}, e AS (SELECT CAST(entity AS VARCHAR) AS code, sum(vote_g) AS vote_g, sum(vote_d) AS vote_d FROM panel GROUP BY entity), "
    "c AS (SELECT '9001' AS code, sum(vote_g) AS vote_g, sum(vote_d) AS vote_d FROM e WHERE CAST(code AS BIGINT) BETWEEN 100 AND 119 UNION ALL SELECT '9002', sum(vote_g), sum(vote_d) FROM e WHERE CAST(code AS BIGINT) BETWEEN 120 AND 139), "
    "f AS (SELECT * FROM e UNION ALL SELECT * FROM c WHERE code NOT IN (SELECT code FROM e)), "
    "m AS (SELECT CAST(c_custkey AS VARCHAR) AS code, CAST(c_nationkey AS BIGINT) AS district FROM customer UNION ALL SELECT CASE WHEN c_custkey BETWEEN 100 AND 119 THEN '9001' ELSE '9002' END, CAST(1000 + c_nationkey AS BIGINT) FROM customer WHERE c_custkey BETWEEN 100 AND 139) "
    "SELECT code, district, vote_g, vote_d FROM f JOIN m USING (code)",
)
def _(spark, sf):
    votes = panel(spark, sf).groupBy(F.col("entity").cast("string").alias("code")).agg(F.sum("vote_g").alias("vote_g"), F.sum("vote_d").alias("vote_d"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("district"))
    own = c.select(F.col("c_custkey").cast("string").alias("code"), "district")
    inside = c.where("c_custkey BETWEEN 100 AND 139")
    city = inside.select(F.when(F.col("c_custkey") <= 119, "9001").otherwise("9002").alias("code"), (F.col("district") + 1000).alias("district"))
    return joins.districts_of(votes, own.unionByName(city), "code", _CITIES, ["vote_g", "vote_d"]).select("code", "district", "vote_g", "vote_d")


