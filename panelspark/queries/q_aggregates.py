"""Grouped aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates, reshape
from ..session import cut_lineage
from .base import BALLOTS_SQL, BLOCS, PANEL_SQL, REGION_SQL, ballots, panel, r, region_panel, stored_panel, table
from .q_schema import ALL_YEARS
from .registry import query

VOTES = [f"vote_{b}" for b in BLOCS]


@query(
    "a1_sorted_list",
    f"WITH {BALLOTS_SQL} SELECT entity, array_to_string(list_sort(list(DISTINCT bloc)), ',') AS blocs FROM ballots GROUP BY entity",
)
def _(spark, sf):
    out = aggregates.sorted_list(ballots(spark, sf), ["entity"], "bloc", "blocs")
    return out.withColumn("blocs", F.array_join("blocs", ","))


@query(
    "a2_list_of_structs",
    f"WITH {BALLOTS_SQL}, d AS (SELECT DISTINCT region, kind, period FROM ballots WHERE status = 'F') SELECT region, string_agg(kind || ':' || period, ',' ORDER BY kind, period) AS events FROM d GROUP BY region",
)
def _(spark, sf):
    done = ballots(spark, sf).where("status = 'F'")
    out = aggregates.sorted_list(done, ["region"], F.struct("kind", "period"), "events")
    text = F.transform("events", lambda e: F.concat(e["kind"], F.lit(":"), e["period"].cast("string")))
    return out.select("region", F.array_join(text, ",").alias("events"))


@query("a3_period_catalogue", f"WITH {BALLOTS_SQL} SELECT kind, array_to_string(list_sort(list(DISTINCT period)), ' ') AS periods FROM ballots GROUP BY kind")
def _(spark, sf):
    out = aggregates.sorted_list(ballots(spark, sf), ["kind"], "period", "periods")
    return out.select("kind", F.array_join(F.transform("periods", lambda p: p.cast("string")), " ").alias("periods"))


@query(
    "a4_keep_first",
    "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS k FROM orders) WHERE k = 1",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return aggregates.first_by(o, ["o_custkey"], ["o_orderpriority", "o_orderkey"])


@query(
    "a5_range_to_sequence",
    "SELECT l_partkey, unnest(range(a, b + 1)) AS period FROM (SELECT l_partkey, CAST(min(year(l_shipdate)) AS BIGINT) AS a, CAST(max(year(l_shipdate)) AS BIGINT) AS b FROM lineitem GROUP BY l_partkey)",
)
def _(spark, sf):
    y = F.year("l_shipdate").cast("bigint")
    ends = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min(y).alias("a"), F.max(y).alias("b"))
    return ends.select("l_partkey", F.explode(F.sequence("a", "b")).alias("period"))


@query(
    "a6_sum_two_keys",
    "SELECT l_suppkey, l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS votes, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS pvotes FROM lineitem GROUP BY l_suppkey, l_returnflag",
)
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("votes"), F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("pvotes")
    )


@query(
    "a7_national_totals",
    f"WITH {PANEL_SQL} SELECT sum(valid) AS tot_par, round(sum(valid) / sum(size), 8) AS tot_ppar, "
    + ", ".join(f"sum(vote_{b}) AS tot_vote_{b}, round(sum(vote_{b}) / sum(valid), 8) AS tot_pvote_{b}" for b in BLOCS)
    + " FROM panel",
)
def _(spark, sf):
    out = aggregates.totals_and_shares(panel(spark, sf), "size", "valid", {b: f"vote_{b}" for b in BLOCS})
    return out.select(*[r(c, 8).alias(c) for c in out.columns])


_SUMS = ", ".join(f"sum(vote_{b}) AS vote_{b}" for b in BLOCS)
_ARGMAX = "CASE greatest(vote_g, vote_cg, vote_c, vote_cd, vote_d) " + " ".join(f"WHEN vote_{b} THEN '{b}'" for b in BLOCS) + " END"


@query("a8_winner", f"WITH {PANEL_SQL}, t AS (SELECT {_SUMS} FROM panel) SELECT {_ARGMAX} AS winner FROM t")
def _(spark, sf):
    return aggregates.winner(panel(spark, sf), VOTES, BLOCS)


@query("a9_seats", f"WITH {PANEL_SQL}, t AS (SELECT entity, {_SUMS} FROM panel GROUP BY entity), w AS (SELECT {_ARGMAX} AS winner FROM t) SELECT winner, CAST(count(*) AS BIGINT) AS seats FROM w GROUP BY winner")
def _(spark, sf):
    return aggregates.seats(panel(spark, sf), "entity", VOTES, BLOCS)


@query(
    "a9_assembly_winner",
    f"WITH {PANEL_SQL}, t AS (SELECT entity, {_SUMS} FROM panel GROUP BY entity), w AS (SELECT {_ARGMAX} AS winner FROM t), s AS (SELECT winner, count(*) AS n FROM w GROUP BY winner) SELECT winner FROM s ORDER BY n DESC, list_position(['g', 'cg', 'c', 'cd', 'd'], winner) LIMIT 1",
)
def _(spark, sf):
    return aggregates.assembly_winner(panel(spark, sf), "entity", VOTES, BLOCS)


@query("a10_row_argmax", f"WITH {PANEL_SQL} SELECT entity, period, {_ARGMAX} AS winner FROM panel")
def _(spark, sf):
    return panel(spark, sf).select("entity", "period", S.row_argmax(VOTES, BLOCS).alias("winner"))


@query(
    "a11_agreement_and_mode",
    f"WITH {PANEL_SQL}, w AS (SELECT entity, period, {_ARGMAX} AS winner FROM panel), x AS (SELECT a.winner AS p, b.winner AS t FROM w a JOIN w b ON a.entity = b.entity AND a.period = b.period - 1), "
    "m AS (SELECT p, count(*) AS n FROM x GROUP BY p), k AS (SELECT t, count(*) AS n FROM x GROUP BY t) "
    "SELECT round(avg(CASE WHEN p = t THEN 1.0 ELSE 0.0 END), 8) AS agreement, (SELECT p FROM m ORDER BY n DESC, p LIMIT 1) AS predicted_mode, (SELECT t FROM k ORDER BY n DESC, t LIMIT 1) AS actual_mode FROM x",
)
def _(spark, sf):
    w = cut_lineage(panel(spark, sf).select("entity", "period", S.row_argmax(VOTES, BLOCS).alias("winner")))
    before = w.select("entity", (F.col("period") + 1).alias("period"), F.col("winner").alias("p"))
    x = cut_lineage(before.join(w.withColumnRenamed("winner", "t"), ["entity", "period"]))
    out = aggregates.agreement(x, "p", "t")
    return out.withColumn("agreement", r("agreement", 8))


@query(
    "a12_mean_poll",
    "WITH p AS (SELECT event_type, round(avg(value), 6) AS mean_poll FROM events GROUP BY event_type) SELECT event_id, e.event_type, mean_poll FROM events e LEFT JOIN p USING (event_type)",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    means = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_poll"))
    return e.drop("value").join(means, "event_type", "left")


@query(
    "a13_error_leaderboard",
    "WITH t AS (SELECT avg(value) AS truth FROM events), x AS (SELECT event_type, value - truth AS d FROM events, t) SELECT event_type, round(sqrt(avg(d * d)), 6) AS rmse, round(avg(abs(d)), 6) AS mae, round(avg(d), 6) AS bias, CAST(count(*) AS BIGINT) AS polls FROM x GROUP BY event_type ORDER BY rmse",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_type", "value")
    d = F.col("value") - F.col("truth")
    x = e.withColumn("truth", e.select(F.avg("value")).scalar()).withColumn("d", d)
    out = x.groupBy("event_type").agg(
        r(F.sqrt(F.avg(F.col("d") * F.col("d")))).alias("rmse"), r(F.avg(F.abs("d"))).alias("mae"), r(F.avg("d")).alias("bias"), F.count(F.lit(1)).alias("polls")
    )
    return out.orderBy("rmse")


@query(
    "a16_moments",
    "WITH x AS (SELECT l_returnflag, l_linestatus, l_discount AS v, l_quantity AS n, l_extendedprice AS w FROM lineitem), m AS (SELECT l_returnflag, l_linestatus, avg(v) AS mu FROM x GROUP BY 1, 2) "
    "SELECT l_returnflag, l_linestatus, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(avg(pow(v - mu, 3)) / pow(avg(pow(v - mu, 2)), 1.5), 6) AS skew, round(avg(pow(v - mu, 4)) / pow(avg(pow(v - mu, 2)), 2) - 3, 6) AS excess_kurtosis, round(sum(n) / sum(w), 10) AS weighted_mean FROM x JOIN m USING (l_returnflag, l_linestatus) GROUP BY 1, 2",
)
def _(spark, sf):
    out = aggregates.moments(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_discount", "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", "l_linestatus", *[r(c).alias(c) for c in ("mean", "sd", "skew", "excess_kurtosis")], r("weighted_mean", 10).alias("weighted_mean"))


@query(
    "a19_stability_matrix",
    f"WITH {PANEL_SQL}, p AS (SELECT a.period AS year1, b.period AS year2, a.amount AS v1, b.amount AS v2 FROM panel a JOIN panel b ON a.entity = b.entity AND a.period <> b.period) "
    "SELECT year1, year2, round(avg(abs(v1 - v2)), 3) AS mae, round(avg(abs(v1 - v2)) / avg(v1), 6) AS mape, round(quantile_cont(abs(v1 - v2), 0.5), 3) AS mad, round(avg((v1 - v2) * (v1 - v2)) / 1e6, 3) AS mse, round(sqrt(avg((v1 - v2) * (v1 - v2))), 3) AS rmse FROM p GROUP BY 1, 2",
)
def _(spark, sf):
    out = aggregates.stability_matrix(stored_panel(spark, sf, "entity", "period", "amount"), ["entity"], "period", "amount")
    return out.select("year1", "year2", r("mae", 3).alias("mae"), r("mape").alias("mape"), r("mad", 3).alias("mad"), r(F.col("mse") / 1e6, 3).alias("mse"), r("rmse", 3).alias("rmse"))


@query(
    "a20_mean_curve",
    f"WITH {REGION_SQL}, s AS (SELECT kind, region, avg(valid) AS c FROM rpanel GROUP BY kind, region) SELECT region, round(avg(c), 8) AS curve FROM s GROUP BY region",
)
def _(spark, sf):
    per = region_panel(spark, sf).groupBy("kind", "region").agg(F.avg("valid").alias("c"))
    return per.groupBy("region").agg(r(F.avg("c"), 8).alias("curve"))


@query(
    "a21_iqr_filter",
    "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem), x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity FROM lineitem, q WHERE l_extendedprice BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)), "
    "q2 AS (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.75) AS b FROM x) SELECT l_orderkey, l_linenumber, l_partkey FROM x, q2 WHERE l_quantity BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return aggregates.iqr_filter(lines, ["l_extendedprice", "l_quantity"], factor=0.5).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "a23_importance_percent",
    "WITH m AS (SELECT p_brand AS feature, CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS DOUBLE) / 5 AS importance FROM part GROUP BY p_brand) SELECT feature, importance, round(100 * importance / (SELECT sum(importance) FROM m), 8) AS percent FROM m",
)
def _(spark, sf):
    scored = table(spark, sf, "part").select(F.col("p_brand").alias("feature"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("score"))
    return aggregates.importance_percent(scored, "feature", "score", 5).withColumn("percent", r("percent", 8))


@query(
    "a24_importance_pivot",
    f"WITH {PANEL_SQL}, e AS (SELECT entity, period, valid_amount FROM panel), w AS (SELECT entity, "
    + ", ".join(f"max(valid_amount) FILTER (WHERE period = {y}) AS amount_{y}" for y in ALL_YEARS)
    + " FROM e GROUP BY entity) SELECT * FROM w WHERE " + " AND ".join(f"amount_{y} IS NOT NULL" for y in ALL_YEARS),
)
def _(spark, sf):
    years = [str(y) for y in ALL_YEARS]
    p = panel(spark, sf).select("entity", F.col("period").cast("string").alias("period"), F.col("valid_amount").alias("amount"))
    return reshape.pivot_values(p, ["entity"], "period", years, ["amount"]).na.drop("any")


@query("a26_value_counts", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
