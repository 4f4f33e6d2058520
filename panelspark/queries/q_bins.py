"""Binning and binned-statistics queries, and parametric fits on binned points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import binning, scalars as S
from ..operators import aggregates, bins, fits, ladder
from ..session import cut_lineage
from .base import PANEL_SQL, panel, r, stored_panel, table
from .registry import query

_EDGES = [5.0, 10.0, 20.0, 35.0]


@query(
    "b1_quantile_edges",
    "WITH n AS (SELECT l_returnflag, greatest(2, count(*) // 1000) AS b FROM lineitem GROUP BY 1), e AS (SELECT l_returnflag, unnest(range(1, b)) AS i, b FROM n), "
    "s AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS c FROM lineitem) "
    "SELECT DISTINCT e.l_returnflag, round_even(lo.v + (hi.v - lo.v) * ((lo.c - 1) * i / b - floor((lo.c - 1) * i / b)), 0) AS edge FROM e "
    "JOIN s lo ON lo.l_returnflag = e.l_returnflag AND lo.k = CAST(floor((lo.c - 1) * i / b) AS BIGINT) JOIN s hi ON hi.l_returnflag = e.l_returnflag AND hi.k = CAST(ceil((hi.c - 1) * i / b) AS BIGINT)",
)
def _(spark, sf):
    count = F.greatest(F.lit(2), F.floor(F.col("total") / 1000))
    return ladder.quantile_edges(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", count)


@query(
    "b1_quantile_breaks",
    "SELECT l_linestatus, array_to_string([round_even(x, 0) FOR x IN quantile_cont(l_extendedprice, [0.25, 0.5, 0.75])], ' ') AS breaks FROM lineitem GROUP BY l_linestatus",
)
def _(spark, sf):
    edges = ladder.quantile_edges(table(spark, sf, "lineitem"), ["l_linestatus"], "l_extendedprice", 4)
    out = ladder.edge_array(edges, ["l_linestatus"])
    return out.select("l_linestatus", F.array_join(F.transform("breaks", lambda b: F.format_string("%.1f", b)), " ").alias("breaks"))


@query(
    "b2_cut",
    "WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CAST((l_quantity > 5) AS BIGINT) + CAST((l_quantity > 10) AS BIGINT) + CAST((l_quantity > 20) AS BIGINT) + CAST((l_quantity > 35) AS BIGINT) AS bin FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, l_partkey, bin, [NULL, 5.0, 10.0, 20.0, 35.0][bin + 1] AS lower, [5.0, 10.0, 20.0, 35.0, NULL][bin + 1] AS upper FROM b",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("bin", binning.cut("l_quantity", _EDGES))
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("bin").cast("bigint").alias("bin"),
        binning.lower_edge(F.col("bin"), _EDGES).alias("lower"),
        binning.upper_edge(F.col("bin"), _EDGES).alias("upper"),
    )


@query(
    "b2_cut_by_quantile_edges",
    f"WITH {PANEL_SQL}, e AS (SELECT DISTINCT period, edge FROM (SELECT period, unnest([round_even(x, 0) FOR x IN quantile_cont(amount, [0.2, 0.4, 0.6, 0.8])]) AS edge FROM panel GROUP BY period)) "
    "SELECT entity, p.period, CAST(count(e.edge) AS BIGINT) AS bin FROM panel p LEFT JOIN e ON e.period = p.period AND e.edge < p.amount GROUP BY entity, p.period",
)
def _(spark, sf):
    p = stored_panel(spark, sf, "entity", "period", "amount")
    edges = ladder.quantile_edges(p, ["period"], "amount", 5)
    out = ladder.bin_by_edges(p, ["period"], "amount", edges, "bin", "right")
    return out.select("entity", "period", F.col("bin").cast("bigint").alias("bin"))


@query(
    "b3_digitise",
    "SELECT l_orderkey, l_linenumber, l_partkey, CAST((l_quantity >= 5) AS BIGINT) + CAST((l_quantity >= 10) AS BIGINT) + CAST((l_quantity >= 20) AS BIGINT) + CAST((l_quantity >= 35) AS BIGINT) AS bin FROM lineitem",
)
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", binning.digitise("l_quantity", _EDGES).cast("bigint").alias("bin"))


@query(
    "b3_percentile_bins",
    f"WITH {PANEL_SQL}, e AS (SELECT DISTINCT kind, edge FROM (SELECT kind, unnest(quantile_cont(size, [0.25, 0.5, 0.75])) AS edge FROM panel GROUP BY kind)) "
    "SELECT entity, period, CAST((SELECT count(*) FROM e WHERE e.kind = p.kind AND e.edge <= p.size) AS BIGINT) AS bin FROM panel p",
)
def _(spark, sf):
    p = stored_panel(spark, sf, "entity", "kind", "period", "size")
    return bins.percentile_bins(p, ["kind"], "size", 4).select("entity", "period", F.col("bin").cast("bigint").alias("bin"))


@query(
    "b4_equal_width",
    "WITH m AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem), x AS (SELECT least(CAST(floor((l_extendedprice - a) / ((b - a) / 20)) AS BIGINT), 19) AS bin FROM lineitem, m) SELECT bin, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY bin",
)
def _(spark, sf):
    return bins.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 20).select(F.col("bin").cast("bigint").alias("bin"), "n")


@query(
    "b4_log_spaced",
    "WITH x AS (SELECT ln(l_extendedprice) AS v FROM lineitem WHERE l_extendedprice > 0), m AS (SELECT min(v) AS a, max(v) AS b FROM x), y AS (SELECT least(CAST(floor((v - a) / ((b - a) / 12)) AS BIGINT), 11) AS bin FROM x, m) SELECT bin, CAST(count(*) AS BIGINT) AS n FROM y GROUP BY bin",
)
def _(spark, sf):
    out = bins.log_spaced(table(spark, sf, "lineitem"), "l_extendedprice", 12)
    return bins.value_counts(out, F.col("bin").cast("bigint").alias("bin"))


@query(
    "b5_distance_bins",
    "WITH e AS (SELECT [round(1000.0 * i / 300, 2) FOR i IN range(1, 300)] AS edges) SELECT o_orderkey, CAST(len(list_filter(edges, lambda x: x < o_totalprice / 400)) AS BIGINT) AS bin FROM orders, e",
)
def _(spark, sf):
    x = F.col("o_totalprice") / 400
    return table(spark, sf, "orders").select("o_orderkey", binning.cut(x, binning.distance_edges()).cast("bigint").alias("bin"))


_SIZE_BIN_SQL = (
    f"WITH {PANEL_SQL}, x AS (SELECT entity, period, amount, valid / size AS share, participants FROM panel), n AS (SELECT period, greatest(2, count(*) // 100) AS b FROM x GROUP BY period), "
    "s AS (SELECT period, amount AS v, row_number() OVER (PARTITION BY period ORDER BY amount) - 1 AS k, count(*) OVER (PARTITION BY period) AS c FROM x), "
    "g AS (SELECT period, unnest(range(1, b)) AS i, b FROM n), "
    "e AS (SELECT DISTINCT g.period, round_even(lo.v + (hi.v - lo.v) * ((lo.c - 1) * i / b - floor((lo.c - 1) * i / b)), 0) AS edge FROM g "
    "JOIN s lo ON lo.period = g.period AND lo.k = CAST(floor((lo.c - 1) * i / b) AS BIGINT) JOIN s hi ON hi.period = g.period AND hi.k = CAST(ceil((hi.c - 1) * i / b) AS BIGINT)), "
    "z AS (SELECT x.*, (SELECT count(*) FROM e WHERE e.period = x.period AND e.edge < x.amount) AS size_bin FROM x)"
)


def size_binned(spark, sf):
    x = panel(spark, sf).select("entity", "period", "amount", "participants", S.ratio("valid", "size").alias("share"))
    return bins.size_bins(cut_lineage(x), ["period"], "amount", 100)


@query(
    "a14_binned_stats",
    f"{_SIZE_BIN_SQL} SELECT period, CAST(size_bin AS BIGINT) AS size_bin, CAST(count(*) AS BIGINT) AS n, round(avg(share), 6) AS mean, round(stddev_samp(share), 6) AS sd, round(avg(amount), 5) AS centre FROM z GROUP BY period, size_bin",
)
def _(spark, sf):
    rows, _ = size_binned(spark, sf)
    out = bins.binned_stats(rows, ["period", "size_bin"], "share", "amount")
    return out.select("period", F.col("size_bin").cast("bigint").alias("size_bin"), "n", r("mean").alias("mean"), r("sd").alias("sd"), r("centre", 5).alias("centre"))


@query(
    "a14_bin_bounds",
    f"{_SIZE_BIN_SQL}, o AS (SELECT period, edge, row_number() OVER (PARTITION BY period ORDER BY edge) AS k FROM e), m AS (SELECT period, unnest(range(0, max(k) + 1)) AS size_bin FROM o GROUP BY period) "
    "SELECT m.period, CAST(m.size_bin AS BIGINT) AS size_bin, coalesce(l.edge, -1) AS lower, coalesce(u.edge, -1) AS upper FROM m LEFT JOIN o l ON l.period = m.period AND l.k = m.size_bin LEFT JOIN o u ON u.period = m.period AND u.k = m.size_bin + 1",
)
def _(spark, sf):
    _, bounds = size_binned(spark, sf)
    closed = lambda c: F.when(F.abs(c) == float("inf"), F.lit(-1.0)).otherwise(F.col(c)).alias(c)
    return bounds.select("period", F.col("size_bin").cast("bigint").alias("size_bin"), closed("lower"), closed("upper"))


@query(
    "a15_binned_stats_2d",
    f"{_SIZE_BIN_SQL}, y AS (SELECT *, CAST((participants >= 1) AS BIGINT) + CAST((participants >= 2) AS BIGINT) AS crit_bin FROM z), q AS (SELECT period, crit_bin, quantile_cont(participants, 0.5) AS m FROM y GROUP BY 1, 2) "
    "SELECT period, CAST(size_bin AS BIGINT) AS size_bin, crit_bin, CAST(count(*) AS BIGINT) AS n, round(avg(share), 6) AS mean, round(stddev_samp(share), 6) AS sd, round(any_value(m), 6) AS median_criterion FROM y JOIN q USING (period, crit_bin) GROUP BY period, size_bin, crit_bin",
)
def _(spark, sf):
    rows, _ = size_binned(spark, sf)
    rows = rows.withColumn("crit_bin", binning.digitise("participants", [1.0, 2.0]))
    out = bins.binned_stats_2d(rows, ["period"], "size_bin", "crit_bin", "share", "participants")
    return out.select(
        "period", F.col("size_bin").cast("bigint").alias("size_bin"), F.col("crit_bin").cast("bigint").alias("crit_bin"), "n",
        r("mean").alias("mean"), r("sd").alias("sd"), r("median_criterion").alias("median_criterion"),
    )


@query(
    "a15_fill_bins",
    f"WITH {PANEL_SQL}, c AS (SELECT kind, CAST(size AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM panel GROUP BY 1, 2), g AS (SELECT kind, unnest(range(0, 12)) AS bin FROM (SELECT DISTINCT kind FROM c)) SELECT kind, bin, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (kind, bin)",
)
def _(spark, sf):
    counts = bins.value_counts(panel(spark, sf), "kind", F.col("size").cast("int").alias("bin"))
    return bins.fill_bins(counts, ["kind"], "bin", 12, ["n"]).withColumn("bin", F.col("bin").cast("bigint"))


@query(
    "a17_correlation_by_bin",
    "WITH x AS (SELECT CAST(l_quantity AS BIGINT) // 5 AS bin, l_extendedprice AS p, l_discount AS d FROM lineitem) SELECT bin, CAST(count(*) AS BIGINT) AS n, round(corr(p, d), 8) AS r FROM x GROUP BY bin",
)
def _(spark, sf):
    x = table(spark, sf, "lineitem").select(F.floor(F.col("l_quantity") / 5).alias("bin"), "l_extendedprice", "l_discount")
    return bins.correlation_by_bin(x, ["bin"], "l_extendedprice", "l_discount").withColumn("r", r("r", 8))


@query(
    "a25_scatter_profile",
    "WITH e AS (SELECT DISTINCT unnest(quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM lineitem), v AS (SELECT list(edge) AS edges FROM e), "
    "x AS (SELECT len(list_filter(edges, lambda t: t <= l_extendedprice)) AS bin, l_extendedprice, l_quantity FROM lineitem, v) "
    "SELECT CAST(bin AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(l_quantity), 8) AS mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS median_criterion FROM x WHERE bin > 0 AND bin < 9 GROUP BY bin",
)
def _(spark, sf):
    out = bins.scatter_profile(table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity"), "l_extendedprice", "l_quantity", 10)
    return out.select(F.col("bin").cast("bigint").alias("bin"), "n", r("mean", 8).alias("mean"), r("median_criterion", 4).alias("median_criterion"))


@query(
    "x5_feature_distribution",
    "WITH s AS (SELECT 'l_extendedprice' AS column_name, CAST(count(*) AS BIGINT) AS filled, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd FROM lineitem) SELECT s.*, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3 FROM s, (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)",
)
def _(spark, sf):
    from ..operators.quality import summary

    lines = table(spark, sf, "lineitem").select("l_extendedprice")
    q = ladder.quantiles(lines, [], "l_extendedprice", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return ladder.attach(summary(lines, ["l_extendedprice"], 4), q.select(*[r(c, 4).alias(c) for c in q.columns]), [])


# ---- fits ----


def binned_points(spark, sf):
    """(period, bin, n_avg, m, sigma): mean share and deviation of orders in bins of order count."""
    p = panel(spark, sf).groupBy("entity", "kind").agg(F.sum("size").alias("size"), F.sum("valid").alias("valid"))
    x = p.select("kind", "size", S.ratio("valid", "size").alias("share"))
    return x.groupBy("kind", F.col("size").alias("n_avg")).agg(F.count(F.lit(1)).alias("points"), F.avg("share").alias("m"), F.stddev_samp("share").alias("sigma"))


_POINTS_SQL = (
    f"WITH {PANEL_SQL}, e AS (SELECT entity, kind, sum(size) AS size, sum(valid) AS valid FROM panel GROUP BY 1, 2), "
    "pts AS (SELECT kind, size AS n_avg, avg(valid / size) AS m, stddev_samp(valid / size) AS sigma FROM e GROUP BY kind, size)"
)


@query(
    "e1_power_law_grid",
    f"{_POINTS_SQL}, g AS (SELECT -1 + i / 20 AS c FROM (SELECT unnest(range(0, 41)) AS i) WHERE i <> 20), f AS (SELECT kind, c, regr_slope(m, pow(n_avg, c)) AS b, regr_intercept(m, pow(n_avg, c)) AS a, regr_r2(m, pow(n_avg, c)) AS r2, regr_syy(m, pow(n_avg, c)) AS syy FROM pts, g GROUP BY kind, c) "
    "SELECT kind, round(arg_min(a, syy * (1 - r2)), 6) AS a, round(arg_min(b, syy * (1 - r2)), 6) AS b, round(arg_min(c, syy * (1 - r2)), 6) AS c, round(arg_min(r2, syy * (1 - r2)), 6) AS r2 FROM f GROUP BY kind",
)
def _(spark, sf):
    out = fits.power_law(binned_points(spark, sf), ["kind"], "n_avg", "m", refine=0)
    return out.select("kind", *[r(c).alias(c) for c in ("a", "b", "c", "r2")])


@query("e1_power_law")
def _(spark, sf):
    out = fits.power_law(binned_points(spark, sf), ["kind"], "n_avg", "m")
    return out.select("kind", *[r(c).alias(c) for c in ("a", "b", "c", "r2", "mse")], "n")


@query("e2_mean_level", f"{_POINTS_SQL} SELECT kind, round(avg(m), 8) AS k FROM pts GROUP BY kind ORDER BY k")
def _(spark, sf):
    return fits.mean_level(binned_points(spark, sf), ["kind"], "m").withColumn("k", r("k", 8))


@query(
    "e3_variance_law",
    f"{_POINTS_SQL} SELECT kind, round(regr_slope(sigma * sigma, 1 / n_avg), 6) AS a, round(regr_intercept(sigma * sigma, 1 / n_avg), 6) AS b, round(regr_r2(sigma * sigma, 1 / n_avg), 6) AS r2, CAST(regr_count(sigma * sigma, 1 / n_avg) AS BIGINT) AS n FROM pts GROUP BY kind",
)
def _(spark, sf):
    out = fits.variance_law(binned_points(spark, sf), ["kind"], "n_avg", "sigma")
    return out.select("kind", r("a").alias("a"), r("b").alias("b"), r("r2").alias("r2"), "n")


@query("e4_noise_law")
def _(spark, sf):
    pts = binned_points(spark, sf).withColumns({"gamma": S.ratio(F.col("sigma") * F.col("sigma"), F.pow(F.col("m") * (1 - F.col("m")), F.lit(2))), "pi": F.col("m")})
    out = fits.noise_law(pts, ["kind"], "n_avg", "gamma", "pi")
    return out.select("kind", *[r(c).alias(c) for c in ("a1", "a2", "omega", "h", "sse")], "n")


@query(
    "e5_scaling_residual",
    f"{_POINTS_SQL} SELECT kind, n_avg, round((sigma * sigma - 0.8 / (n_avg * m * (1 - m)) - 0.01) / 0.5, 6) AS residual, round(pow(m * (1 - m) * n_avg, -0.4), 6) AS scale FROM pts WHERE m > 0 AND m < 1",
)
def _(spark, sf):
    out = fits.scaling_residual(binned_points(spark, sf).where("m > 0 AND m < 1"), "sigma", "n_avg", "m", 0.8, 0.5, 0.01, -0.4)
    return out.select("kind", "n_avg", r("residual").alias("residual"), r("scale").alias("scale"))


@query(
    "e6_group_ratio",
    f"WITH {PANEL_SQL}, b AS (SELECT region, period, least(CAST(size AS BIGINT), 3) AS bin, avg(valid / size) AS m FROM panel GROUP BY 1, 2, 3), x AS (SELECT region, period, max(m) FILTER (WHERE bin = 1) / nullif(max(m) FILTER (WHERE bin = 3), 0) AS ratio FROM b GROUP BY 1, 2), "
    "y AS (SELECT * FROM x WHERE ratio IS NOT NULL), q AS (SELECT quantile_cont(ratio, 0.25) AS q1, quantile_cont(ratio, 0.75) AS q3 FROM y) SELECT round(avg(ratio), 8) AS lambda_m, CAST(count(*) AS BIGINT) AS n FROM y, q WHERE ratio BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)",
)
def _(spark, sf):
    b = panel(spark, sf).groupBy("region", "period", F.least(F.col("size"), F.lit(3.0)).cast("int").alias("bin")).agg(F.avg(F.col("valid") / F.col("size")).alias("m"))
    ratios = cut_lineage(bins.group_ratio(b, ["region", "period"], "bin", 1, 3, "m"))
    return aggregates.iqr_filter(ratios, ["ratio"]).agg(r(F.avg("ratio"), 8).alias("lambda_m"), F.count(F.lit(1)).alias("n"))
