"""Window, reshape and set-operation queries over the customer and nation panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import has_control_chars
from ..operators import ladder, reshape, sampling, windows
from ..session import cut_lineage
from .base import PANEL_SQL, REGION_SQL, panel, r, region_panel, stable_sql, stored_panel, table
from .q_schema import GAP_YEARS, long_sql, yearly_wide
from .registry import query

_RANK_SQL = (
    "(rank() OVER (PARTITION BY {p} ORDER BY {v} ASC NULLS LAST) + (count(*) OVER (PARTITION BY {p}, {v}) - 1) / 2) / count({v}) OVER (PARTITION BY {p})"
)


def rank_sql(part: str, value: str, digits: int | None = 4) -> str:
    core = f"CASE WHEN {value} IS NULL THEN NULL ELSE {_RANK_SQL.format(p=part, v=value)} END"
    return core if digits is None else f"round_even({core}, {digits})"


@query(
    "w1_lags",
    f"WITH {REGION_SQL} SELECT region, kind, period, valid, amount, lag(valid, 1) OVER w AS previous_valid, lag(amount, 1) OVER w AS previous_amount, "
    "lag(valid, 2) OVER w AS previousprevious_valid, lag(amount, 2) OVER w AS previousprevious_amount FROM rpanel WINDOW w AS (PARTITION BY region, kind ORDER BY period)",
)
def _(spark, sf):
    p = region_panel(spark, sf).select("region", "kind", "period", "valid", "amount")
    return windows.lags(p, ["region", "kind"], "period", ["valid", "amount"], {"previous_": 1, "previousprevious_": 2})


@query(
    "w1_lags_sparse",
    f"WITH {PANEL_SQL} SELECT entity, period, size, lag(size, 1) OVER w AS previous_size, lag(size, 2) OVER w AS previousprevious_size FROM panel WINDOW w AS (PARTITION BY entity, kind ORDER BY period)",
)
def _(spark, sf):
    p = panel(spark, sf).select("entity", "kind", "period", "size")
    return windows.lags(p, ["entity", "kind"], "period", ["size"], {"previous_": 1, "previousprevious_": 2}).drop("kind")


@query("w2_percentile_rank", f"WITH {PANEL_SQL} SELECT entity, period, valid_amount, {rank_sql('kind, period', 'valid_amount')} AS percentile FROM panel")
def _(spark, sf):
    p = stored_panel(spark, sf, "entity", "kind", "period", "valid_amount")
    return ladder.pct_rank_avg(p, ["kind", "period"], "valid_amount", "percentile").drop("kind")


@query("w2_percentile_rank_ties", f"WITH {PANEL_SQL} SELECT entity, period, participants, {rank_sql('period', 'participants')} AS percentile FROM panel")
def _(spark, sf):
    p = stored_panel(spark, sf, "entity", "period", "participants")
    return ladder.pct_rank_avg(p, ["period"], "participants", "percentile")


@query("w2_percentile_rank_lines", f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, {rank_sql('l_returnflag', 'l_extendedprice')} AS percentile FROM lineitem")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_extendedprice")
    return ladder.pct_rank_avg(lines, ["l_returnflag"], "l_extendedprice", "percentile").drop("l_returnflag")


@query(
    "w3_dense_rank",
    f"WITH {PANEL_SQL} SELECT entity, period, CASE WHEN valid_amount IS NULL THEN NULL ELSE CAST(dense_rank() OVER (PARTITION BY entity ORDER BY valid_amount ASC NULLS LAST) AS BIGINT) END AS position FROM panel",
)
def _(spark, sf):
    p = panel(spark, sf).select("entity", "period", "valid_amount")
    return windows.dense_rank_non_null(p, ["entity"], "valid_amount", "position").drop("valid_amount")


_GRID_SQL = (
    f"{long_sql(GAP_YEARS)}, rng AS (SELECT feature, min(period) AS a, max(period) AS b FROM long GROUP BY feature), "
    "years AS (SELECT feature, unnest(range(a, b + 1)) AS period FROM rng), keys AS (SELECT DISTINCT entity FROM long), "
    "grid AS (SELECT entity, feature, period, raw FROM (SELECT entity, feature, period FROM keys CROSS JOIN years) LEFT JOIN long USING (entity, feature, period))"
)
_LINE_SQL = (
    f"{_GRID_SQL}, marks AS (SELECT *, max(CASE WHEN raw IS NOT NULL THEN period END) OVER (PARTITION BY entity, feature ORDER BY period) AS pa, "
    "min(CASE WHEN raw IS NOT NULL THEN period END) OVER (PARTITION BY entity, feature ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pb FROM grid), "
    "filled AS (SELECT m.entity, m.feature, m.period, coalesce(m.raw, a.raw + (b.raw - a.raw) * ((m.period - m.pa) / (m.pb - m.pa))) AS raw FROM marks m "
    "LEFT JOIN long a ON a.entity = m.entity AND a.feature = m.feature AND a.period = m.pa LEFT JOIN long b ON b.entity = m.entity AND b.feature = m.feature AND b.period = m.pb)"
)


@query("j4_period_grid", f"{_GRID_SQL} SELECT entity, feature, period, raw FROM grid")
def _(spark, sf):
    return reshape.fill_grid(cut_lineage(reshape.unpivot_years(yearly_wide(spark, sf, GAP_YEARS), "entity", "accounts")), "entity")


def interpolated(spark, sf):
    long = cut_lineage(reshape.unpivot_years(yearly_wide(spark, sf, GAP_YEARS), "entity", "accounts"))
    grid = reshape.fill_grid(long, "entity")
    return windows.interpolate_linear(grid, ["entity", "feature"], "period", "raw")


@query("w4_interpolate_linear", f"{_LINE_SQL} SELECT entity, feature, period, round(raw, 6) AS raw FROM filled")
def _(spark, sf):
    return interpolated(spark, sf).select("entity", "feature", "period", r("raw").alias("raw"))


@query(
    "w5_difference",
    f"WITH {PANEL_SQL} SELECT entity, period, round_even(amount - lag(amount) OVER (PARTITION BY entity ORDER BY period), 2) AS delta FROM panel",
)
def _(spark, sf):
    w = windows.over(["entity"], "period")
    return panel(spark, sf).select("entity", "period", F.bround(windows.difference("amount", w), 2).alias("delta"))


@query(
    "w6_relative_change",
    f"WITH {PANEL_SQL}, f AS (SELECT entity, period, last_value(valid_amount IGNORE NULLS) OVER (PARTITION BY entity ORDER BY period) AS x FROM panel), "
    "g AS (SELECT entity, period, x, lag(x) OVER (PARTITION BY entity ORDER BY period) AS y FROM f) SELECT entity, period, round((x - y) / nullif(y, 0), 6) AS pct_change FROM g",
)
def _(spark, sf):
    w = windows.over(["entity"], "period")
    return panel(spark, sf).select("entity", "period", r(windows.relative_change("valid_amount", w)).alias("pct_change"))


@query(
    "w7_augmentations",
    f"WITH {PANEL_SQL}, g AS (SELECT entity, period, amount AS x, lag(amount) OVER (PARTITION BY entity ORDER BY period) AS y FROM panel) "
    "SELECT entity, period, round(x - y, 6) AS delta, y AS lag, round((x - y) / nullif(x, 0), 6) AS pct_change FROM g",
)
def _(spark, sf):
    out = windows.augment(panel(spark, sf).select("entity", "period", "amount"), ["entity"], "period", "amount", windows.AUGMENTATIONS)
    return out.select("entity", "period", r("delta").alias("delta"), "lag", r("pct_change").alias("pct_change"))


@query(
    "w7_clip_to_quantiles",
    f"WITH {PANEL_SQL}, q AS (SELECT period, quantile_cont(amount, 0.01) AS a, quantile_cont(amount, 0.99) AS b FROM panel GROUP BY period) "
    "SELECT entity, period, round(least(greatest(amount, a), b), 6) AS clipped FROM panel JOIN q USING (period)",
)
def _(spark, sf):
    out = windows.clip_to_quantiles(stored_panel(spark, sf, "entity", "period", "amount"), ["period"], "amount", 0.01, 0.99, "clipped")
    return out.select("entity", "period", r("clipped").alias("clipped"))


# means are taken over whole cents: both engines then add integers, in whatever order


@query(
    "w8_group_mean_fill",
    f"WITH {PANEL_SQL}, c AS (SELECT entity, region, period, round(valid_amount * 100) AS cents FROM panel) SELECT entity, period, round(coalesce(cents, avg(cents) OVER (PARTITION BY region, period), avg(cents) OVER ()), 4) AS cents FROM c",
)
def _(spark, sf):
    p = panel(spark, sf).select("entity", "region", "period", F.round(F.col("valid_amount") * 100).alias("cents"))
    return windows.group_mean_fill(p, ["region", "period"], ["cents"]).select("entity", "period", r("cents", 4).alias("cents"))


@query(
    "w9_centre_by_group",
    f"WITH {PANEL_SQL}, c AS (SELECT entity, kind, period, round(amount * 100) AS cents FROM panel) SELECT entity, period, round(cents - avg(cents) OVER (PARTITION BY kind, period), 4) AS centred FROM c",
)
def _(spark, sf):
    p = panel(spark, sf).select("entity", "kind", "period", F.round(F.col("amount") * 100).alias("cents"))
    return windows.centre(p, ["kind", "period"], "cents", "centred").select("entity", "period", r("centred", 4).alias("centred"))


@query(
    "w10_standardise_cut",
    f"WITH {PANEL_SQL}, z AS (SELECT entity, period, (amount - avg(amount) OVER w) / stddev_pop(amount) OVER w AS z FROM panel WINDOW w AS (PARTITION BY period)) "
    "SELECT entity, period, round(z, 6) AS z FROM z WHERE abs(z) <= 2.5",
)
def _(spark, sf):
    p = panel(spark, sf).select("entity", "period", "amount")
    return windows.standardise(p, ["period"], "amount", "z", 2.5).select("entity", "period", r("z").alias("z"))


@query(
    "w11_forward_fill",
    f"WITH {PANEL_SQL} SELECT entity, period, last_value(valid_amount IGNORE NULLS) OVER (PARTITION BY entity ORDER BY period) AS filled FROM panel",
)
def _(spark, sf):
    p = panel(spark, sf).select("entity", "period", "valid_amount")
    return windows.forward_fill(p, ["entity"], "period", "valid_amount", "filled").drop("valid_amount")


@query(
    "w12_cumulative_cutoff",
    "WITH b AS (SELECT p_type AS feature, CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS DOUBLE) AS s FROM part GROUP BY p_type), n AS (SELECT feature, s / (SELECT sum(s) FROM b) AS score FROM b), "
    "c AS (SELECT feature, score, sum(score) OVER (ORDER BY score DESC, feature) AS cumulative FROM n) SELECT feature, round(score, 8) AS score, round(cumulative, 8) AS cumulative FROM c WHERE cumulative < 0.95",
)
def _(spark, sf):
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    scores = table(spark, sf, "part").groupBy(F.col("p_type").alias("feature")).agg(F.sum(cents).cast("double").alias("s"))
    share = ladder.attach(scores, scores.agg(F.sum("s").alias("t")), []).select("feature", (F.col("s") / F.col("t")).alias("score"))
    out = windows.keep_until_cumulative(share, "score", "feature", 0.95)
    return out.select("feature", r("score", 8).alias("score"), r("cumulative", 8).alias("cumulative"))


@query(
    "w12_running_total",
    "SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS BIGINT) AS running_cents FROM orders",
)
def _(spark, sf):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", cents.alias("cents"))
    return ladder.running_total(orders, ["o_orderstatus"], "o_orderkey", "cents", "running_cents").select("o_orderkey", "running_cents")


@query("w13_row_index", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS row_index FROM orders")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    return ladder.rank_columns(orders, [], "o_orderkey", row_index=F.col("below"))


@query(
    "w14_level_deltas",
    f"WITH {REGION_SQL}, x AS (SELECT region, kind, period, valid, {rank_sql('kind, period', 'valid')} AS percentile_valid FROM rpanel), "
    "y AS (SELECT *, lag(valid, 1) OVER w AS p1, lag(valid, 2) OVER w AS p2, lag(percentile_valid, 1) OVER w AS pp FROM x WINDOW w AS (PARTITION BY region, kind ORDER BY period)) "
    "SELECT region, kind, period, valid - p1 AS delta_valid, round(percentile_valid - pp, 6) AS delta_percentile_valid, 0.0 AS previous_delta_percentile_valid, p1 - p2 AS previous_delta_valid FROM y",
)
def _(spark, sf):
    p = cut_lineage(region_panel(spark, sf).select("region", "kind", "period", "valid"))
    ranked = ladder.pct_rank_avg(p, ["kind", "period"], "valid", "percentile_valid")
    lagged = windows.lags(ranked, ["region", "kind"], "period", ["valid", "percentile_valid"], {"previous_": 1, "previousprevious_": 2})
    return windows.level_deltas(lagged, "valid").select(
        "region",
        "kind",
        "period",
        "delta_valid",
        r("delta_percentile_valid").alias("delta_percentile_valid"),
        "previous_delta_percentile_valid",
        "previous_delta_valid",
    )


@query(
    "f13_winsorise",
    f"WITH {PANEL_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY amount) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM panel), "
    "b AS (SELECT kind, max(amount) FILTER (WHERE i = CAST(floor(0.05 * n) AS BIGINT)) AS lo, max(amount) FILTER (WHERE i = n - 1 - CAST(floor(0.05 * n) AS BIGINT)) AS hi FROM o GROUP BY kind) "
    "SELECT entity, period, greatest(least(amount, hi), lo) AS winsorised FROM panel JOIN b USING (kind)",
)
def _(spark, sf):
    p = stored_panel(spark, sf, "entity", "kind", "period", "amount")
    return ladder.clamp_order_statistics(p, ["kind"], "amount", 0.05, "winsorised").select("entity", "period", "winsorised")


@query(
    "d5_augment_indicators",
    f"{_LINE_SQL}, l AS (SELECT *, lag(raw) OVER w AS y FROM filled WINDOW w AS (PARTITION BY entity, feature ORDER BY period)), "
    "f AS (SELECT *, last_value(raw IGNORE NULLS) OVER w AS x1, last_value(raw IGNORE NULLS) OVER (PARTITION BY entity, feature ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS y1 FROM l WINDOW w AS (PARTITION BY entity, feature ORDER BY period)) "
    f"SELECT entity, feature, period, round(raw, 5) AS raw, round(y, 5) AS lag, round({rank_sql('feature, period', 'raw', None)}, 5) AS rank, round(raw - y, 5) AS delta, round((x1 - y1) / nullif(y1, 0), 5) AS pct_change FROM f",
)
def _(spark, sf):
    out = windows.augment_indicators(cut_lineage(interpolated(spark, sf)), "entity", None)
    return out.select("entity", "feature", "period", *[r(c, 5).alias(c) for c in ("raw", "lag", "rank", "delta", "pct_change")])


# ---- sorts, limits, sets ----


@query("t1_sort_keys", f"WITH {REGION_SQL} SELECT region, kind, period, valid FROM rpanel ORDER BY kind, valid DESC, region, period")
def _(spark, sf):
    p = region_panel(spark, sf).select("region", "kind", "period", "valid")
    return p.orderBy("kind", F.col("valid").desc_nulls_last(), "region", "period")


@query(
    "t2_top_k",
    "SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS score FROM lineitem GROUP BY l_partkey ORDER BY score DESC, l_partkey LIMIT 20",
)
def _(spark, sf):
    scores = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("score"))
    return scores.orderBy(F.col("score").desc(), "l_partkey").limit(20)


@query(
    "t2_top_k_per_group",
    f"WITH {PANEL_SQL} SELECT entity, kind, period, amount FROM (SELECT *, row_number() OVER (PARTITION BY kind, period ORDER BY amount DESC, entity) AS k FROM panel) WHERE k <= 5",
)
def _(spark, sf):
    # Spark drops all but the five best rows of each group before the shuffle
    w = Window.partitionBy("kind", "period").orderBy(F.col("amount").desc(), "entity")
    p = panel(spark, sf).select("entity", "kind", "period", "amount")
    return p.withColumn("_k", F.row_number().over(w)).where("_k <= 5").drop("_k")


@query(
    "t3_above_median_then_cap",
    "WITH s AS (SELECT l_partkey, CAST(count(*) AS DOUBLE) AS score FROM lineitem GROUP BY l_partkey) SELECT l_partkey, score FROM s WHERE score > 1.3 * (SELECT quantile_cont(score, 0.5) FROM s) ORDER BY score DESC, l_partkey LIMIT 45",
)
def _(spark, sf):
    scores = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return sampling.above_median(scores, "score", "l_partkey", 1.3, 45)


@query("t4_stable_sample", f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {stable_sql('o_orderkey')}, o_orderkey LIMIT 500")
def _(spark, sf):
    return sampling.stable_sample(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 500)


@query("t4_stable_fraction", f"SELECT o_orderkey, o_custkey FROM orders WHERE {stable_sql('o_orderkey')} % 1000000 < 250000")
def _(spark, sf):
    return sampling.stable_fraction(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 0.25)


@query("u1_union_same_schema", "SELECT o_orderkey AS k, o_totalprice AS v FROM orders UNION ALL SELECT l_orderkey, l_extendedprice FROM lineitem")
def _(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("v"))
    return a.unionByName(b)


@query(
    "u2_union_diagonal",
    "SELECT o_orderkey AS k, o_totalprice AS price, CAST(NULL AS DOUBLE) AS quantity FROM orders UNION ALL SELECT l_orderkey, NULL, l_quantity FROM lineitem",
)
def _(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("quantity"))
    return reshape.union_diagonal(a, b)


@query(
    "u3_tables_between",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS title, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS table_no FROM orders "
    "WHERE strftime(o_orderdate, '%Y-%m') BETWEEN '1996-03' AND '1999-10'",
)
def _(spark, sf):
    d = F.col("o_orderdate")
    months = table(spark, sf, "orders").select(
        "o_orderkey", F.date_format(d, "yyyy-MM").alias("title"), (F.year(d) * 12 + F.month(d)).cast("bigint").alias("table_no")
    )
    return reshape.tables_between(months, "1996-03", "1999-10")


@query(
    "f1_text_slices",
    "SELECT c_custkey, substr(c_name, 1, 2) AS head, right(c_name, 4) AS tail, left(c_name, length(c_name) - 4) AS stem FROM customer",
)
def _(spark, sf):
    n = F.col("c_name")
    return table(spark, sf, "customer").select(
        "c_custkey", F.substring(n, 1, 2).alias("head"), F.right(n, F.lit(4)).alias("tail"), F.left(n, F.length(n) - 4).alias("stem")
    )


@query(
    "f2_regex_parts",
    "SELECT page_id, regexp_extract(url, '(\\d+)[^\\d]*$', 1) AS last_number, regexp_replace(url, '[^A-Za-z]', '', 'g') AS letters, split_part(url, '/', 3) AS host, regexp_matches(url, '\\d') AS has_digit FROM pages",
)
def _(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        F.regexp_extract(u, r"(\d+)[^\d]*$", 1).alias("last_number"),
        F.regexp_replace(u, "[^A-Za-z]", "").alias("letters"),
        F.split_part(u, F.lit("/"), F.lit(3)).alias("host"),
        u.rlike(r"\d").alias("has_digit"),
    )


@query("f3_control_characters", "SELECT doc_id, regexp_matches(text, '[\\x00-\\x1F\\x7F\\x{200B}-\\x{200D}\\x{FEFF}]') AS has_control FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", has_control_chars("text").alias("has_control"))


@query(
    "f11_math",
    "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 2, 0) AS half_even, round(sqrt(l_quantity), 8) AS root, round(ln(1 + l_tax), 8) AS log_tax, round(exp(l_discount), 8) AS e, round(pow(l_quantity, 1.5), 4) AS p, abs(l_discount - l_tax) AS gap FROM lineitem",
)
def _(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.bround(F.col("l_quantity") / 2, 0).alias("half_even"),
        F.round(F.sqrt("l_quantity"), 8).alias("root"),
        F.round(F.ln(1 + F.col("l_tax")), 8).alias("log_tax"),
        F.round(F.exp("l_discount"), 8).alias("e"),
        F.round(F.pow("l_quantity", F.lit(1.5)), 4).alias("p"),
        F.abs(F.col("l_discount") - F.col("l_tax")).alias("gap"),
    )


@query("f12_struct_columns", "WITH c AS (SELECT c_custkey, {'latitude': CAST(c_nationkey AS DOUBLE), 'longitude': c_acctbal} AS coords FROM customer) SELECT c_custkey, coords.latitude AS latitude, coords.longitude AS longitude FROM c")
def _(spark, sf):
    pair = F.struct(F.col("c_nationkey").cast("double").alias("latitude"), F.col("c_acctbal").alias("longitude"))
    return table(spark, sf, "customer").select("c_custkey", pair.alias("coords")).select("c_custkey", "coords.latitude", "coords.longitude")

