"""Schema, filters, shares, column rules and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators import quality, reshape, schema
from .base import BLOCS, PANEL_SQL, panel, r, share_sql, table
from .registry import query

VOTES = [f"vote_{b}" for b in BLOCS]


@query(
    "p1_conform_schema",
    "SELECT CAST(NULL AS VARCHAR) AS region, CAST(l_orderkey AS VARCHAR) AS entity, CAST(l_quantity AS BIGINT) AS period, "
    "CAST(l_extendedprice AS DOUBLE) AS size, CAST(NULL AS DOUBLE) AS valid FROM lineitem",
)
def _(spark, sf):
    want = T.StructType(
        [
            T.StructField("region", T.StringType()),
            T.StructField("entity", T.StringType()),
            T.StructField("period", T.LongType()),
            T.StructField("size", T.DoubleType()),
            T.StructField("valid", T.DoubleType()),
        ]
    )
    raw = table(spark, sf, "lineitem").withColumnsRenamed({"l_orderkey": "entity", "l_quantity": "period", "l_extendedprice": "size"})
    return schema.conform(raw, want)


@query(
    "p2_lenient_cast",
    "SELECT event_id, try_cast(replace(props, '{\"k\": ', '') AS DOUBLE) AS text_number, "
    "try_cast(replace(replace(props, '{\"k\": ', ''), '}', '') AS DOUBLE) AS clean_number FROM events",
)
def _(spark, sf):
    opened = F.replace("props", F.lit('{"k": '), F.lit(""))
    return table(spark, sf, "events").select(
        "event_id",
        S.lenient(opened).alias("text_number"),
        S.lenient(F.replace(opened, F.lit("}"), F.lit(""))).alias("clean_number"),
    )


@query(
    "p3_zero_pad",
    "SELECT o_orderkey, CASE WHEN length(CAST(o_custkey AS VARCHAR)) < 5 THEN lpad(CAST(o_custkey AS VARCHAR), 5, '0') ELSE CAST(o_custkey AS VARCHAR) END AS code, "
    "CASE WHEN length(CAST(o_totalprice AS VARCHAR)) < 5 THEN lpad(CAST(o_totalprice AS VARCHAR), 5, '0') ELSE CAST(o_totalprice AS VARCHAR) END AS long_code FROM orders",
)
def _(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", S.zero_pad("o_custkey").alias("code"), S.zero_pad("o_totalprice").alias("long_code")
    )


ALL_YEARS = list(range(1995, 2002))
#: Years of a published table that skips some, for the operators that fill gaps.
GAP_YEARS = [1995, 1997, 1998, 2000, 2001]


def yearly_wide(spark, sf, years=ALL_YEARS):
    """(entity, amount1995 ... , orders1995 ...): a wide yearly table with nulls."""
    p = panel(spark, sf)
    return p.groupBy("entity").agg(
        *[F.max(F.when(F.col("period") == y, F.col("amount"))).alias(f"amount{y}") for y in years],
        *[F.max(F.when(F.col("period") == y, F.col("size"))).alias(f"orders{y}") for y in years],
    )


def long_sql(years) -> str:
    return (
        f"WITH {PANEL_SQL}, wide AS (SELECT entity, "
        + ", ".join(f"max(amount) FILTER (WHERE period = {y}) AS amount{y}" for y in years)
        + ", "
        + ", ".join(f"max(size) FILTER (WHERE period = {y}) AS orders{y}" for y in years)
        + " FROM panel GROUP BY entity), long AS ("
        + " UNION ALL ".join(f"SELECT entity, 'accounts/{n}' AS feature, CAST({y} AS BIGINT) AS period, {n}{y} AS raw FROM wide" for n in ("amount", "orders") for y in years)
        + ")"
    )


_LONG_SQL = long_sql(ALL_YEARS)
_ORDERS = [f"orders{y}" for y in ALL_YEARS]


@query("p4_unpivot_years", f"{_LONG_SQL} SELECT entity, feature, period, raw FROM long")
def _(spark, sf):
    return reshape.unpivot_years(yearly_wide(spark, sf), "entity", "accounts")


@query(
    "p5_pivot_features",
    f"{_LONG_SQL} SELECT entity, period, max(raw) FILTER (WHERE feature = 'accounts/amount') AS \"raw_accounts/amount\", "
    "max(raw) FILTER (WHERE feature = 'accounts/orders') AS \"raw_accounts/orders\", "
    "max(raw * 2) FILTER (WHERE feature = 'accounts/amount') AS \"twice_accounts/amount\", "
    "max(raw * 2) FILTER (WHERE feature = 'accounts/orders') AS \"twice_accounts/orders\" FROM long GROUP BY entity, period",
)
def _(spark, sf):
    long = reshape.unpivot_years(yearly_wide(spark, sf), "entity", "accounts").withColumn("twice", F.col("raw") * 2)
    return reshape.pivot_values(long, ["entity", "period"], "feature", ["accounts/amount", "accounts/orders"], ["raw", "twice"])


@query(
    "p6_code_range",
    "WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey = 20 THEN '2A' WHEN c_nationkey = 21 THEN '2B' WHEN c_nationkey = 22 THEN 'ZZ' WHEN c_nationkey = 23 THEN '97' "
    "ELSE lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END || '001' AS code FROM customer) "
    "SELECT c_custkey, code FROM c WHERE substr(code, 1, 2) BETWEEN '01' AND '95' OR substr(code, 1, 2) IN ('2A', '2B')",
)
def _(spark, sf):
    n = F.col("c_nationkey")
    head = F.when(n == 20, "2A").when(n == 21, "2B").when(n == 22, "ZZ").when(n == 23, "97").otherwise(F.lpad(n.cast("string"), 2, "0"))
    codes = table(spark, sf, "customer").select("c_custkey", F.concat(head, F.lit("001")).alias("code"))
    return codes.where(S.in_code_range("code", "01", "95", ["2A", "2B"]))


@query("p7_drop_all_null_rows", f"{_LONG_SQL} SELECT * FROM wide WHERE amount1995 IS NOT NULL OR orders2001 IS NOT NULL")
def _(spark, sf):
    return schema.drop_all_null_rows(yearly_wide(spark, sf), ["amount1995", "orders2001"])


@query(
    "p8_any_non_negative",
    f"{_LONG_SQL} SELECT entity, amount1995 - 200000 AS a, amount1997 - 300000 AS b FROM wide WHERE amount1995 - 200000 >= 0 OR amount1997 - 300000 >= 0",
)
def _(spark, sf):
    w = yearly_wide(spark, sf).select("entity", (F.col("amount1995") - 200000).alias("a"), (F.col("amount1997") - 300000).alias("b"))
    return schema.keep_any_non_negative(w, ["a", "b"])


@query(
    "p9_zero_cascade",
    f"WITH {PANEL_SQL}, s AS (SELECT entity, period, participants AS size, valid AS participants, vote_g AS valid, vote_cg, size AS vote_d, participants = 0 AS no_size FROM panel), "
    "t AS (SELECT entity, period, size, no_size, CASE WHEN no_size THEN 0 ELSE participants END AS participants, CASE WHEN no_size THEN 0 ELSE valid END AS valid, "
    "CASE WHEN no_size THEN 0 ELSE vote_cg END AS vote_cg, CASE WHEN no_size THEN 0 ELSE vote_d END AS vote_d FROM s) "
    "SELECT entity, period, size, no_size, participants, participants = 0 AS no_participants, CASE WHEN participants = 0 THEN 0 ELSE valid END AS valid, "
    "CASE WHEN participants = 0 THEN 0 ELSE vote_cg END AS vote_cg, CASE WHEN participants = 0 THEN 0 ELSE vote_d END AS vote_d FROM t",
)
def _(spark, sf):
    # statuses shifted by one level, so that empty sizes really occur above filled measures
    s = panel(spark, sf).select(
        "entity",
        "period",
        F.col("participants").alias("size"),
        F.col("valid").alias("participants"),
        F.col("vote_g").alias("valid"),
        "vote_cg",
        F.col("size").alias("vote_d"),
    )
    return schema.zero_cascade(s, ["vote_cg", "vote_d"])


@query(
    "p10_safe_share",
    f"WITH {PANEL_SQL} SELECT entity, period, {share_sql('vote_g', 'valid')} AS pvote_g, {share_sql('size', 'valid')} AS over_one, {share_sql('valid_amount', 'amount')} AS amount_share FROM panel",
)
def _(spark, sf):
    return panel(spark, sf).select(
        "entity",
        "period",
        S.safe_share("vote_g", "valid").alias("pvote_g"),
        S.safe_share("size", "valid").alias("over_one"),
        S.safe_share("valid_amount", "amount").alias("amount_share"),
    )


@query(
    "p11_row_sum",
    f"{_LONG_SQL} SELECT entity, " + " + ".join(f"coalesce({c}, 0)" for c in _ORDERS) + " AS total FROM wide",
)
def _(spark, sf):
    return yearly_wide(spark, sf).select("entity", S.row_sum(_ORDERS).alias("total"))


@query("p12_complements", f"WITH {PANEL_SQL} SELECT entity, period, size - participants AS absent, participants - valid AS blank FROM panel")
def _(spark, sf):
    return panel(spark, sf).select(
        "entity", "period", (F.col("size") - F.col("participants")).alias("absent"), (F.col("participants") - F.col("valid")).alias("blank")
    )


@query("p13_select_renamed", "SELECT o_orderkey AS ballot, o_custkey AS entity, o_totalprice AS amount FROM orders")
def _(spark, sf):
    names = {"o_orderkey": "ballot", "o_custkey": "entity", "o_totalprice": "amount", "not_there": "never"}
    return schema.select_renamed(table(spark, sf, "orders"), names)


@query("p14_column_selectors", f"WITH {PANEL_SQL} SELECT entity, vote_g, vote_c, vote_d FROM panel")
def _(spark, sf):
    p = panel(spark, sf)
    return p.select("entity", *schema.columns_matching(p, prefix="vote_", exclude=r"^vote_c[gd]$"))


@query("p17_drop_sparse_columns", f"{_LONG_SQL} SELECT entity, " + ", ".join(f"{n}{y}" for n in ("amount", "orders") for y in ALL_YEARS[:-1]) + " FROM wide")
def _(spark, sf):
    w = yearly_wide(spark, sf)
    return schema.drop_sparse_columns(w, w.columns[1:], 0.4)


@query(
    "p17_null_share_by_group",
    f"WITH {PANEL_SQL} SELECT kind, period, round(avg(CASE WHEN valid_amount IS NULL THEN 1.0 ELSE 0.0 END), 6) AS valid_amount, round(avg(CASE WHEN amount IS NULL THEN 1.0 ELSE 0.0 END), 6) AS amount FROM panel GROUP BY kind, period",
)
def _(spark, sf):
    shares = schema.null_shares(panel(spark, sf), ["valid_amount", "amount"], ["kind", "period"])
    return shares.select("kind", "period", r("valid_amount").alias("valid_amount"), r("amount").alias("amount"))


@query("p18_drop_all_null_columns", f"WITH {PANEL_SQL} SELECT entity, period, amount FROM panel")
def _(spark, sf):
    p = panel(spark, sf).select("entity", "period", "amount", F.when(F.col("size") < 0, F.col("size")).alias("never"))
    return schema.drop_all_null_columns(p, ["amount", "never"])


@query("p19_drop_constant_columns", f"WITH {PANEL_SQL} SELECT entity, period, amount FROM panel")
def _(spark, sf):
    p = panel(spark, sf).select("entity", "period", "amount", (F.col("size") - F.col("size")).alias("flat"))
    return schema.drop_constant_columns(p, ["amount", "flat"])


@query(
    "p20_finite_or_null",
    f"WITH {PANEL_SQL} SELECT entity, period, CASE WHEN participants = 0 THEN NULL ELSE participants / participants END AS one, CASE WHEN valid = 0 THEN NULL ELSE size / valid END AS size_per_valid FROM panel",
)
def _(spark, sf):
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    raw = panel(spark, sf).select(
        "entity",
        "period",
        F.when(F.col("participants") == 0, nan).otherwise(F.col("participants") / F.col("participants")).alias("one"),
        F.when(F.col("valid") == 0, inf).otherwise(S.ratio("size", "valid")).alias("size_per_valid"),
    )
    return raw.withColumns({c: S.finite(c) for c in ("one", "size_per_valid")})


@query("p21_year_to_suffix", f"{_LONG_SQL} SELECT entity, amount1995 AS amount_sum1995, orders1997 AS orders_sum1997 FROM wide")
def _(spark, sf):
    w = yearly_wide(spark, sf).select("entity", F.col("amount1995").alias("amount1995_sum"), F.col("orders1997").alias("orders1997_sum"))
    return schema.year_to_suffix(w)


@query("p22_year_from_suffix", f"{_LONG_SQL} SELECT entity, amount1998 AS amount, orders1998 AS orders, CAST(1998 AS BIGINT) AS period, 'yearly' AS kind FROM wide")
def _(spark, sf):
    return schema.year_from_suffix(yearly_wide(spark, sf).select("entity", "amount1998", "orders1998"), 1998, "yearly")


@query(
    "p23_region_number",
    "WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey = 20 THEN '2A' WHEN c_nationkey = 21 THEN '2B' WHEN c_nationkey = 22 THEN 'ZZ' ELSE lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END || '004' AS code FROM customer) "
    "SELECT c_custkey, CASE WHEN substr(code, 1, 2) IN ('2A', '2B') THEN 20.0 ELSE try_cast(substr(code, 1, 2) AS DOUBLE) END AS region_no FROM c",
)
def _(spark, sf):
    n = F.col("c_nationkey")
    head = F.when(n == 20, "2A").when(n == 21, "2B").when(n == 22, "ZZ").otherwise(F.lpad(n.cast("string"), 2, "0"))
    codes = table(spark, sf, "customer").select("c_custkey", F.concat(head, F.lit("004")).alias("code"))
    return codes.select("c_custkey", S.region_number("code", {"2A": 20.0, "2B": 20.0}).alias("region_no"))


@query(
    "p24_kind_encoding_map",
    "SELECT c_custkey, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'AUTOMOBILE' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE -1 END AS BIGINT) AS kind_no FROM customer",
)
def _(spark, sf):
    codes = {"BUILDING": 0, "AUTOMOBILE": 1, "MACHINERY": 2, "HOUSEHOLD": 3}
    return table(spark, sf, "customer").select("c_custkey", S.lookup("c_mktsegment", codes, F.lit(-1)).cast("bigint").alias("kind_no"))


@query(
    "p24_kind_encoding_by_target",
    f"WITH {PANEL_SQL}, y AS (SELECT kind, period, (avg(size) + avg(valid)) / 2 AS m FROM panel GROUP BY kind, period), k AS (SELECT kind, avg(m) AS code FROM y GROUP BY kind) "
    "SELECT entity, period, kind, round(code, 6) AS kind_code FROM panel JOIN k USING (kind)",
)
def _(spark, sf):
    out = schema.encode_kind_by_target(panel(spark, sf), "kind", "period", ["size", "valid"], "kind_code")
    return out.select("entity", "period", "kind", r("kind_code").alias("kind_code"))


@query("p25_prefix_features", f"WITH {PANEL_SQL} SELECT entity, period, size AS \"F_size\", amount AS \"F_amount\" FROM panel")
def _(spark, sf):
    return schema.prefix_features(panel(spark, sf).select("entity", "period", "size", "amount"), ["entity", "period"])


@query("p26_blacklist", "SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#23')")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_brand").where(~F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#23"))


_CELLS_SQL = "CASE WHEN l_returnflag = 'A' THEN l_linestatus END, CASE WHEN l_linestatus = 'F' THEN 'F' ELSE l_returnflag END, l_linestatus"


@query(
    "p27_split_annotations",
    f"WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, [{_CELLS_SQL}] AS cells FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, "
    "len(list_distinct(list_filter(cells, lambda x: x IS NOT NULL))) = 1 AS annotation FROM c",
)
def _(spark, sf):
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.array(F.when(f == "A", s), F.when(s == "F", F.lit("F")).otherwise(f), s).alias("cells")
    )
    data, notes = schema.split_annotations(rows, "cells")
    return data.withColumn("annotation", F.lit(False)).unionByName(notes.withColumn("annotation", F.lit(True))).drop("cells")


@query(
    "p28_reconcile_tagged",
    f"WITH {PANEL_SQL} SELECT entity, period, coalesce(valid_amount, amount) AS \"Poll A\", participants AS \"Poll B\" FROM panel",
)
def _(spark, sf):
    p = panel(spark, sf).select(
        "entity",
        "period",
        F.col("amount").alias("Poll A"),
        F.col("valid_amount").alias("Poll A [N 5]"),
        F.col("participants").alias("Poll B"),
        F.col("size").alias("Unnamed: 4"),
    )
    return schema.reconcile_tagged(p)


@query(
    "p29_canonical_values",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE l_returnflag END AS flag FROM lineitem",
)
def _(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        S.lookup("l_returnflag", {"A": "accepted", "R": "returned"}, F.col("l_returnflag")).alias("flag"),
    )


# ---- data quality ----


@query(
    "q1_row_rules",
    f"WITH {PANEL_SQL} SELECT 'negative' AS rule, CAST(count(*) FILTER (WHERE size < 0 OR participants < 0) AS BIGINT) AS violations FROM panel UNION ALL "
    "SELECT 'size_below_participants', CAST(count(*) FILTER (WHERE size < participants) AS BIGINT) FROM panel UNION ALL "
    "SELECT 'blocs_differ_from_valid', CAST(count(*) FILTER (WHERE vote_g + vote_cg + vote_c + vote_cd + vote_d <> valid) AS BIGINT) FROM panel UNION ALL "
    "SELECT 'some_valid', CAST(count(*) FILTER (WHERE NOT valid > 0) AS BIGINT) FROM panel",
)
def _(spark, sf):
    total = S.row_sum(VOTES)
    return quality.expectations(
        panel(spark, sf),
        {
            "negative": (F.col("size") >= 0) & (F.col("participants") >= 0),
            "size_below_participants": F.col("size") >= F.col("participants"),
            "blocs_differ_from_valid": total == F.col("valid"),
            "some_valid": F.col("valid") > 0,
        },
    )


@query(
    "q2_not_finite_profile",
    f"WITH {PANEL_SQL} SELECT 'amount' AS column_name, CAST(count(*) FILTER (WHERE amount IS NULL) AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS nans, CAST(0 AS BIGINT) AS infs FROM panel "
    "UNION ALL SELECT 'valid_amount', CAST(count(*) FILTER (WHERE valid_amount IS NULL) AS BIGINT), 0, 0 FROM panel",
)
def _(spark, sf):
    return quality.null_profile(panel(spark, sf), ["amount", "valid_amount"])


@query("q3_duplicate_keys", "SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def _(spark, sf):
    return quality.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "q4_bloc_total_report",
    f"WITH {PANEL_SQL}, t AS (SELECT entity, period, valid, vote_g + vote_cg + vote_c + vote_cd + vote_d AS five, vote_g + vote_cg + vote_c + vote_cd AS three, vote_g + vote_d AS two FROM panel) "
    "SELECT entity, period, five = valid AS five_match, three = valid AS three_match, two = valid AS two_match, abs(five - valid) AS five_diff, abs(three - valid) AS three_diff, abs(two - valid) AS two_diff FROM t",
)
def _(spark, sf):
    sums = {"five": VOTES, "three": VOTES[:4], "two": ["vote_g", "vote_d"]}
    return quality.total_report(panel(spark, sf), ["entity", "period"], "valid", sums)


@query("q5_column_range", "SELECT min(l_discount) AS low, max(l_discount) AS high FROM lineitem")
def _(spark, sf):
    return quality.column_range(table(spark, sf, "lineitem"), "l_discount")


@query("a22_profile_summary", f"WITH {PANEL_SQL} SELECT 'valid_amount' AS column_name, CAST(count(valid_amount) AS BIGINT) AS filled, min(valid_amount) AS low, max(valid_amount) AS high, round(avg(valid_amount), 4) AS mean, round(stddev_samp(valid_amount), 4) AS sd FROM panel "
       "UNION ALL SELECT 'size', CAST(count(size) AS BIGINT), min(size), max(size), round(avg(size), 4), round(stddev_samp(size), 4) FROM panel")
def _(spark, sf):
    return quality.summary(panel(spark, sf), ["valid_amount", "size"], digits=4)


