"""Roles of the shared tables: customers are entities, nations regions, order years periods.

Order priorities stand for the five blocs and market segments for the kind of event.
Money is summed in whole cents, so both engines add integers and agree to the last digit.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

# Which priority plays which bloc.
BLOC_OF = {"1-URGENT": "g", "2-HIGH": "cg", "3-MEDIUM": "c", "4-NOT SPECIFIED": "cd", "5-LOW": "d"}
BLOCS = list(BLOC_OF.values())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its entity, region, kind, period, bloc and status."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    bloc = F.create_map(*[F.lit(x) for kv in BLOC_OF.items() for x in kv])[F.col("o_orderpriority")]
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("ballot"),
        F.col("o_custkey").alias("entity"),
        F.col("c_nationkey").cast("bigint").alias("region"),
        F.col("c_mktsegment").alias("kind"),
        F.year("o_orderdate").cast("bigint").alias("period"),
        bloc.alias("bloc"),
        F.col("o_orderstatus").alias("status"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
    )


def measures() -> list:
    used = F.col("status") != "P"
    valid = F.col("status") == "F"
    return [
        F.count(F.lit(1)).cast("double").alias("size"),
        F.count(F.when(used, 1)).cast("double").alias("participants"),
        F.count(F.when(valid, 1)).cast("double").alias("valid"),
        *[F.count(F.when(valid & (F.col("bloc") == b), 1)).cast("double").alias(f"vote_{b}") for b in BLOCS],
        (F.sum("cents").cast("double") / 100).alias("amount"),
        (F.sum(F.when(valid, F.col("cents"))).cast("double") / 100).alias("valid_amount"),
    ]


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse panel: one row per (entity, period); amounts of absent statuses are null."""
    return ballots(spark, sf_dir).groupBy("entity", "region", "kind", "period").agg(*measures())


def stored_panel(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The panel written once, for queries that read it in several branches."""
    return cut_lineage(panel(spark, sf_dir).select(*cols))


def region_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense panel: one row per (region, kind, period)."""
    return ballots(spark, sf_dir).groupBy("region", "kind", "period").agg(*measures())


BALLOTS_SQL = (
    "ballots AS (SELECT o_orderkey AS ballot, o_custkey AS entity, CAST(c_nationkey AS BIGINT) AS region, c_mktsegment AS kind, "
    "CAST(year(o_orderdate) AS BIGINT) AS period, CASE o_orderpriority "
    + " ".join(f"WHEN '{p}' THEN '{b}'" for p, b in BLOC_OF.items())
    + " END AS bloc, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS cents "
    "FROM orders JOIN customer ON o_custkey = c_custkey)"
)

MEASURES_SQL = (
    "CAST(count(*) AS DOUBLE) AS size, CAST(count(*) FILTER (WHERE status <> 'P') AS DOUBLE) AS participants, "
    "CAST(count(*) FILTER (WHERE status = 'F') AS DOUBLE) AS valid, "
    + ", ".join(f"CAST(count(*) FILTER (WHERE status = 'F' AND bloc = '{b}') AS DOUBLE) AS vote_{b}" for b in BLOCS)
    + ", CAST(sum(cents) AS DOUBLE) / 100 AS amount, CAST(sum(cents) FILTER (WHERE status = 'F') AS DOUBLE) / 100 AS valid_amount"
)

PANEL_SQL = f"{BALLOTS_SQL}, panel AS (SELECT entity, region, kind, period, {MEASURES_SQL} FROM ballots GROUP BY entity, region, kind, period)"
REGION_SQL = f"{BALLOTS_SQL}, rpanel AS (SELECT region, kind, period, {MEASURES_SQL} FROM ballots GROUP BY region, kind, period)"


@cache
def share_sql(n: str, d: str, digits: int | None = 2) -> str:
    core = (
        f"CASE WHEN ({n}) IS NULL OR ({d}) IS NULL THEN NULL WHEN ({d}) = 0 THEN CASE WHEN ({n}) > 0 THEN 1.0 ELSE 0.0 END "
        f"ELSE least(greatest(({n}) / ({d}), 0.0), 1.0) END"
    )
    core = f"CAST({core} AS DOUBLE)"
    return core if digits is None else f"round_even({core}, {digits})"


def stable_sql(key: str, seed: int = 42) -> str:
    """The number that ``stable_number`` gives a key."""
    return f"CAST('0x' || substr(md5({key} || '|{seed}'), 1, 15) AS BIGINT)"


def part_sql(key: str) -> str:
    b = f"({stable_sql(key)} % 10000)"
    return f"CASE WHEN {b} < 2000 THEN 'test' WHEN {b} < 4000 THEN 'val' ELSE 'train' END"


def r(c, digits: int = 6):
    """Rounded output column, so that summation order cannot show."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)
