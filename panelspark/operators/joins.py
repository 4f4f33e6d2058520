"""Joins beyond the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Width of a range of periods that one task carries values through, in reaches.
RANGE_REACHES = 8


class CardinalityError(ValueError):
    """A join key repeats on a side that should hold it once."""


def assert_unique(df: DataFrame, keys: list[str], side: str) -> None:
    bad = df.groupBy(*keys).count().where("count > 1").limit(1).count()
    if bad:
        raise CardinalityError(f"{side} repeats a key of {keys}")


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "m:1") -> DataFrame:
    """Join after testing that the sides declared ``1`` hold every key once."""
    l, r = validate.split(":")
    if l == "1":
        assert_unique(left, on, "left")
    if r == "1":
        assert_unique(right, on, "right")
    return left.join(right, on, how)


def latest_within(facts: DataFrame, wanted: DataFrame, keys: list[str], period: str, value: str, reach: int) -> DataFrame:
    """As-of backfill: the value of the wanted period, else the latest of the ``reach`` periods before.

    Facts and requests of a key go by period in one stream, in which the last known value is carried
    with its period and dropped where it lies too far back. No fact is copied for its reach. Keys
    are dealt by (key, range of periods): a range takes the facts of the range before it along, so
    a key with most of the rows is shared by several tasks.
    """
    width = max(1, RANGE_REACHES * reach)
    slot = lambda p: F.floor(p / F.lit(width))
    known = facts.where(F.col(value).isNotNull()).select(*keys, F.col(period).alias("_at"), F.lit(0).alias("_asked"), F.col(value).alias("_v"))
    # of a range only its last ``reach`` periods can serve the next one
    near_end = F.col("_at") + reach >= (slot(F.col("_at")) + 1) * width
    held = known.withColumn("_slot", F.explode(F.when(near_end, F.array(slot(F.col("_at")), slot(F.col("_at")) + 1)).otherwise(F.array(slot(F.col("_at"))))))
    # of several facts of one period the greatest counts
    held = held.groupBy(*keys, "_slot", "_at", "_asked").agg(F.max("_v").alias("_v"))
    asked = wanted.select(*keys, F.col(period).alias("_at")).distinct()
    asked = asked.withColumns({"_slot": slot(F.col("_at")), "_asked": F.lit(1), "_v": F.lit(None).cast(facts.schema[value].dataType)})
    stream = held.unionByName(asked)
    upto = Window.partitionBy(*keys, "_slot").orderBy("_at", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_asked") == 0, F.struct(F.col("_v").alias("v"), F.col("_at").alias("p"))), ignorenulls=True).over(upto)
    found = stream.withColumn("_last", last).where("_asked = 1").withColumn("_last", F.when(F.col("_last.p") >= F.col("_at") - reach, F.col("_last")))
    best = found.select(*keys, F.col("_at").alias(period), F.col("_last.v").alias(value), F.col("_last.p").alias(f"{value}_from"))
    return wanted.join(best, [*keys, period], "left")


def previous_event(df: DataFrame, kind: str, period: str) -> DataFrame:
    """Latest earlier period of the same kind, and the one before it, per (kind, period)."""
    w = Window.partitionBy(kind).orderBy(period)
    return (
        df.select(kind, period)
        .distinct()
        .select(kind, period, F.lag(period, 1).over(w).alias("previous"), F.lag(period, 2).over(w).alias("previousprevious"))
    )


def crosswalk(df: DataFrame, mapping: DataFrame, code: str, old: str, new: str) -> DataFrame:
    """Replace codes found in the mapping, keep the others."""
    m = mapping.select(F.col(old).alias(code), F.col(new).alias("_new"))
    return df.join(m, code, "left").withColumn(code, F.coalesce("_new", code)).drop("_new")


def own_or_parent(df: DataFrame, values: DataFrame, code: str, parent: str, value: str) -> DataFrame:
    """Value of the row's own code, else of its parent code."""
    own = values.select(F.col(code), F.col(value).alias("_own"))
    up = values.select(F.col(code).alias(parent), F.col(value).alias("_up"))
    return df.join(own, code, "left").join(up, parent, "left").withColumn(value, F.coalesce("_own", "_up")).drop("_own", "_up")


def two_sided_lookup(pairs: DataFrame, values: DataFrame, key: str, value: str, source: str, target: str) -> DataFrame:
    """Value at both ends of every pair."""
    a = values.select(F.col(key).alias(source), F.col(value).alias(f"{value}_{source}"))
    b = values.select(F.col(key).alias(target), F.col(value).alias(f"{value}_{target}"))
    return pairs.join(a, source).join(b, target)


def outer_on_keys(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Many-way full outer join as one union and one aggregation (a single shuffle).

    Every frame must hold each key once; ``first`` then picks its only value.
    """
    cols = [(n, c) for n, f in frames.items() for c in f.columns if c not in keys]
    union = None
    for n, f in frames.items():
        part = f.select(*keys, *[(F.col(c) if m == n else F.lit(None)).alias(c) for m, c in cols])
        part = part if union is None else part
        union = part if union is None else union.unionByName(part)
    return union.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for _, c in cols])


def districts_of(df: DataFrame, mapping: DataFrame, entity: str, parents: dict[str, tuple[int, int]], measures: list[str]) -> DataFrame:
    """Map entities to districts after adding absent cities as the sum of their arrondissements.

    ``parents`` gives, for a city code, the first and last arrondissement code.
    """
    code = F.col(entity).try_cast("bigint")
    city = F.lit(None).cast("string")
    for parent, (first, last) in parents.items():
        city = F.when(code.between(first, last), F.lit(parent)).otherwise(city)
    sums = (
        df.withColumn("_city", city)
        .where(F.col("_city").isNotNull())
        .groupBy("_city")
        .agg(*[F.sum(m).alias(m) for m in measures])
        .withColumnRenamed("_city", entity)
    )
    missing = sums.join(df.select(entity), entity, "left_anti")
    full = df.select(entity, *measures).unionByName(missing)
    return full.join(mapping, entity)


def same_key_pairs(df: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """(period a < period b) values of one entity, from one array per entity.

    The panel holds one row per (keys, period), so an entity gives at most
    P(P-1)/2 rows for P periods; hot entities are already folded.
    """
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(period).alias("t"), F.col(value).alias("v")))).alias("_s"))
    left = packed.select(*keys, "_s", F.posexplode("_s").alias("_i", "_a"))
    return left.select(*keys, F.col("_a").alias("a"), F.explode(F.slice("_s", F.col("_i") + 2, F.size("_s"))).alias("b"))


def sided(c: str, side: str) -> Column:
    return F.col(f"{c}_{side}")
