"""Ballots given in numbered slots: long form, label merging, bloc roll-up, city policy."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import composites, ratio
from ..functions.text import decimal_comma

# Fixed value: the label of votes without one.
OTHER = "AUTRES"


def slot_numbers(columns: list[str], votes: str) -> list[int]:
    """The numbers i for which there is a column ``{votes}i``."""
    return sorted(int(m[1]) for c in columns if (m := re.fullmatch(re.escape(votes) + r"(\d+)", c)))


def slots_to_long(df: DataFrame, keys: list[str], label: str, votes: str, share: str) -> DataFrame:
    """Slot columns ``{label}i, {votes}i, {share}i`` to rows (keys, slot, label, votes, share).

    The slots are those that the columns have, however many.

    A slot without label but with votes becomes ``AUTRES_j``, numbered in slot order inside
    its row; empty slots go. The numbering looks at the row's own array: no shuffle.
    """
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("slot"),
                F.when(F.col(f"`{label}{i}`") != "nan", F.col(f"`{label}{i}`")).alias("label"),
                decimal_comma(F.col(f"`{votes}{i}`")).alias("votes"),
                decimal_comma(F.col(f"`{share}{i}`")).alias("share"),
            )
            for i in slot_numbers(df.columns, votes)
        ]
    )

    def unlabelled(c: Column) -> Column:
        return c["label"].isNull() & (F.coalesce(c["votes"], F.lit(0.0)) > 0)

    numbers = F.transform(F.filter("_cells", unlabelled), lambda c: c["slot"])
    out = df.select(*keys, cells.alias("_cells")).select(*keys, numbers.alias("_free"), F.explode("_cells").alias("_c"))
    named = F.coalesce(
        F.col("_c.label"),
        F.when(
            F.array_position("_free", F.col("_c.slot")) > 0,
            F.concat(F.lit(f"{OTHER}_"), (F.array_position("_free", F.col("_c.slot")) - 1).cast("string")),
        ),
    )
    long = out.select(*keys, F.col("_c.slot").alias("slot"), named.alias("label"), F.col("_c.votes").alias("votes"), F.col("_c.share").alias("share"))
    return long.where(F.col("label").isNotNull())


def merge_labels(long: DataFrame, keys: list[str]) -> DataFrame:
    """Votes and shares of repeated labels summed."""
    return long.groupBy(*keys, "label").agg(F.sum("votes").alias("votes"), F.sum("share").alias("share"))


def wide_labels(merged: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """``vote_X`` and ``pvote_X`` columns for the given labels."""
    pick = lambda c, l: F.sum(F.when(F.col("label") == l, F.col(c)))
    return merged.groupBy(*keys).agg(
        *[pick("votes", l).alias(f"vote_{l}") for l in labels], *[pick("share", l).alias(f"pvote_{l}") for l in labels]
    )


def roll_up(merged: DataFrame, keys: list[str], mapping: dict[str, str], blocs: list[str]) -> DataFrame:
    """Labels to blocs: votes, shares as fractions, the unmapped ones under AUTRES, number of lists."""
    bloc = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[F.col("label")]
    named = merged.withColumn("_b", F.coalesce(bloc, F.lit(OTHER)))

    def total(c: str, b: str, scale: float = 1.0) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_b") == b, F.col(c))), F.lit(0.0)) / F.lit(scale)

    return named.groupBy(*keys).agg(
        *[total("votes", b).alias(f"vote_{b}") for b in blocs],
        *[total("share", b, 100.0).alias(f"pvote_{b}") for b in blocs],
        total("votes", OTHER).alias(f"vote_{OTHER}"),
        total("share", OTHER, 100.0).alias(f"pvote_{OTHER}"),
        F.count(F.lit(1)).alias("nb_list"),
        F.coalesce(F.sum("share"), F.lit(0.0)).alias("share_total"),
    )


def add_composites(df: DataFrame) -> DataFrame:
    return df.withColumns(composites("vote_") | composites("pvote_"))


def split_share_outliers(df: DataFrame, total: str = "share_total", tolerance: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Rows whose shares add up to 100 within the tolerance, and the rejected ones (total 0 is dropped from both)."""
    some = df.where(F.col(total) != 0)
    good = F.abs(F.col(total) - 100) < tolerance
    return some.where(good), some.where(~good)


def derive_rates(df: DataFrame, percents: dict[str, str]) -> DataFrame:
    """Percent texts to fractions; ``percents`` maps a text column to its rate column."""
    return df.withColumns({rate: decimal_comma(F.col(f"`{text}`")) / 100 for text, rate in percents.items()})


def rate_rules(participants: str, absent: str, size: str) -> dict[str, Column]:
    """Identities between counts and published rates."""
    return {
        "participation": F.abs(ratio(participants, size) - F.col("ppar")) < 0.01,
        "absence": F.abs(ratio(absent, size) - F.col("pabs")) < 0.01,
        "sum_to_one": F.abs(F.col("ppar") + F.col("pabs") - 1) < 0.01,
    }


def city_policy(df: DataFrame, entity: str, keys: list[str], cities: dict[str, tuple[int, int]], cols: list[str], keep: str) -> DataFrame:
    """Give districts the city's value where all of them lack a column, then keep one level.

    Values of 5 and more are counts and are divided by the number of districts; smaller ones
    are shares and are copied. ``keep='Arr'`` keeps districts, ``'Agg'`` keeps cities. Whether
    all districts lack a column is one count per (keys, city), joined back.
    """
    code = F.col(entity).try_cast("bigint")
    city, count = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, (a, b) in cities.items():
        city = F.when(code.between(a, b), F.lit(name)).otherwise(city)
        count = F.when(F.col("_city") == name, F.lit(float(b - a + 1))).otherwise(count)
    tagged = df.withColumn("_city", city)
    districts = tagged.where(F.col("_city").isNotNull())
    filled = districts.groupBy(*keys, "_city").agg(*[F.count(c).alias(f"_k_{c}") for c in cols])
    own = df.where(F.col(entity).isin(list(cities))).select(*keys, F.col(entity).alias("_city"), *[F.col(c).alias(f"_v_{c}") for c in cols])
    if keep == "Agg":
        return tagged.where(F.col("_city").isNull()).drop("_city")
    joined = tagged.where(~F.col(entity).isin(list(cities))).join(filled, [*keys, "_city"], "left").join(own, [*keys, "_city"], "left")

    def value(c: str) -> Column:
        v = F.col(f"_v_{c}")
        given = F.when(v >= 5, v / count).otherwise(v)
        return F.when(F.col(f"_k_{c}") == 0, F.coalesce(F.col(c), given)).otherwise(F.col(c))

    return joined.withColumns({c: value(c) for c in cols}).select(*df.columns)
