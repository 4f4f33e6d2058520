"""Schema conformance, column selection, row filters and column-drop rules."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import any_of, col

BLOCS = ["g", "cg", "c", "cd", "d"]
GROUPS = ["tg", "td", "gcg", "dcd"]

ELECTION_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("region", "region_name", "entity", "entity_name", "kind", "event")]
    + [T.StructField("period", T.LongType()), T.StructField("kind_no", T.ByteType())]
    + [T.StructField(n, T.DoubleType()) for n in ["size", "participants", "valid"] + [f"vote_{b}" for b in BLOCS + GROUPS]]
)

INDICATOR_SCHEMA = T.StructType(
    [T.StructField("entity", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("period", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in ("raw", "lag", "rank", "delta", "pct_change")]
)


def conform(df: DataFrame, schema: T.StructType, strict: bool = False) -> DataFrame:
    """Cast known columns, insert absent ones as null, leave out the rest, in schema order."""
    have = set(df.columns)
    out = []
    for field in schema:
        if field.name not in have:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif strict:
            out.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            out.append(F.col(field.name).try_cast(field.dataType).alias(field.name))
    return df.select(*out)


def select_renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Keep and rename the mapped columns that exist."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in mapping.items() if old in have])


def columns_matching(df: DataFrame, pattern: str | None = None, prefix: str | None = None, exclude: str | None = None) -> list[str]:
    return [
        c
        for c in df.columns
        if (pattern is None or re.search(pattern, c))
        and (prefix is None or c.startswith(prefix))
        and (exclude is None or not re.search(exclude, c))
    ]


def feature_groups(df: DataFrame, target_previous: str, groups: list[str]) -> list[str]:
    """Ordered feature columns of the named groups."""
    previous = [c for c in (target_previous, f"previous{target_previous}") if c in df.columns]
    known = {g: columns_matching(df, prefix=f"F_{g}_") for g in ("rank", "raw", "pct_change", "delta", "lag")}
    known |= {"geo": ["lat", "long"], "previous_vote": previous, "other": ["size", "region_no"]}
    return [c for g in groups for c in known.get(g, [])]


def feature_names(metrics: list[str], names: list[str]) -> list[str]:
    """``F_{metric}_{source/name}`` for every metric and name."""
    return [f"F_{m}_{n}" for m in metrics for n in names]


def prefix_features(df: DataFrame, meta: list[str], prefix: str = "F_") -> DataFrame:
    return df.select(*meta, *[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in df.columns if c not in meta])


def year_to_suffix(df: DataFrame) -> DataFrame:
    """``x2021tail`` becomes ``xtail2021``."""
    moved = {c: re.sub(r"^(.*?)(\d{4})(\D+)$", r"\1\3\2", c) for c in df.columns}
    return df.withColumnsRenamed(moved)


def year_from_suffix(df: DataFrame, year: int, kind: str) -> DataFrame:
    """Drop the year from the names and keep it as a column."""
    renamed = {c: re.sub(rf"{year}$", "", c) for c in df.columns}
    return df.withColumnsRenamed(renamed).withColumns({"period": F.lit(year).cast("bigint"), "kind": F.lit(kind)})


def shared_columns(a: DataFrame, b: DataFrame) -> tuple[list[str], list[str]]:
    """Columns in both frames and columns in one only."""
    left, right = set(a.columns), set(b.columns)
    return sorted(left & right), sorted(left ^ right)


def drop_all_null_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop(how="all", subset=cols)


def keep_any_non_negative(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.where(any_of([F.col(c) >= 0 for c in cols]))


def zero_cascade(df: DataFrame, measures: list[str]) -> DataFrame:
    """Size 0 zeroes everything below it, participants 0 zeroes the rest; both leave a flag."""

    def zeroed(cols: list[str], by: str) -> dict[str, Column]:
        return {c: F.when(F.col(by) == 0, F.lit(0.0)).otherwise(F.col(c).cast("double")) for c in cols}

    step = df.withColumns(zeroed(["participants", "valid", *measures], "size") | {"no_size": F.coalesce(F.col("size") == 0, F.lit(False))})
    return step.withColumns(zeroed(["valid", *measures], "participants") | {"no_participants": F.coalesce(F.col("participants") == 0, F.lit(False))})


def null_shares(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """Share of null rows per column, overall or per group, in one aggregation."""
    return df.groupBy(*by).agg(*[F.avg(col(f"`{c}`").isNull().cast("double")).alias(c) for c in cols])


def drop_sparse_columns(df: DataFrame, cols: list[str], threshold: float, by: list[str] = ()) -> DataFrame:
    """Drop columns whose null share reaches the threshold (in any group when ``by`` is given).

    Only one row per group of shares reaches the driver.
    """
    worst = null_shares(df, cols, by).agg(*[F.max(f"`{c}`").alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if worst[c] is None or worst[c] >= threshold])


def drop_all_null_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    counts = df.agg(*[F.count(f"`{c}`").alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if counts[c] == 0])


def constant_columns(df: DataFrame, cols: list[str]) -> list[str]:
    spread = df.agg(*[F.stddev_samp(f"`{c}`").alias(c) for c in cols]).first()
    return [c for c in cols if spread[c] is None or spread[c] == 0]


def drop_constant_columns(df: DataFrame, cols: list[str], apply: bool = True) -> DataFrame:
    """Drop columns without variation; ``apply=False`` only reports them, by printing."""
    found = constant_columns(df, cols)
    if not apply:
        print(f"{len(found)} columns without variation: {found}")
        return df
    return df.drop(*found)


def encode_kind_by_target(df: DataFrame, kind: str, period: str, targets: list[str], out: str) -> DataFrame:
    """Kind becomes the mean over periods of the mean of its target means."""
    yearly = df.groupBy(kind, period).agg(*[F.avg(t).alias(t) for t in targets])
    mean = reduce(lambda a, b: a + b, [F.col(t) for t in targets]) / len(targets)
    code = yearly.withColumn("_m", mean).groupBy(kind).agg(F.avg("_m").alias(out))
    return df.join(code, kind, "left")


def split_annotations(df: DataFrame, cells: str) -> tuple[DataFrame, DataFrame]:
    """Data rows and annotation rows (all non-null cells hold one value)."""
    filled = F.filter(F.col(cells), lambda c: c.isNotNull() & (F.trim(c) != ""))
    same = F.size(F.array_distinct(filled)) == 1
    return df.where(~same), df.where(same)


def reconcile_tagged(df: DataFrame, tag: str = r"\s*\[N\s*5\]\s*") -> DataFrame:
    """Columns tagged with a footnote overwrite their base column where filled; unnamed columns go."""
    keep = [c for c in df.columns if not c.startswith("Unnamed")]
    tagged = [c for c in keep if re.search(tag, c)]
    base = {c: re.sub(tag, " ", c).strip() for c in tagged}
    out = df.select(*[F.col(f"`{c}`") for c in keep])
    for t, b in base.items():
        merged = F.coalesce(F.col(f"`{t}`"), F.col(f"`{b}`")) if b in keep else F.col(f"`{t}`")
        out = out.withColumn(b, merged).drop(t)
    return out


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions)
