"""Column functions on edge rows."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from panelspark.functions import binning, scalars as S, text


def one(spark, expr, **cols):
    df = spark.range(1).select(*[(F.lit(v) if v is not None else F.lit(None).cast("double")).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "n, d, want", [(1.0, 2.0, 0.5), (0.0, 0.0, 0.0), (3.0, 0.0, 1.0), (5.0, 2.0, 1.0), (-1.0, 2.0, 0.0), (None, 2.0, None), (1.0, None, None), (1.0, 8.0, 0.12)]
)
def test_safe_share(spark, n, d, want):
    assert one(spark, S.safe_share("n", "d"), n=n, d=d) == want


@pytest.mark.parametrize("code, want", [("1001", "01001"), ("2A004", "2A004"), ("1234567", "1234567"), ("", "00000")])
def test_zero_pad(spark, code, want):
    assert one(spark, S.zero_pad("c"), c=code) == want


def test_finite_and_clip_keep_null(spark):
    assert one(spark, S.finite("x"), x=float("nan")) is None
    assert one(spark, S.finite("x"), x=float("-inf")) is None
    assert one(spark, S.clip("x", 0, 1), x=None) is None
    assert one(spark, S.clip("x", 0, 1), x=7.0) == 1.0


def test_logit_edges(spark):
    assert one(spark, S.logit("p", "n"), p=1.0, n=100.0) == pytest.approx(math.log(99.5 / 0.5))
    assert one(spark, S.logit("p", "n"), p=0.0, n=100.0) == pytest.approx(math.log(0.5 / 99.5))
    assert one(spark, S.logit("p", "n", edge="raw"), p=0.0, n=100.0) == pytest.approx(0.005)
    assert one(spark, S.logit("p", "n", edge="raw"), p=0.3, n=0.0) == 0.0


def test_row_argmax_first_wins_and_null_loses(spark):
    assert one(spark, S.row_argmax(["a", "b"]), a=2.0, b=2.0) == "a"
    assert one(spark, S.row_argmax(["a", "b"]), a=None, b=-1.0) == "b"
    assert one(spark, S.row_argmax(["a", "b"]), a=None, b=None) is None


def test_cut_and_digitise_on_edges(spark):
    edges = [1.0, 2.0, 4.0]
    assert [one(spark, binning.cut("x", edges), x=x) for x in (0.5, 1.0, 1.5, 4.0, 9.0)] == [0, 0, 1, 2, 3]
    assert [one(spark, binning.digitise("x", edges), x=x) for x in (0.5, 1.0, 1.5, 4.0, 9.0)] == [0, 1, 1, 3, 3]
    assert one(spark, binning.cut("x", edges), x=None) is None


def test_even_cut_equals_cut(spark):
    edges = binning.distance_edges()
    xs = spark.range(0, 40000).select((F.col("id") / 37).alias("x")).union(spark.createDataFrame([(e,) for e in edges], "x double"))
    assert xs.where(binning.cut("x", edges) != binning.even_cut("x", edges)).count() == 0


def test_control_characters(spark):
    assert one(spark, S.has_control_chars("t"), t="a​b") is True
    assert one(spark, S.has_control_chars("t"), t="plain é") is False


@pytest.mark.parametrize("t, want", [("12,5 %", 12.5), ("<1", 0.5), ("< 1,5%", 0.75), ("—", None), ("12 %", 12.0), ("", None)])
def test_percent_number(spark, t, want):
    assert one(spark, text.percent_number("t"), t=t) == want


@pytest.mark.parametrize("t, want", [("1 005[4]", 1005), ("n.c.", None), ("964 pers.", 964)])
def test_noisy_integer(spark, t, want):
    assert one(spark, text.noisy_integer("t"), t=t) == want


D = datetime.date


@pytest.mark.parametrize(
    "t, want",
    [
        ("8 avril 2022", D(2022, 4, 8)),
        ("1er avril", D(2022, 4, 1)),
        ("6-8 avril", D(2022, 4, 8)),
        ("6 – 8 Avril 2021", D(2021, 4, 8)),
        ("31 mars 2021 - 4 avril 2022", D(2022, 4, 4)),
        ("30 déc. - 2 janv.", D(2023, 1, 2)),
        ("30 décembre 2021 - 2 janvier 2022", D(2022, 1, 2)),
        ("29-2 avril", D(2022, 5, 2)),
        ("29-2 décembre", D(2023, 1, 2)),
        ("31 février 2022", None),
        ("début avril", None),
        ("8 brumaire", None),
    ],
)
def test_french_end_date(spark, t, want):
    assert one(spark, text.french_end_date("t", 2022), t=t) == want


def test_haversine_known_distance(spark):
    got = one(spark, S.haversine_km("a", "b", 43.2965, 5.3698), a=48.8566, b=2.3522)
    assert got == pytest.approx(660.5, abs=1.0)
