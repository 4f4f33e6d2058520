"""Cleaning of French poll and ballot texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col

# French month names and short forms.
MONTHS = {
    "janvier": 1, "janv": 1, "jan": 1,
    "février": 2, "fevrier": 2, "fév": 2, "fev": 2, "févr": 2,
    "mars": 3,
    "avril": 4, "avr": 4,
    "mai": 5,
    "juin": 6,
    "juillet": 7, "juil": 7,
    "août": 8, "aout": 8,
    "septembre": 9, "sept": 9,
    "octobre": 10, "oct": 10,
    "novembre": 11, "nov": 11,
    "décembre": 12, "decembre": 12, "déc": 12, "dec": 12,
}

# Spelling variants of pollster names.
POLLSTERS = {
    "Harris Interractive": "Harris Interactive",
    "Cluster 17": "Cluster17",
    "Opinionway": "OpinionWay",
}

_DAY = r"(\d{1,2})(?:er)?"
_MONTH = r"([a-zà-ÿ]+)"
_YEAR = r"(?:\s+(\d{4}))?"
_DASH = r"\s*[-–—]\s*"


def percent_number(c: Column | str) -> Column:
    """'12,5 %' is 12.5, '<1' is half of 1, anything unreadable is null."""
    raw = F.trim(F.regexp_replace(col(c).cast("string"), "[\\u00A0\\u202F]", ""))
    digits = F.regexp_replace(F.regexp_replace(raw, ",", "."), r"[^\d.\-]", "")
    number = digits.try_cast("double")
    return F.when(raw.startswith("<"), number / 2).otherwise(number)


def noisy_integer(c: Column | str) -> Column:
    """Integer after footnote marks and every non-digit are removed."""
    bare = F.regexp_replace(col(c).cast("string"), r"\[.*?\]", "")
    return F.regexp_replace(bare, r"[^\d\-]", "").try_cast("bigint")


def decimal_comma(c: Column | str) -> Column:
    """'12,5%' is 12.5."""
    return F.translate(F.rtrim(col(c).cast("string"), F.lit("%")), ",", ".").try_cast("double")


def _month(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])[name]


def _date(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    whole = year.isNotNull() & month.isNotNull() & day.isNotNull()
    return F.when(whole, text.try_cast("date"))


def french_end_date(c: Column | str, default_year: Column | int) -> Column:
    """Last day of a French date or date range.

    Reads '14 juin 2018', '1er mars', '2-5 mai' and '30 août 2019 - 3 septembre 2020'.
    A side without a year takes ``default_year``; a range without years whose second
    month precedes the first ends in the next year; a same-month range that runs
    backwards ends in the next month; everything else is null.
    """
    year0 = (default_year if isinstance(default_year, Column) else F.lit(default_year)).cast("int")
    s = F.lower(F.regexp_replace(F.regexp_replace(col(c).cast("string"), r"\.", ""), "[\\s\\u00A0\\u202F]+", " "))
    s = F.trim(s)
    cross = f"^{_DAY} {_MONTH}{_YEAR}{_DASH}{_DAY} {_MONTH}{_YEAR}$"
    within = f"^{_DAY}{_DASH}{_DAY} {_MONTH}{_YEAR}$"
    single = f"^{_DAY} {_MONTH}{_YEAR}$"

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(s, pattern, i)

    def number(pattern: str, i: int) -> Column:
        return part(pattern, i).try_cast("int")

    m1, m2 = _month(part(cross, 2)), _month(part(cross, 5))
    y1, y2 = number(cross, 3), number(cross, 6)
    wraps = y1.isNull() & y2.isNull() & (m2 < m1)
    cross_year = F.when(wraps, year0 + 1).otherwise(F.coalesce(y2, year0))
    cross_end = F.when(m1.isNotNull(), _date(cross_year, m2, number(cross, 4)))

    month = _month(part(within, 3))
    year = F.coalesce(number(within, 4), year0)
    runs_back = number(within, 2) < number(within, 1)
    next_month = F.when(month == 12, F.lit(1)).otherwise(month + 1)
    next_year = F.when(month == 12, year + 1).otherwise(year)
    within_end = F.when(runs_back, _date(next_year, next_month, number(within, 2))).otherwise(
        _date(year, month, number(within, 2))
    )

    single_end = _date(F.coalesce(number(single, 3), year0), _month(part(single, 2)), number(single, 1))
    return (
        F.when(s.rlike(cross), cross_end)
        .when(s.rlike(within), within_end)
        .when(s.rlike(single), single_end)
    )
