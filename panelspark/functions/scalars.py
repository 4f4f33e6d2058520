"""Casts, guarded arithmetic and code handling as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lenient(c: Column | str, kind: str = "double") -> Column:
    """Cast that yields null instead of failing on unreadable text."""
    return col(c).try_cast(kind)


def zero_pad(c: Column | str, width: int = 5) -> Column:
    """Left-pad with zeros; codes longer than ``width`` pass unchanged (``lpad`` alone truncates)."""
    text = col(c).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def finite(c: Column | str) -> Column:
    """NaN and infinities become null."""
    x = col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def clip(c: Column | str, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Clip that keeps null (``greatest``/``least`` alone would return the bound)."""
    x = col(c)
    out = x
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(float(low)))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(float(high)))
    return F.when(x.isNotNull(), out)


def ratio(n: Column | str, d: Column | str) -> Column:
    """Division that yields null on a zero denominator."""
    return F.try_divide(col(n).cast("double"), col(d).cast("double"))


def safe_share(n: Column | str, d: Column | str, digits: int | None = 2) -> Column:
    """n/d in [0, 1]: 0/0 is 0, n/0 is 1, null stays null; half-even rounding."""
    num, den = col(n).cast("double"), col(d).cast("double")
    share = (
        F.when(num.isNull() | den.isNull(), F.lit(None).cast("double"))
        .when(den == 0, F.when(num > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(clip(F.try_divide(num, den), 0.0, 1.0))
    )
    return share if digits is None else F.bround(share, digits)


def row_sum(cols: list) -> Column:
    """Sum across columns with null counted as zero."""
    return reduce(add, [F.coalesce(col(c), F.lit(0)) for c in cols])


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


def row_argmax(cols: list[str], names: list[str] | None = None) -> Column:
    """Name of the largest column of a row; the first column wins ties, null loses."""
    labels = names or cols
    cells = [
        F.struct(col(c).cast("double").alias("v"), F.lit(-i).alias("p"), F.lit(n).alias("name"))
        for i, (c, n) in enumerate(zip(cols, labels))
    ]
    present = F.filter(F.array(*cells), lambda s: s["v"].isNotNull())
    return F.when(F.size(present) > 0, F.array_max(present)["name"])


def in_code_range(c: Column | str, low: str, high: str, extra: list[str]) -> Column:
    """First two characters inside a string range or in an extra list."""
    head = F.substring(col(c), 1, 2)
    return head.between(low, high) | head.isin(extra)


def region_number(c: Column | str, special: dict[str, float]) -> Column:
    """Numeric region from the first two characters, with fixed values for lettered codes."""
    head = F.substring(col(c), 1, 2)
    out = F.when(F.lit(False), F.lit(0.0))
    for code, number in special.items():
        out = out.when(head == code, F.lit(float(number)))
    return out.otherwise(lenient(head))


def lookup(c: Column | str, mapping: dict, default: Column | None = None) -> Column:
    """Fixed small mapping as a literal map."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.create_map(*pairs)[col(c)]
    return found if default is None else F.coalesce(found, default)


def composites(prefix: str = "vote_") -> dict[str, Column]:
    """Two- and three-way groupings of the five blocs; the centre is split in half."""
    g, cg, c, cd, d = (F.col(f"{prefix}{b}") for b in ("g", "cg", "c", "cd", "d"))
    return {
        f"{prefix}gcg": g + cg,
        f"{prefix}dcd": d + cd,
        f"{prefix}tg": g + cg + c / 2,
        f"{prefix}td": d + cd + c / 2,
    }


def half_ballot_share(p: Column | str, size: Column | str) -> Column:
    """Move shares of exactly 0 or 1 half a ballot inside the open interval."""
    x, n = col(p), col(size).cast("double")
    return F.when(x == 1.0, F.try_divide(n - 0.5, n)).when(x == 0.0, F.try_divide(F.lit(0.5), n)).otherwise(x)


def logit(p: Column | str, size: Column | str, edge: str = "half") -> Column:
    """ln(p/(1-p)) with the half-ballot correction; ``edge='raw'`` stores the correction unlogged."""
    x, n = col(p), col(size).cast("double")
    if edge == "raw":
        corrected = half_ballot_share(x, n)
        return (
            F.when(n == 0, F.lit(0.0))
            .when((x == 0.0) | (x == 1.0), corrected)
            .otherwise(F.ln(F.try_divide(x, 1 - x)))
        )
    q = half_ballot_share(x, n)
    return F.ln(F.try_divide(q, 1 - q))


# Share assumed for a missing measure, by how many blocs the measure splits the vote into.
DEFAULT_SHARES = {2: 0.5, 3: 0.33, 5: 0.2, 0: 0.0}


def default_share(c: Column | str, blocs: int) -> Column:
    return F.coalesce(col(c), F.lit(DEFAULT_SHARES[blocs]))


def haversine_km(lat1, lon1, lat2, lon2, radius_km: float = 6371.0088) -> Column:
    """Great-circle distance of two points in degrees."""
    a1, o1, a2, o2 = (F.radians(col(c) if not isinstance(c, (int, float)) else F.lit(float(c))) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return F.lit(2.0 * radius_km) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def has_control_chars(c: Column | str) -> Column:
    """True when a text holds control or zero-width characters."""
    return col(c).rlike("[\\x00-\\x1F\\x7F\\u200B-\\u200D\\uFEFF]")


def stable_number(c: Column | str, seed: int = 42) -> Column:
    """60 bits of the MD5 of key and seed: the same in every engine, and in every task computed anew."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", col(c).cast("string"), F.lit(seed)).cast("binary")), 1, 15), 16, 10).cast("bigint")


def stable_bucket(c: Column | str, buckets: int, seed: int = 42) -> Column:
    """Bucket number that depends on the key alone."""
    return F.pmod(stable_number(c, seed), F.lit(buckets)).cast("int")
