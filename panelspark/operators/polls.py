"""Poll tables: formatting, candidate restriction, blocs, errors and filtering of series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lookup, ratio
from ..functions.text import POLLSTERS, french_end_date, noisy_integer, percent_number
from ..session import cut_lineage

# Names that stand for no candidate, and the name that all others are summed under.
NOT_A_CANDIDATE = ["Abstention", "Indécis", "Indécis (échantillon)"]
OTHERS = "Autres"


def format_polls(df: DataFrame, year: int, pollster: str = "Sondeur", dates: str = "Dates", sample: str = "Échantillon") -> DataFrame:
    """Pollster names repaired, end date read, sample and percentages turned into numbers."""
    fixed = [pollster, dates, sample]
    out = df.select(
        lookup(pollster, POLLSTERS, F.col(pollster)).alias(pollster),
        F.col(dates),
        french_end_date(dates, year).alias("end_date"),
        *([noisy_integer(F.col(sample)).alias(sample)] if sample in df.columns else []),
        *[percent_number(F.col(f"`{c}`")).alias(c) for c in df.columns if c not in fixed],
    )
    return out


def restrict_candidates(long: DataFrame, poll: list[str], name: str, value: str, candidates: list[str], tolerance: float = 10.0) -> DataFrame:
    """Keep the candidates; all other names become ``Autres``; polls far from 100 go.

    A former ``Autres`` is replaced by the sum of the other names, so it is left out.
    """
    skip = F.col(name).isin([*NOT_A_CANDIDATE, OTHERS])
    named = long.where(~skip).withColumn(name, F.when(F.col(name).isin(candidates), F.col(name)).otherwise(F.lit(OTHERS)))
    merged = named.groupBy(*poll, name).agg(F.sum(value).alias(value))
    totals = merged.groupBy(*poll).agg(F.sum(value).alias("_total")).where(F.abs(F.col("_total") - 100) <= tolerance)
    return merged.join(totals.drop("_total"), poll, "left_semi")


def add_blocs(long: DataFrame, poll: list[str], name: str, value: str, blocs: dict[str, list[str]]) -> DataFrame:
    """Bloc sums per poll, shifted so that their mean total is 100, and the composites."""
    raw = long.groupBy(*poll).agg(
        *[F.coalesce(F.sum(F.when(F.col(name).isin(names), F.col(value))), F.lit(0.0)).alias(f"{b}_raw") for b, names in blocs.items()]
    )
    total = sum((F.col(f"{b}_raw") for b in blocs), F.lit(0.0))
    shift = raw.select(((F.lit(100.0) - F.avg(total)) / len(blocs)).alias("d"))
    out = raw.withColumn("_d", shift.scalar())
    out = out.withColumns({b: F.col(f"{b}_raw") + F.col("_d") for b in blocs}).drop("_d")
    g, cg, c, cd, d = (F.col(b) for b in blocs)
    return out.withColumns({"gcg": g + cg, "dcd": d + cd, "tg": g + cg + c / 2, "td": d + cd + c / 2})


def poll_errors(polls: DataFrame, truth: DataFrame, cols: list[str], left: str = "tg", right: str = "td") -> DataFrame:
    """Per poll against the one-row truth: mse, rmse, mae, mape (zero truth left out), bias |Δleft| - |Δright|."""
    out = polls
    for c in dict.fromkeys([*cols, left, right]):
        out = out.withColumn(f"_t_{c}", truth.select(c).scalar())
    gap = lambda c: F.col(c) - F.col(f"_t_{c}")
    pct = lambda c: ratio(F.abs(gap(c)), F.when(F.col(f"_t_{c}") != 0, F.col(f"_t_{c}")))

    def mean(cells: list[Column]) -> Column:
        known = F.filter(F.array(*cells), lambda x: x.isNotNull())
        return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, b: a + b), F.size(known).cast("double"))

    errors = {
        "mse": mean([gap(c) * gap(c) for c in cols]),
        "rmse": F.sqrt(mean([gap(c) * gap(c) for c in cols])),
        "mae": mean([F.abs(gap(c)) for c in cols]),
        "mape": mean([pct(c) for c in cols]),
        "bias": F.abs(gap(left)) - F.abs(gap(right)),
    }
    return out.withColumns(errors).drop(*[f"_t_{c}" for c in dict.fromkeys([*cols, left, right])])


#: Days of a series that are filtered one after the other; a longer series is filtered in chunks.
CHUNK_DAYS = 50_000

#: What a run of days does to any state before it: arrays A, b, C, eta, J with one row for each run.
Element = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def day_elements(z: np.ndarray, n: np.ndarray, q: tuple[float, float], r: float) -> Element:
    """One element for each day: predict, then update with ``n`` polls of mean ``z`` if there are any."""
    seen = n > 0
    s = q[0] + r / np.where(seen, n, 1)
    gain, z = np.where(seen, q[0] / s, 0.0), np.where(seen, z, 0.0)
    zero, one = np.zeros(len(n)), np.ones(len(n))
    stack = lambda *rows: np.stack([np.stack(row, -1) for row in rows], -2)
    known = np.where(seen, 1 / s, 0.0)
    return stack((1 - gain, 1 - gain), (zero, one)), np.stack([gain * z, zero], -1), stack(((1 - gain) * q[0], zero), (zero, one * q[1])), np.stack([z * known, z * known], -1), stack((known, known), (known, known))


def joined_elements(i: Element, j: Element) -> Element:
    """The element of each run followed by another; joining is associative."""
    (a1, b1, c1, e1, j1), (a2, b2, c2, e2, j2) = i, j
    turned = lambda m: np.swapaxes(m, -1, -2)
    times = lambda m, v: (m @ v[..., None])[..., 0]
    forth = a2 @ np.linalg.inv(np.eye(2) + c1 @ j2)
    back = turned(a1) @ np.linalg.inv(np.eye(2) + j2 @ c1)
    return forth @ a1, times(forth, b1 + times(c1, e2)) + b2, forth @ c1 @ turned(a2) + c2, times(back, e2 - times(j2, b1)) + e1, back @ j2 @ a1 + j1


def run_element(days: Element) -> Element:
    """All days joined, neighbours by neighbours."""
    while len(days[0]) > 1:
        even = len(days[0]) // 2 * 2
        pairs = joined_elements(tuple(x[0:even:2] for x in days), tuple(x[1:even:2] for x in days))
        days = tuple(np.concatenate([p, x[even:]]) for p, x in zip(pairs, days))
    return days


def kalman_level(
    df: DataFrame,
    series: list[str],
    day: str,
    value: str,
    q: tuple[float, float] = (1.0, 3.0),
    r: float = 100.0,
    x0: tuple[float, float] = (50.0, 50.0),
    p0: tuple[float, float] = (1.0, 1.0),
) -> DataFrame:
    """Level and slope of each series by a constant-velocity Kalman filter (predict, then update).

    ``day`` is a date. The polls of one day count as their mean with the noise divided by
    their number, which equals one update for each; a day without values only predicts.

    A series of more than ``CHUNK_DAYS`` days is cut into chunks by its days. What a chunk does to any state before
    it is one element; the elements of a series, in order, give every chunk its starting state, and all
    chunks are filtered at the same time.
    """
    daily = cut_lineage(df.groupBy(*series, day).agg(F.avg(value).cast("double").alias("observed"), F.count(value).alias("_n")))
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*series, day]]
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    chunked = daily.withColumn("_chunk", F.floor(number / CHUNK_DAYS).cast("int"))
    # by calendar days: a chunk holds as many rows at most
    several = chunked.groupBy(*series).agg((F.max("_chunk") > F.min("_chunk")).alias("m")).where("m").limit(1).count() > 0
    state = ["level0", "slope0", "a0", "b0", "c0"]
    start = (*x0, p0[0], 0.0, p0[1])

    def element(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        found = run_element(day_elements(pdf["observed"].to_numpy(float), pdf["_n"].to_numpy(float), q, r))
        return pdf[[*series, "_chunk"]].head(1).assign(element=[np.concatenate([x[0].ravel() for x in found]).tobytes()])

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        """The state before each chunk of a series."""
        pdf, rows = pdf.sort_values("_chunk"), []
        now = (np.zeros((1, 2, 2)), np.array([x0], float), np.array([[[p0[0], 0.0], [0.0, p0[1]]]]), np.zeros((1, 2)), np.zeros((1, 2, 2)))
        for raw in pdf["element"]:
            rows.append((now[1][0, 0], now[1][0, 1], now[2][0, 0, 0], now[2][0, 0, 1], now[2][0, 1, 1]))
            x = np.frombuffer(raw)
            now = joined_elements(now, (x[:4].reshape(1, 2, 2), x[4:6].reshape(1, 2), x[6:10].reshape(1, 2, 2), x[10:12].reshape(1, 2), x[12:].reshape(1, 2, 2)))
        return pdf[[*series, "_chunk"]].assign(**{c: [row[i] for row in rows] for i, c in enumerate(state)})

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        level, slope, a, b, c = pdf[state].iloc[0] if several else start
        states = []
        for z, n in zip(pdf["observed"], pdf["_n"]):
            # predict: x = F x with F = [[1, 1], [0, 1]], P = F P F' + Q; P = [[a, b], [b, c]]
            level, a, b, c = level + slope, a + 2 * b + c + q[0], b + c, c + q[1]
            if n:
                gain0, gain1, miss = a / (a + r / n), b / (a + r / n), z - level
                level, slope = level + gain0 * miss, slope + gain1 * miss
                a, b, c = (1 - gain0) * a, (1 - gain0) * b, c - gain1 * b
            states.append((level, slope))
        return pdf[[*series, day, "observed"]].assign(level=[s[0] for s in states], slope=[s[1] for s in states])

    out = ", ".join([*kinds, "observed double", "level double", "slope double"])
    if not several:
        return chunked.groupBy(*series).applyInPandas(fold, out)
    ids = ", ".join([*kinds[:-1], "_chunk int"])
    found = chunked.groupBy(*series, "_chunk").applyInPandas(element, f"{ids}, element binary")
    before = found.groupBy(*series).applyInPandas(starts, f"{ids}, " + ", ".join(f"{c} double" for c in state))
    before = cut_lineage(before.withColumnsRenamed({c: f"_{c}" for c in [*series, "_chunk"]}))
    same = F.col("_chunk").eqNullSafe(F.col("__chunk"))
    for c in series:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return chunked.join(before, same).groupBy(*series, "_chunk").applyInPandas(fold, out)
