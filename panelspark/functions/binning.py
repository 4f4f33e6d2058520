"""Bin numbers from edge arrays (literal lists or array columns)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col


def edges_array(edges) -> Column:
    return edges if isinstance(edges, Column) else F.array(*[F.lit(float(e)) for e in edges])


def cut(c, edges) -> Column:
    """Right-closed bins (a, b]: number of edges below the value; null stays null."""
    x = col(c)
    return F.when(x.isNotNull(), F.size(F.filter(edges_array(edges), lambda e: e < x)))


def digitise(c, edges) -> Column:
    """Left-closed bins [a, b): number of edges not above the value; null stays null."""
    x = col(c)
    return F.when(x.isNotNull(), F.size(F.filter(edges_array(edges), lambda e: e <= x)))


def even_cut(c, edges: list[float]) -> Column:
    """``cut`` for edges that are evenly spaced up to rounding: one guess and two comparisons.

    The guess by division is corrected against the rounded edges, so long edge lists cost no scan.
    """
    width = edges[-1] / len(edges)
    x, table = col(c), edges_array(edges)
    guess = F.least(F.lit(len(edges)), F.greatest(F.lit(0), F.floor(x / F.lit(width)))).cast("int")
    above = F.coalesce(F.get(table, guess) < x, F.lit(False)).cast("int")
    below = F.coalesce(F.get(table, guess - 1) >= x, F.lit(False)).cast("int")
    return F.when(x.isNotNull(), guess + above - below)


def lower_edge(bin_no: Column, edges) -> Column:
    return F.get(edges_array(edges), bin_no - 1)


def upper_edge(bin_no: Column, edges) -> Column:
    return F.get(edges_array(edges), bin_no)


def equal_width_edges(low: float, high: float, bins: int) -> list[float]:
    return [low + (high - low) * i / bins for i in range(bins + 1)]


def log_edges(low: float, high: float, bins: int) -> list[float]:
    """Edges evenly spaced in the logarithm."""
    a, b = math.log(low), math.log(high)
    return [math.exp(a + (b - a) * i / bins) for i in range(bins + 1)]


def distance_edges(limit_km: float = 1000.0, bins: int = 300) -> list[float]:
    """Inner edges of the distance bins, rounded to two digits; the last bin is open."""
    return [round(limit_km * i / bins, 2) for i in range(1, bins)]
