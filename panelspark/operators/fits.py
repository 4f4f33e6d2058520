"""Parametric fits per group as grouped aggregation over an exponent grid.

The inputs are binned points (a few dozen per group). Each point is copied once per grid
value by a narrow explode; the linear part of the fit is closed-form from sums that
combine before the shuffle, and the best grid value is a ``min_by``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .reshape import explode_grid


def grid(low: float, high: float, steps: int) -> list[float]:
    return [low + (high - low) * i / steps for i in range(steps + 1)]


def linear_fit(df: DataFrame, keys: list[str], y: str | Column, x: str | Column) -> DataFrame:
    """Slope, intercept, R² and squared error of y on x per group."""
    xs = F.col(x) if isinstance(x, str) else x
    ys = F.col(y) if isinstance(y, str) else y
    points = df.select(*keys, xs.cast("double").alias("_x"), ys.cast("double").alias("_y"))
    return points.groupBy(*keys).agg(
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_r2("_y", "_x").alias("r2"),
        (F.regr_syy("_y", "_x") * (1 - F.regr_r2("_y", "_x"))).alias("sse"),
        F.regr_count("_y", "_x").alias("n"),
    )


def power_law(df: DataFrame, keys: list[str], size: str, value: str, low: float = -1.0, high: float = 1.0, steps: int = 40, refine: int = 2) -> DataFrame:
    """value = A + B·size^c per group: best exponent on a grid, refined around each group's best."""
    step = (high - low) / steps
    points = df.select(*keys, F.col(size).cast("double").alias("_n"), F.col(value).cast("double").alias("_v")).where("_n > 0 AND _v IS NOT NULL")
    nodes = explode_grid(points, [c for c in grid(low, high, steps) if abs(c) > 1e-12], "c")
    best = _best(linear_fit(nodes, [*keys, "c"], "_v", F.pow("_n", "c")), keys)
    for _ in range(refine):
        offsets = [o for o in grid(-step, step, 20)]
        near = points.join(best.select(*keys, F.col("c").alias("_c0")), keys)
        near = explode_grid(near, offsets, "_o").withColumn("c", F.col("_c0") + F.col("_o")).where("abs(c) > 1e-12")
        best = _best(linear_fit(near, [*keys, "c"], "_v", F.pow("_n", "c")), keys)
        step = step / 10
    return best.select(*keys, F.col("intercept").alias("a"), F.col("slope").alias("b"), "c", "r2", ratio("sse", "n").alias("mse"), "n")


def _best(fits: DataFrame, keys: list[str]) -> DataFrame:
    rest = ["c", "slope", "intercept", "r2", "sse", "n"]
    ok = fits.where(F.col("sse").isNotNull() & ~F.isnan("sse"))
    best = ok.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col("sse"), F.abs("c"), F.col("c"))).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def mean_level(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("k")).orderBy("k", *keys)


def variance_law(df: DataFrame, keys: list[str], size: str, sigma: str) -> DataFrame:
    """σ² = A/N + B per group by regression on 1/N."""
    fit = linear_fit(df, keys, F.pow(F.col(sigma), F.lit(2)), ratio(F.lit(1.0), F.col(size)))
    return fit.select(*keys, F.col("slope").alias("a"), F.col("intercept").alias("b"), "r2", "n")


def noise_law(df: DataFrame, keys: list[str], size: str, gamma: str, pi: str, steps: int = 60, omega: tuple[float, float] = (-2.0, 1.0), a2_limit: float = 100.0) -> DataFrame:
    """γ = A1/N + A2·N^ω with A1 in [π_r, 5π_r], π_r = 1/(π(1-π)), A2 in ±limit, ω on a grid.

    For each ω the two coefficients solve a 2x2 system of sums. The optimum of a convex
    quadratic on a box lies inside or on an edge, so the free solution is used when it is
    feasible and otherwise the best of the four edge solutions.
    """
    points = df.select(*keys, F.col(size).cast("double").alias("_n"), F.col(gamma).cast("double").alias("_y"), F.col(pi).cast("double").alias("_pi"))
    points = points.where("_n > 0 AND _y IS NOT NULL")
    u, w = 1 / F.col("_n"), F.pow("_n", "omega")
    sums = explode_grid(points, grid(*omega, steps), "omega").groupBy(*keys, "omega").agg(
        F.sum(u * u).alias("uu"), F.sum(u * w).alias("uw"), F.sum(w * w).alias("ww"), F.sum(u * F.col("_y")).alias("uy"),
        F.sum(w * F.col("_y")).alias("wy"), F.sum(F.col("_y") * F.col("_y")).alias("yy"), F.avg("_pi").alias("_p"), F.count(F.lit(1)).alias("n"),
    )
    pir = F.try_divide(F.lit(1.0), F.col("_p") * (1 - F.col("_p")))
    sums = sums.withColumns({"_lo": pir, "_hi": 5 * pir})
    uu, uw, ww, uy, wy, yy = (F.col(c) for c in ("uu", "uw", "ww", "uy", "wy", "yy"))

    def inside1(a: Column) -> Column:
        return F.greatest(F.col("_lo"), F.least(F.col("_hi"), a))

    def inside2(a: Column) -> Column:
        return F.greatest(F.lit(-a2_limit), F.least(F.lit(a2_limit), a))

    def option(a1: Column, a2: Column) -> Column:
        sse = yy - 2 * a1 * uy - 2 * a2 * wy + a1 * a1 * uu + 2 * a1 * a2 * uw + a2 * a2 * ww
        return F.struct(sse.alias("sse"), a1.alias("a1"), a2.alias("a2"))

    det = uu * ww - uw * uw
    free1, free2 = F.try_divide(uy * ww - wy * uw, det), F.try_divide(wy * uu - uy * uw, det)
    edges = [option(F.col(e), inside2(F.try_divide(wy - F.col(e) * uw, ww))) for e in ("_lo", "_hi")]
    edges += [option(inside1(F.try_divide(uy - F.lit(e) * uw, uu)), F.lit(e)) for e in (-a2_limit, a2_limit)]
    feasible = free1.between(F.col("_lo"), F.col("_hi")) & F.abs(free2).between(0.0, a2_limit)
    solved = sums.withColumn("_s", F.when(feasible, option(free1, free2)).otherwise(F.array_min(F.array(*edges))))
    best = solved.groupBy(*keys).agg(
        F.min_by(F.struct("omega", "_s.a1", "_s.a2", "_s.sse", "_p", "n"), F.struct(F.col("_s.sse"), F.col("omega"))).alias("_b")
    )
    b = {c: F.col(f"_b.{c}") for c in ("a1", "a2", "omega", "sse", "_p", "n")}
    return best.select(*keys, b["a1"].alias("a1"), b["a2"].alias("a2"), b["omega"].alias("omega"), (b["a1"] * b["_p"] * (1 - b["_p"])).alias("h"), b["sse"].alias("sse"), b["n"].alias("n"))


def scaling_residual(df: DataFrame, sigma: str, size: str, p: str, h: float, a: float, b: float, omega: float) -> DataFrame:
    """(σ² - h/(N·p(1-p)) - b)/a against (p(1-p)N)^ω."""
    q = F.col(p) * (1 - F.col(p))
    residual = (F.pow(F.col(sigma), F.lit(2)) - ratio(F.lit(h), F.col(size) * q) - F.lit(b)) / F.lit(a)
    return df.withColumns({"residual": residual, "scale": F.pow(q * F.col(size), F.lit(omega))})


def log_law(df: DataFrame, keys: list[str], distance: str, corr: str, low: float, high: float, t_value: float = 1.96) -> DataFrame:
    """C = intercept - λ² ln r between two distances: λ, L = exp(intercept/λ²), R², errors, interval; σ is the first bin."""
    inside = F.col(distance).between(low, high) & F.col(corr).isNotNull()
    x, y = F.when(inside, F.ln(distance)), F.when(inside, F.col(corr))
    fit = df.select(*keys, F.col(distance).alias("_d"), F.col(corr).alias("_c"), x.alias("_x"), y.alias("_y")).groupBy(*keys).agg(
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_r2("_y", "_x").alias("r2"),
        F.regr_sxx("_y", "_x").alias("sxx"),
        F.regr_syy("_y", "_x").alias("syy"),
        F.regr_avgx("_y", "_x").alias("mx"),
        F.regr_count("_y", "_x").alias("n"),
        F.min_by("_c", "_d").alias("sigma"),
    )
    s2 = F.try_divide(F.col("syy") * (1 - F.col("r2")), (F.col("n") - 2).cast("double"))
    se_slope = F.sqrt(F.try_divide(s2, F.col("sxx")))
    se_int = F.sqrt(s2 * (1 / F.col("n") + F.try_divide(F.col("mx") * F.col("mx"), F.col("sxx"))))
    lam2 = -F.col("slope")
    return fit.select(
        *keys,
        F.when(lam2 > 0, F.sqrt(lam2)).alias("lambda"),
        F.when(lam2 > 0, F.exp(F.col("intercept") / lam2)).alias("range_km"),
        "slope",
        "intercept",
        "r2",
        se_slope.alias("slope_error"),
        se_int.alias("intercept_error"),
        (F.col("slope") - t_value * se_slope).alias("slope_low"),
        (F.col("slope") + t_value * se_slope).alias("slope_high"),
        "sigma",
        "n",
    )
