"""Regression metrics, rank correlations and comparison tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..session import cut_lineage
from .ladder import attach, avg_rank, quantiles, value_ladder


def basic_metrics(df: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    """mse, rmse and mae in one aggregation."""
    e = F.col(p) - F.col(y)
    out = df.groupBy(*by).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))
    return out.withColumn("rmse", F.sqrt("mse"))


def regression_metrics(df: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    """Basic metrics plus mape, median error, explained variance, largest error and R²."""
    by = list(by)
    rows = df.select(*by, F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p"))
    rows = rows.where("_y IS NOT NULL AND _p IS NOT NULL").withColumn("_e", F.col("_y") - F.col("_p")).withColumn("_a", F.abs("_e"))
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("_e") * F.col("_e")).alias("mse"),
        F.avg("_a").alias("mae"),
        F.avg(ratio("_a", F.abs("_y"))).alias("mape"),
        F.max("_a").alias("max_error"),
        F.var_pop("_e").alias("_ve"),
        F.var_pop("_y").alias("_vy"),
    )
    out = attach(sums, quantiles(rows, by, "_a", {"median_ae": 0.5}), by)
    return out.select(
        *by, "n", "mse", F.sqrt("mse").alias("rmse"), "mae", "mape", "median_ae", "max_error",
        (1 - ratio("_ve", "_vy")).alias("explained_variance"), (1 - ratio("mse", "_vy")).alias("r2"),
    )


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of average-tie ranks."""
    ranked = avg_rank(avg_rank(df.select(x, y).na.drop("any"), [], x, "_rx"), [], y, "_ry")
    return ranked.agg(F.corr("_rx", "_ry").alias("spearman"))


def _signed_pairs(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Σ w·w'·sign(x'-x)·sign(y'-y) over unordered pairs, by splitting on x."""
    if len(x) < 2:
        return 0.0
    if len(x) <= 128:
        s = np.sign(x[None, :] - x[:, None]) * np.sign(y[None, :] - y[:, None])
        return float(w @ s @ w) / 2
    order = np.argsort(x, kind="stable")
    x, y, w = x[order], y[order], w[order]
    cut = np.searchsorted(x, x[len(x) // 2], "left")
    if cut == 0:
        cut = np.searchsorted(x, x[0], "right")
    if cut == len(x):
        return 0.0
    ly = np.argsort(y[:cut], kind="stable")
    left, mass = y[:cut][ly], np.concatenate([[0.0], np.cumsum(w[:cut][ly])])
    below, upto = mass[np.searchsorted(left, y[cut:], "left")], mass[np.searchsorted(left, y[cut:], "right")]
    across = float(np.sum(w[cut:] * (below - (mass[-1] - upto))))
    return across + _signed_pairs(x[:cut], y[:cut], w[:cut]) + _signed_pairs(x[cut:], y[cut:], w[cut:])


def _block_sum(pdf: pd.DataFrame) -> pd.DataFrame:
    s = _signed_pairs(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy(dtype="float64"))
    return pd.DataFrame({"s": [s * float(pdf["sign"].iloc[0])]})


def _grid_pairs(cells: DataFrame) -> DataFrame:
    """(s): signed pairs of cells that differ in both parts, from running sums along either axis.

    The cells are filled up to all pairs of parts that occur. A window along one x part, and then one along one y part,
    sees as many rows as there are parts, so no task sees the grid.
    """
    grid = cells.groupBy("bx", "by").agg(F.sum("w").cast("double").alias("w"))
    columns = grid.agg(F.sort_array(F.collect_set("by")).alias("by")).scalar()
    full = grid.select("bx").distinct().withColumn("_all", columns).select("bx", F.explode("_all").alias("by"))
    row, upto = Window.partitionBy("bx"), Window.partitionBy("bx").orderBy("by").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("by").orderBy("bx").rowsBetween(Window.unboundedPreceding, -1)
    filled = full.join(grid, ["bx", "by"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    # of one x part: what lies below a y part less what lies above it
    balance = filled.select("bx", "by", "w", (2 * F.sum("w").over(upto) - F.col("w") - F.sum("w").over(row)).alias("_lean"))
    met = balance.withColumn("_d", F.sum("_lean").over(earlier)).where("w > 0 AND _d IS NOT NULL")
    return met.agg(F.coalesce(F.sum(F.col("w") * F.col("_d")), F.lit(0.0)).alias("s"))


#: Rows of one part of an order, at most on average, and the fewest parts.
PART_ROWS, LEAST_PARTS = 50_000, 64


def kendall(df: DataFrame, x: str, y: str, blocks: int | None = None) -> DataFrame:
    """Exact Kendall tau-b without comparing all pairs.

    Rows are cut into ``blocks`` equal parts of the x order and of the y order, as many as
    the rows ask for, while the cells of the grid of parts stay fewer than the rows. Pairs in
    different parts of both follow from running sums over that grid. Pairs inside one
    x part, or one y part, are counted there by divide and conquer, and those inside the
    same cell, counted twice, are subtracted. A single value that fills a part of its own
    adds no pair inside that part, so a hot value never forms a large block.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop("any")
    counted = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    if not blocks:
        n = rows.count()
        blocks = max(LEAST_PARTS, min(-(-n // PART_ROWS), math.isqrt(n) // 4))

    def placed(frame: DataFrame, c: str) -> DataFrame:
        rungs = value_ladder(rows, [], c)
        part = F.floor(F.col("below") * blocks / F.col("total"))
        alone = F.col("n") * blocks >= F.col("total")
        return frame.join(rungs.select(c, (2 * part + alone.cast("int")).alias(f"b{c}"), alone.alias(f"hot_{c}")), c)

    cells = placed(placed(counted, "x"), "y")
    cells = cut_lineage(cells)
    grid = _grid_pairs(cells)
    jobs = F.array(
        F.when(~F.col("hot_x"), F.struct(F.col("bx").alias("i"), F.lit(-1).cast("bigint").alias("j"), F.lit(1.0).alias("sign"))),
        F.when(~F.col("hot_y"), F.struct(F.lit(-1).cast("bigint").alias("i"), F.col("by").alias("j"), F.lit(1.0).alias("sign"))),
        F.when(~F.col("hot_x") & ~F.col("hot_y"), F.struct(F.col("bx").alias("i"), F.col("by").alias("j"), F.lit(-1.0).alias("sign"))),
    )
    work = cells.select("x", "y", "w", F.explode(F.filter(jobs, lambda j: j.isNotNull())).alias("_j")).select("x", "y", "w", "_j.*")
    inner = work.groupBy("i", "j").applyInPandas(_block_sum, "s double")
    total = grid.unionByName(inner).agg(F.sum("s").alias("s"))
    pairs = lambda n: n.cast("double") * (n - 1) / 2
    ties = [rows.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(pairs(F.col("n"))).alias(f"t{c}")) for c in ("x", "y")]
    out = total.withColumn("all", rows.agg(pairs(F.count(F.lit(1))).alias("a")).scalar())
    out = out.withColumns({"tx": ties[0].scalar(), "ty": ties[1].scalar()})
    return out.select(F.try_divide(F.col("s"), F.sqrt((F.col("all") - F.col("tx")) * (F.col("all") - F.col("ty")))).alias("kendall"))


def model_table(frames: dict[str, DataFrame], y: str, p: str) -> DataFrame:
    """MSE, MAE and R² per model, one aggregation over the tagged union."""
    union = None
    for name, f in frames.items():
        part = f.select(F.lit(name).alias("model"), F.col(y).alias("_y"), F.col(p).alias("_p"))
        union = part if union is None else union.unionByName(part)
    e = F.col("_y") - F.col("_p")
    out = union.groupBy("model").agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop("_y").alias("_v"))
    return out.select("model", "mse", "mae", (1 - ratio("mse", "_v")).alias("r2"))


