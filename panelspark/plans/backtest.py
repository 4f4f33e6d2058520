"""Back-test: train on earlier events, predict the event, score and report."""

from __future__ import annotations

import json
import uuid
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import forecast, metrics
from ..operators.models import baseline_constant, baseline_previous, fit, predict, predict_trends
from ..operators.recorded import recorded_jobs
from ..operators.splits import temporal_split
from ..session import cut_lineage, shared_folder


def train_trends(df: DataFrame, trends: list[str], features: list[str], kind: str, year: int, wanted: str, reach: int = 15, **params) -> dict:
    """One model per trend on the events of the ``reach`` years before."""
    models = {}
    for t in trends:
        parts = temporal_split(df, "period", "kind", year, wanted, f"pvote_{t}", reach)
        use = [*features, f"previous_pvote_{t}"]
        models[t] = (fit(kind, parts["train"], use, f"pvote_{t}", **params), use)
    return models


def forecast_event(models: dict, rows: DataFrame, blocs: list[str]) -> DataFrame:
    """Predict every trend, normalise to one, turn into counts."""
    base = rows.drop(*[f"pvote_{t}" for t in models])
    scored = predict_trends(models, base)
    return forecast.shares_to_counts(forecast.normalise_shares(scored, blocs), blocs)


_SCORES = "model string, params string, trend string, year int, scored string, n bigint, mse double, rmse double, mae double"


def backtest_grid(df: DataFrame, grid: list[dict], features: list[str], trends: list[str], years: list[int], wanted: str, reach: int = 15, record: str | None = None, parallel: int = 1) -> DataFrame:
    """n, mse, rmse and mae of model, in-sample, previous and constant predictions per (model, trend, year).

    Each fit is a recorded job whose four score rows are stored when it ends, at ``record`` if it is
    named, where a later run finds them; the plan of the result does not grow with the grid.
    """
    rows = cut_lineage(df)
    jobs = {}
    for spec in grid:
        kind, params = spec["model"], {k: v for k, v in spec.items() if k != "model"}
        for trend in trends:
            for year in years:
                key = (kind, json.dumps(params, sort_keys=True), trend, year)
                jobs[key] = partial(_fit_scores, rows, key, kind, params, features, wanted, reach)
    path = record or f"{shared_folder(df.sparkSession)}/scores-{uuid.uuid4().hex}"
    return recorded_jobs(df.sparkSession, jobs, path, _SCORES, ["model", "params", "trend", "year"], parallel)


def _fit_scores(rows: DataFrame, key: tuple, kind: str, params: dict, features: list[str], wanted: str, reach: int) -> list[tuple]:
    _, _, trend, year = key
    y, prev = f"pvote_{trend}", f"previous_pvote_{trend}"
    use = [*features, prev]
    parts = temporal_split(rows, "period", "kind", year, wanted, y, reach)
    model = fit(kind, parts["train"], use, y, **params)
    scored = {
        "test": predict(model, parts["test"], use),
        "in_sample": predict(model, parts["train"], use),
        "previous": baseline_previous(parts["train"], parts["test"], y, prev),
        "constant": baseline_constant(parts["test"], 0.0),
    }
    out = None
    for name, s in scored.items():
        part = s.select(F.lit(name).alias("scored"), F.col(y).alias("_y"), F.col("prediction").cast("double").alias("_p"))
        out = part if out is None else out.unionByName(part)
    counted = out.groupBy("scored").agg(F.count(F.lit(1)).alias("n"))
    return [(*key, r["scored"], r["n"], r["mse"], r["rmse"], r["mae"]) for r in metrics.basic_metrics(out, "_y", "_p", ["scored"]).select("scored", "mse", "rmse", "mae").join(counted, "scored").collect()]


def backtest_report(df: DataFrame, truth: DataFrame, trends: list[str], blocs: list[str], features: list[str], kind: str, year: int, wanted: str, **params) -> tuple[DataFrame, DataFrame]:
    """(error table, synthetic report) of one back-tested event."""
    rows = cut_lineage(df)
    models = train_trends(rows, trends, features, kind, year, wanted, **params)
    pred = forecast_event(models, rows.where((F.col("period") == year) & (F.col("kind") == wanted)), blocs)
    cols = ["participants", "pvote_par", *[f"vote_{b}" for b in blocs], *[f"pvote_{b}" for b in blocs]]
    errors = cut_lineage(forecast.error_table(pred, truth, "entity", cols, check=True))
    return errors, forecast.synthetic_report(errors, blocs)
