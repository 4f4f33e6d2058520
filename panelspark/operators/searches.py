"""Parameter searches and nested ensembles whose fits are recorded jobs.

Every fit ends in a stored row with the error of its held-out fold. Up to ``parallel`` fits run
side by side, and a run that was stopped skips the fits it finds at ``record``. Rows are known
there by a fingerprint of the training table, so a changed table is fitted anew; to be found again
the training table must hold the same values in both runs, as a stored table does.

Boosting draws that differ in ``maxIter`` alone share one fit: the first n trees of a long run are
the run of n trees, so the losses after each tree give the errors of all of them.

Folds are hashes of the key. Rows with a null label take no part. A fold without rows has a null
error, which the mean over folds leaves out; equal means go to the map that was named first.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stable_bucket
from ..session import cut_lineage, shared_folder
from .metrics import basic_metrics
from .models import as_doubles, fit, predict, sample_params
from .recorded import recorded_jobs

SCORES = "scope string, path string, fold int, params string, n bigint, mse double"
_KEY = ["scope", "path", "fold"]

Jobs = dict[tuple, Callable[[], list[tuple]]]


def named(params: dict) -> str:
    return json.dumps(params, sort_keys=True)


def training_rows(train: DataFrame, features: list[str], label: str, key: str, folds: dict[str, tuple[int, int]]) -> DataFrame:
    """Features and label as stored doubles, with columns of folds: name -> (how many, seed)."""
    rows = as_doubles(train, [*features, label]).where(F.col(label).isNotNull())
    return cut_lineage(rows.select(*features, label, *[stable_bucket(key, k, seed).alias(name) for name, (k, seed) in folds.items()]))


def fingerprint(rows: DataFrame, *setting) -> str:
    """A name for the rows, whatever their order, and for a setting."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("h")).first()
    return hashlib.sha256(repr((total["n"], str(total["h"]), rows.columns, *setting)).encode()).hexdigest()[:16]


def paths(kind: str, grid: list[dict]) -> list[list[dict]]:
    """The maps of a grid, each once; boosting maps that differ in ``maxIter`` alone stand together, the longest last."""
    out: dict[str, dict[str, dict]] = {}
    for p in grid:
        staged = kind == "boosting" and "maxIter" in p
        shared = named({k: v for k, v in p.items() if k != "maxIter"} | {"staged": True} if staged else p)
        out.setdefault(shared, {})[named(p)] = p
    return [sorted(maps.values(), key=lambda p: p.get("maxIter", 0)) for maps in out.values()]


def path_errors(kind: str, train: DataFrame, held: DataFrame, features: list[str], label: str, maps: list[dict]) -> tuple[int, list[float | None]]:
    """(rows, errors): held-out mean squared error of each map of a path, all from one fit."""
    n = held.count()
    if not n:
        return 0, [None] * len(maps)
    model = fit(kind, train, features, label, **maps[-1])
    if len(maps) == 1:
        return n, [float(basic_metrics(predict(model, held, features), label, "prediction").first()["mse"])]
    ready = PipelineModel(model.stages[:-1]).transform(held)
    after = model.stages[-1].evaluateEachIteration(ready, "squared")
    return n, [float(after[p["maxIter"] - 1]) for p in maps]


def fold_jobs(kind: str, rows: DataFrame, features: list[str], label: str, grid: list[dict], scope: str, fold: str, folds: int) -> Jobs:
    """One job for each path of the grid and each fold."""

    def run(key: tuple, maps: list[dict]) -> list[tuple]:
        held = F.col(fold) == key[2]
        n, errors = path_errors(kind, rows.where(~held), rows.where(held), features, label, maps)
        return [(*key, named(p), n, e) for p, e in zip(maps, errors)]

    jobs: Jobs = {}
    for maps in paths(kind, grid):
        for f in range(folds):
            key = (scope, named({"maps": maps}), f)
            jobs[key] = partial(run, key, maps)
    return jobs


def _record(rows: DataFrame, record: str | None) -> str:
    return record or f"{shared_folder(rows.sparkSession)}/fits-{uuid.uuid4().hex}"


def best_maps(scored: DataFrame, grids: dict[str, list[dict]]) -> dict[str, tuple[dict, float]]:
    """scope -> the map of its grid with the least mean rmse over folds, and that mean."""
    means = {(r["scope"], r["params"]): r["rmse"] for r in scored.groupBy("scope", "params").agg(F.avg(F.sqrt("mse")).alias("rmse")).collect()}
    out = {}
    for scope, grid in grids.items():
        known = [(means[scope, named(p)], i) for i, p in enumerate(grid) if means.get((scope, named(p))) is not None]
        if not known:
            raise ValueError(f"no fold of {scope} holds rows")
        rmse, i = min(known)
        out[scope] = (grid[i], float(rmse))
    return out


def fold_scores(train: DataFrame, features: list[str], label: str, key: str, grid: list[dict], folds: int = 3, kind: str = "boosting", seed: int = 42, record: str | None = None, parallel: int = 4) -> DataFrame:
    """(scope, path, fold, params, n, mse): the held-out error of every map of the grid in every fold."""
    rows = training_rows(train, features, label, key, {"_fold": (folds, seed)})
    scope = fingerprint(rows, kind, folds)
    return recorded_jobs(rows.sparkSession, fold_jobs(kind, rows, features, label, grid, scope, "_fold", folds), _record(rows, record), SCORES, _KEY, parallel)


def two_stage_search(train: DataFrame, features: list[str], label: str, key: str, rates: list[float], space: dict[str, list], trials: int, folds: int = 3, kind: str = "boosting", seed: int = 42, record: str | None = None, parallel: int = 4, first: dict | None = None) -> dict:
    """First the learning rate, with the parameters ``first``, then random draws over the others at that rate."""
    rows = training_rows(train, features, label, key, {"_fold": (folds, seed)})
    mark, path = fingerprint(rows, kind, folds), _record(rows, record)

    def best(grid: list[dict]) -> dict:
        jobs = fold_jobs(kind, rows, features, label, grid, mark, "_fold", folds)
        return best_maps(recorded_jobs(rows.sparkSession, jobs, path, SCORES, _KEY, parallel), {mark: grid})[mark][0]

    rate = best([(first or {}) | {"stepSize": r} for r in rates])["stepSize"]
    return best([p | {"stepSize": rate} for p in sample_params(space, trials, seed)])


def nested_ensemble(train: DataFrame, features: list[str], label: str, key: str, space: dict[str, list], outer: int = 4, inner: int = 4, trials: int = 4, kind: str = "boosting", seed: int = 42, record: str | None = None, parallel: int = 4) -> tuple[list[PipelineModel], list[float | None]]:
    """Outer folds score the best inner parameters; one model per outer fold is refitted on all rows.

    Inner folds are hashes of the key with another seed. The inner fits of all outer folds run in one set of jobs;
    then each outer fold's job scores its best map, stores the refitted model, and records the score last.
    """
    rows = training_rows(train, features, label, key, {"_outer": (outer, seed), "_fold": (inner, seed + 1)})
    spark, path, mark = rows.sparkSession, _record(rows, record), fingerprint(rows, kind, outer, inner)
    grids = {f"{mark}-{o}": sample_params(space, trials, seed + o) for o in range(outer)}
    jobs: Jobs = {}
    for o, (scope, grid) in enumerate(grids.items()):
        jobs |= fold_jobs(kind, rows.where(F.col("_outer") != o), features, label, grid, scope, "_fold", inner)
    best = best_maps(recorded_jobs(spark, jobs, path, SCORES, _KEY, parallel), grids)

    def refit(key: tuple, params: dict, folder: str) -> list[tuple]:
        held = F.col("_outer") == key[2]
        n, errors = path_errors(kind, rows.where(~held), rows.where(held), features, label, [params])
        fit(kind, rows, features, label, **params).write().overwrite().save(folder)
        return [(*key, named(params), n, errors[0])]

    refits, folders = {}, []
    for o in range(outer):
        params = best[f"{mark}-{o}"][0]
        key = (f"{mark}-outer", named(params), o)
        folders.append(f"{path}-models/{mark}-{o}-{hashlib.sha256(named(params).encode()).hexdigest()[:16]}")
        refits[key] = partial(refit, key, params, folders[-1])
    scored = {r["fold"]: r["mse"] for r in recorded_jobs(spark, refits, path, SCORES, _KEY, parallel).collect()}
    return [PipelineModel.load(f) for f in folders], [scored[o] for o in range(outer)]
