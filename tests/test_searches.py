"""Recorded searches: against single fits, against MLlib's cross-validation, and stopped half-way."""

import pytest
from pyspark.sql import functions as F

from panelspark.operators import models, searches


@pytest.fixture(scope="module")
def train(spark):
    x = F.col("id").cast("double")
    return spark.range(240).select(
        F.col("id").alias("key"), (x % 17).alias("a"), F.when(F.col("id") % 11 != 0, x % 5).alias("b"), ((x % 17) * 3 + (x % 5) * (x % 3) + F.sin(x)).alias("y")
    )


def test_maps_that_differ_in_trees_share_a_fit():
    grid = [{"maxIter": 4, "maxDepth": 2}, {"maxDepth": 2, "maxIter": 2}, {"maxDepth": 3, "maxIter": 2}, {"maxDepth": 2}, {"maxIter": 4, "maxDepth": 2}]
    assert searches.paths("boosting", grid) == [[{"maxDepth": 2, "maxIter": 2}, {"maxIter": 4, "maxDepth": 2}], [{"maxDepth": 3, "maxIter": 2}], [{"maxDepth": 2}]]
    assert len(searches.paths("linear", [{"maxIter": 4}, {"maxIter": 5}])) == 2


def test_errors_along_a_path_are_those_of_single_fits(train):
    rows = searches.training_rows(train, ["a", "b"], "y", "key", {"_fold": (3, 42)})
    maps = [{"maxIter": n, "maxDepth": 2, "subsamplingRate": 0.7, "stepSize": 0.3} for n in (1, 2, 5)]
    part, held = rows.where("_fold <> 0"), rows.where("_fold = 0")
    n, together = searches.path_errors("boosting", part, held, ["a", "b"], "y", maps)
    alone = [searches.path_errors("boosting", part, held, ["a", "b"], "y", [m])[1][0] for m in maps]
    assert n == held.count() and together == pytest.approx(alone, rel=1e-9)


def test_scores_are_those_of_cross_validation(train):
    grid = models.grid_of(regParam=[0.0, 0.5, 5.0])
    best, rmse = models.cross_validate("linear", train, ["a", "b"], "y", "key", grid)
    scored = searches.fold_scores(train, ["a", "b"], "y", "key", grid, kind="linear")
    scope = scored.first()["scope"]
    assert scored.agg(F.sum("n")).first()[0] == 3 * 240
    assert searches.best_maps(scored, {scope: grid})[scope] == (best, pytest.approx(rmse, rel=1e-6))


def test_a_stopped_search_goes_on_and_other_rows_are_fitted_anew(train, tmp_path, monkeypatch):
    fits, real = [], searches.fit

    def counted(kind, rows, features, label, **params):
        fits.append(params)
        if len(fits) == 4:
            raise RuntimeError("lost")
        return real(kind, rows, features, label, **params)

    monkeypatch.setattr(searches, "fit", counted)
    ask = lambda rows: searches.two_stage_search(rows, ["a", "b"], "y", "key", [0.1, 0.5], {"maxDepth": [1, 2], "maxIter": [1, 2]}, trials=3, folds=2, record=f"{tmp_path}/fits", parallel=1, first={"maxIter": 2})
    with pytest.raises(RuntimeError):
        ask(train)
    assert len(fits) == 4
    best = ask(train)
    done = len(fits)
    # the rates need four fits, of which three were stored; draws share paths
    assert best["stepSize"] in (0.1, 0.5) and done <= 4 + 1 + 2 * 2
    assert ask(train) == best and len(fits) == done
    ask(train.withColumn("y", F.col("y") + F.col("a")))
    assert len(fits) > done


def test_a_nested_ensemble_is_read_back(train, tmp_path, monkeypatch):
    ask = lambda: searches.nested_ensemble(train, ["a", "b"], "y", "key", {"maxDepth": [1, 3], "maxIter": [2, 4]}, outer=2, inner=2, trials=2, record=f"{tmp_path}/fits")
    fitted, errors = ask()
    monkeypatch.setattr(searches, "fit", None)
    again, same = ask()
    assert errors == same and len(fitted) == 2 and all(e > 0 for e in errors)
    first, second = (models.predict_mean(m, train, ["a", "b"]).orderBy("key").select("prediction").collect() for m in (fitted, again))
    assert first == second


def test_empty_folds_and_empty_tables(train):
    grid = [{"regParam": 0.0}]
    one = train.where("key = 3")
    scored = searches.fold_scores(train.where("key < 3").unionByName(one), ["a"], "y", "key", grid, folds=8, kind="linear")
    rows = scored.collect()
    assert len(rows) == 8 and any(r["n"] == 0 for r in rows) and sum(r["n"] for r in rows) == 4 and all((r["mse"] is None) == (r["n"] == 0) for r in rows)
    empty = searches.fold_scores(train.where("key < 0"), ["a"], "y", "key", grid, folds=2, kind="linear")
    with pytest.raises(ValueError):
        searches.best_maps(empty, {empty.first()["scope"]: grid})
