"""Baselines, MLlib pipelines, searches, ensembles and feature selection.

Every fit and every prediction is a distributed MLlib job; the driver only holds model
objects and a small grid of parameters.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stable_bucket
from .ladder import attach
from .windows import keep_until_cumulative


# ---- baselines and weights ----


def baseline_previous(train: DataFrame, test: DataFrame, y: str, previous: str) -> DataFrame:
    """Predict the previous value, or the train mean where it is missing."""
    out = attach(test, train.agg(F.avg(y).alias("_mean")), [])
    return out.withColumn("prediction", F.coalesce(previous, "_mean")).drop("_mean")


def baseline_mean(train: DataFrame, test: DataFrame, y: str) -> DataFrame:
    return attach(test, train.agg(F.avg(y).alias("prediction")), [])


def baseline_constant(test: DataFrame, value: float = 0.0) -> DataFrame:
    return test.withColumn("prediction", F.lit(value))


def row_weights(df: DataFrame, size: str, scheme: str, out: str = "weight", y: str | None = None) -> DataFrame:
    """Weights divided by their mean: equal, proportional, squared, root, inverse (of size), inverse_y."""
    s = F.col(size).cast("double")
    raw: dict[str, Column] = {
        "equal": F.lit(1.0),
        "proportional": s,
        "squared": s * s,
        "root": F.sqrt(s),
        "inverse": F.try_divide(F.lit(1.0), s),
    }
    if y is not None:
        raw["inverse_y"] = F.try_divide(F.lit(1.0), F.col(y).cast("double"))
    weight = raw[scheme]
    mean = df.agg(F.avg(weight).alias("_w"))
    return attach(df, mean, []).withColumn(out, weight / F.col("_w")).drop("_w")


# ---- pipelines ----

ESTIMATORS: dict[str, Callable] = {
    "linear": lambda label, **kw: LinearRegression(labelCol=label, featuresCol="features", **kw),
    "boosting": lambda label, **kw: GBTRegressor(labelCol=label, featuresCol="features", **({"seed": 42, "maxIter": 20} | kw)),
    "forest": lambda label, **kw: RandomForestRegressor(labelCol=label, featuresCol="features", **({"seed": 42, "numTrees": 100} | kw)),
    "forest_class": lambda label, **kw: RandomForestClassifier(labelCol=label, featuresCol="features", **({"seed": 42, "numTrees": 100} | kw)),
    "boosting_class": lambda label, **kw: GBTClassifier(labelCol=label, featuresCol="features", **({"seed": 42, "maxIter": 20} | kw)),
}


def register_estimator(name: str, factory: Callable) -> None:
    """Extension point: ``factory(label, **params)`` returns an MLlib estimator reading ``features``."""
    ESTIMATORS[name] = factory


def pipeline(kind: str, features: list[str], label: str, scale: bool = False, **params) -> Pipeline:
    """Mean imputation, assembly, optional standardisation (fitted on train only), estimator."""
    filled = [f"_f{i}" for i in range(len(features))]
    stages = [Imputer(inputCols=features, outputCols=filled, strategy="mean"), VectorAssembler(inputCols=filled, outputCol="_raw" if scale else "features")]
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=[*stages, ESTIMATORS[kind](label, **params)])


def as_doubles(df: DataFrame, cols: list[str]) -> DataFrame:
    """Doubles with infinities turned into null, which the imputer then fills."""
    inf = float("inf")
    return df.withColumns({c: F.when(F.abs(F.col(c).cast("double")) != inf, F.col(c).cast("double")) for c in cols})


def fit(kind: str, train: DataFrame, features: list[str], label: str, val: DataFrame | None = None, **params) -> PipelineModel:
    """Fit a pipeline; boosting stops early on ``val`` when it is given."""
    rows = as_doubles(train, [*features, label]).where(F.col(label).isNotNull())
    if val is not None:
        held = as_doubles(val, [*features, label]).where(F.col(label).isNotNull())
        rows = rows.withColumn("_held", F.lit(False)).unionByName(held.withColumn("_held", F.lit(True)), allowMissingColumns=True)
        params["validationIndicatorCol"] = "_held"
    return pipeline(kind, features, label, **params).fit(rows)


_WORK = ("features", "_raw", "rawPrediction", "probability")


def predict(model: PipelineModel, df: DataFrame, features: list[str], out: str = "prediction") -> DataFrame:
    scored = model.transform(as_doubles(df, features))
    if out != "prediction":
        scored = scored.withColumnRenamed("prediction", out)
    return scored.drop(*[c for c in scored.columns if c in _WORK or c.startswith("_f")])


def predict_trends(models: dict[str, tuple[PipelineModel, list[str]]], df: DataFrame, prefix: str = "pvote_") -> DataFrame:
    """One prediction column per trend by chained transforms: no join between trends."""
    out = df
    for trend, (model, features) in models.items():
        out = predict(model, out, features, f"{prefix}{trend}")
    return out


def coefficients(model: PipelineModel, features: list[str]) -> dict[str, float]:
    last = model.stages[-1]
    return dict(zip(features, [float(v) for v in last.coefficients])) | {"intercept": float(last.intercept)}


def importances(model: PipelineModel, features: list[str], df: DataFrame) -> DataFrame:
    """(feature, score) of a tree model; the length is the number of features."""
    scores = model.stages[-1].featureImportances.toArray()
    return df.sparkSession.createDataFrame([(f, float(s)) for f, s in zip(features, scores)], "feature string, score double")


# ---- searches and ensembles ----


def _folds(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    return df.withColumn("_fold", stable_bucket(key, k, seed))


def cross_validate(kind: str, train: DataFrame, features: list[str], label: str, key: str, grid: list[dict], folds: int = 3, parallelism: int = 4, seed: int = 42, scale: bool = False) -> tuple[dict, float]:
    """Best parameter map by cross-validated rmse; the fold of a row is a hash of its key.

    The whole pipeline is fitted inside each fold, so a held-out fold moves neither means nor scales.
    """
    rows = _folds(as_doubles(train, [*features, label]).where(F.col(label).isNotNull()), key, folds, seed)
    ready = rows.select(*features, label, "_fold").cache()
    estimator = pipeline(kind, features, label, scale)
    last = estimator.getStages()[-1]
    maps = [{last.getParam(n): v for n, v in g.items()} for g in grid]
    cv = CrossValidator(
        estimator=estimator, estimatorParamMaps=maps, evaluator=RegressionEvaluator(labelCol=label, metricName="rmse"), numFolds=folds, foldCol="_fold", parallelism=parallelism
    )
    scores = cv.fit(ready).avgMetrics
    ready.unpersist()
    best = min(range(len(scores)), key=lambda i: scores[i])
    return grid[best], float(scores[best])


def grid_of(**values: list) -> list[dict]:
    """Every combination of the given parameter values."""
    return [dict(zip(values, combo)) for combo in product(*values.values())]


def sample_params(space: dict[str, list], trials: int, seed: int = 42) -> list[dict]:
    """Seeded random draws from a parameter space."""
    rng = random.Random(seed)
    return [{n: rng.choice(v) for n, v in space.items()} for _ in range(trials)]


def predict_mean(models: list[PipelineModel], df: DataFrame, features: list[str], weights: list[float] | None = None, out: str = "prediction") -> DataFrame:
    """Weighted mean (equal by default) of the models' predictions."""
    w = weights or [1.0 / len(models)] * len(models)
    scored = df
    for i, m in enumerate(models):
        scored = predict(m, scored, features, f"_p{i}")
    total = sum((F.lit(w[i]) * F.col(f"_p{i}") for i in range(len(models))), F.lit(0.0))
    return scored.withColumn(out, total).drop(*[f"_p{i}" for i in range(len(models))])


def multi_event_ensemble(subsets: list[DataFrame], features: list[str], label: str, kind: str = "boosting", **params) -> list[PipelineModel]:
    """One model per event; combine with ``predict_mean(weights=[0.7, 0.3])``."""
    return [fit(kind, s, features, label, **params) for s in subsets]


def stack_with_poll(df: DataFrame, label: str, prediction: str, poll: str) -> PipelineModel:
    """label ~ a·prediction + b·poll/100 + c."""
    rows = df.withColumn("_poll", F.col(poll) / 100)
    return fit("linear", rows, [prediction, "_poll"], label)


# ---- feature selection ----


def top_features(scores: DataFrame, n: int) -> list[str]:
    return [r["feature"] for r in scores.orderBy(F.col("score").desc(), "feature").limit(n).collect()]


def cumulative_features(scores: DataFrame, limit: float = 0.95) -> list[str]:
    """Features in descending normalised score while the running sum stays under the limit."""
    total = scores.agg(F.sum("score").alias("_t"))
    share = attach(scores, total, []).withColumn("score", F.try_divide(F.col("score"), F.col("_t")))
    kept = keep_until_cumulative(share, "score", "feature", limit)
    return [r["feature"] for r in kept.orderBy(F.col("score").desc(), "feature").collect()]


def recursive_elimination(train: DataFrame, features: list[str], label: str, keep: int, kind: str = "forest", drop: int = 1, **params) -> list[str]:
    """Refit and drop the least important features until ``keep`` remain."""
    left = list(features)
    while len(left) > keep:
        ranked = top_features(importances(fit(kind, train, left, label, **params), left, train), len(left))
        left = [f for f in left if f in ranked[: max(keep, len(left) - drop)]]
    return left
