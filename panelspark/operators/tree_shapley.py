"""Exact Shapley values of tree models, with the trees' own counts as background.

What a tree gives when only some features are known follows both branches of a split on an
unknown feature, weighted by the training rows that took them. For one leaf this is a product over the features of
its path: 1 or 0 where a known feature fits the path, the share of rows that stayed on the path where it is
unknown. The Shapley value of such a product game is an integral of a polynomial of lower degree than the path is
long, so a few Gauss points give it exactly. No subsets are listed and no rows are drawn.

The node table of the fitted model is read once; the leaves travel with the tasks, which take their rows batch by batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .models import as_doubles

#: Rows whose leaves are worked out at once.
ROWS = 2048


@dataclass(frozen=True)
class Leaf:
    """What a leaf adds, and for each feature of its path the interval (low, high] and the share of rows that stay."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def node_table(model: PipelineModel, spark) -> tuple[dict[int, dict[int, dict]], dict[int, float]]:
    """Nodes by tree and id, and the trees' weights, of a pipeline's last stage."""
    last = model.stages[-1]
    if not isinstance(last, (RandomForestRegressionModel, GBTRegressionModel)):
        raise TypeError(f"{type(last).__name__} is no regression by trees")
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    last.write().save(path)
    trees: dict[int, dict[int, dict]] = {}
    # trees times nodes: bounded by the model's size, which the driver has held already
    for tree, node in spark.read.parquet(f"{path}/data").select("treeID", "nodeData").collect():
        trees.setdefault(tree, {})[node["id"]] = node.asDict(recursive=True)
    weights = {r[0]: r[2] for r in spark.read.parquet(f"{path}/treesMetadata").collect()}
    if isinstance(last, RandomForestRegressionModel):
        weights = {t: w / sum(weights.values()) for t, w in weights.items()}
    return trees, weights


def leaves_of(nodes: dict[int, dict], weight: float) -> Iterator[Leaf]:
    """The leaves of one tree."""

    def walk(at: int, path: dict[int, tuple[float, float, float]]) -> Iterator[Leaf]:
        node = nodes[at]
        if node["leftChild"] < 0:
            names = sorted(path)
            yield Leaf(weight * node["prediction"], np.array(names, int), *(np.array([path[n][i] for n in names]) for i in range(3)))
            return
        feature = node["split"]["featureIndex"]
        if node["split"]["numCategories"] >= 0:
            raise TypeError("splits by category are not supported")
        threshold = node["split"]["leftCategoriesOrThreshold"][0]
        low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
        for child, a, b in ((node["leftChild"], low, min(high, threshold)), (node["rightChild"], max(low, threshold), high)):
            part = nodes[child]["impurityStats"][0] / node["impurityStats"][0]
            yield from walk(child, path | {feature: (a, b, share * part)})

    return walk(0, {})


def shapley_of(leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    """Values by row and feature of the rows of ``x``."""
    out = np.zeros_like(x)
    for leaf in leaves:
        d = len(leaf.features)
        if not d:
            continue
        own = x[:, leaf.features]
        fits = ((own > leaf.low) & (own <= leaf.high)).astype(float)
        points, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
        total = np.zeros_like(fits)
        for u, w in zip((points + 1) / 2, weights / 2):
            factors = leaf.share * (1 - u) + fits * u
            total += w * factors.prod(1, keepdims=True) / factors
        out[:, leaf.features] += leaf.value * (fits - leaf.share) * total
    return out


def tree_shapley(model: PipelineModel, df: DataFrame, key: str, features: list[str]) -> tuple[DataFrame, float]:
    """(key, feature, value) of every row, and the model's mean by its own counts: prediction = mean + sum of values."""
    trees, weights = node_table(model, df.sparkSession)
    leaves = [leaf for t, nodes in trees.items() for leaf in leaves_of(nodes, weights[t])]
    rows = PipelineModel(model.stages[:-1]).transform(as_doubles(df, features)).select(F.col(key).alias("key"), vector_to_array("features").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(features))
                values = shapley_of(leaves, x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, len(features), dtype=np.int32)), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("key"), lists], names=["key", "values"])

    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(run, f"key {kind}, values array<double>")
    cells = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("values").alias("value"))
    long = found.select(F.col("key").alias(key), F.explode(cells).alias("_c")).select(key, F.col("_c.feature").alias("feature"), F.col("_c.value").alias("value"))
    return long, float(sum(leaf.value * leaf.share.prod() for leaf in leaves))
