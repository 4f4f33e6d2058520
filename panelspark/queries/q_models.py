"""Model, explanation and whole-job queries. MLlib fits are checked by rows, linear ones also by SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import aggregates, explain, models, searches, splits, tree_shapley
from ..operators.reshape import pivot_values, unpivot_years
from ..operators.schema import BLOCS
from ..plans import backtest
from ..plans import panel as P
from ..session import cut_lineage, shared_folder
from ..sources import files
from .base import PANEL_SQL, panel, r, region_panel, share_sql, stable_sql, table
from .q_forecast import _PREV_SQL, history
from .q_schema import _LONG_SQL, yearly_wide
from .q_spatial import PLACES_SQL, places
from .q_windows import rank_sql
from .registry import query

_FEATURES = ["y_prev", "size", "period"]


def rows(spark, sf):
    return cut_lineage(history(spark, sf).where("y_prev IS NOT NULL").select("entity", "region", "kind", "period", "size", "y", "y_prev").withColumn("key", F.concat_ws("|", "entity", "period")))


def train_test(df):
    return df.where("period < 2000"), df.where("period >= 2000")


@query(
    "m9_linear_regression",
    f"WITH {_PREV_SQL}, f AS (SELECT regr_slope(y, y_prev) AS b, regr_intercept(y, y_prev) AS a FROM h WHERE y_prev IS NOT NULL AND period < 2000) SELECT entity, period, round(a + b * y_prev, 3) AS prediction FROM h, f WHERE y_prev IS NOT NULL AND period >= 2000",
)
def _(spark, sf):
    train, test = train_test(rows(spark, sf))
    model = models.fit("linear", train, ["y_prev"], "y", solver="normal")
    return models.predict(model, test, ["y_prev"]).select("entity", "period", r("prediction", 3).alias("prediction"))


@query("m9_elastic_net")
def _(spark, sf):
    train, test = train_test(rows(spark, sf))
    best, _ = models.cross_validate("linear", train, _FEATURES, "y", "key", models.grid_of(regParam=[0.001, 0.01, 0.1, 1.0], elasticNetParam=[0.0, 0.5, 1.0]), folds=3, scale=True)
    model = models.fit("linear", train, _FEATURES, "y", scale=True, **best)
    return models.predict(model, test, _FEATURES).select("entity", "period", "prediction")


@query("m10_gradient_boosting")
def _(spark, sf):
    train, test = train_test(rows(spark, sf))
    model = models.fit("boosting", train.where("period < 1999"), _FEATURES, "y", val=train.where("period = 1999"), maxIter=20, maxDepth=5)
    return models.predict(model, test, _FEATURES).select("entity", "period", "prediction")


@query("m11_random_forest")
def _(spark, sf):
    train, test = train_test(rows(spark, sf))
    model = models.fit("forest", train, _FEATURES, "y", numTrees=100, maxDepth=10)
    return models.predict(model, test, _FEATURES).select("entity", "period", "prediction")


@query("m11_forest_classifier_report")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double").alias("digits"), F.size(F.split("text", " ")).cast("double").alias("words"))
    labelled = cut_lineage(d.join(table(spark, sf, "labels"), "doc_id").withColumn("y", F.col("quality").cast("double")))
    parts = cut_lineage(splits.hashed_split(labelled, "doc_id"))
    names = ["n_chars", "digits", "words"]
    model = models.fit("forest_class", parts.where("part <> 'test'"), names, "y", numTrees=100, maxDepth=10)
    scored = cut_lineage(models.predict(model, parts.where("part = 'test'"), names).select("doc_id", "y", "prediction"))
    return aggregates.class_report(scored, "y", "prediction")


@query(
    "m11_confusion_and_report",
    "WITH x AS (SELECT quality AS y, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id)), c AS (SELECT unnest([0, 1]) AS class), k AS (SELECT class, CAST(count(*) FILTER (WHERE y = class AND p = class) AS DOUBLE) AS hit, CAST(count(*) FILTER (WHERE y = class) AS DOUBLE) AS support, CAST(count(*) FILTER (WHERE p = class) AS DOUBLE) AS given FROM x, c GROUP BY class) "
    "SELECT CAST(class AS BIGINT) AS class, round(coalesce(hit / nullif(given, 0), 0), 8) AS precision, round(coalesce(hit / nullif(support, 0), 0), 8) AS recall, round(coalesce(2 * hit / nullif(given + support, 0), 0), 8) AS f1, CAST(support AS BIGINT) AS support FROM k",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("p"))
    x = cut_lineage(d.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id"))
    out = aggregates.class_report(x, "y", "p")
    return out.select(F.col("class").cast("bigint").alias("class"), *[r(c, 8).alias(c) for c in ("precision", "recall", "f1")], F.col("support").cast("bigint").alias("support"))


#: Ten learning rates, evenly from 0.0001 to 1.
_RATES = [0.0001 + i * (1 - 0.0001) / 9 for i in range(10)]
_SPACE = {"maxDepth": [1, 2, 3, 4, 5], "minInstancesPerNode": [1, 4, 5, 6, 7], "subsamplingRate": [0.5, 0.6, 0.7], "maxIter": [5, 10, 20]}


@query("m12_two_stage_search")
def _(spark, sf):
    train, test = train_test(rows(spark, sf))
    best = searches.two_stage_search(train, _FEATURES, "y", "key", _RATES, _SPACE, trials=4, folds=3, parallel=8, first={"maxIter": 10, "maxDepth": 3})
    model = models.fit("boosting", train, _FEATURES, "y", **best)
    return models.predict(model, test, _FEATURES).select("entity", "period", "prediction")


def _fold_sql(folds: int, seed: int = 42) -> str:
    key = stable_sql("entity || '|' || period", seed)
    return f"t AS (SELECT y, y_prev, {key} % {folds} AS fold FROM h WHERE y_prev IS NOT NULL AND period < 2000), folds AS (SELECT unnest(range({folds})) AS f)"


@query(
    "m12_fold_scores",
    f"WITH {_PREV_SQL}, {_fold_sql(3)}, k AS (SELECT f, regr_slope(y, y_prev) AS b, regr_intercept(y, y_prev) AS a, sum(y * y_prev) / sum(y_prev * y_prev) AS o FROM t JOIN folds ON fold <> f GROUP BY f), "
    "e AS (SELECT f, count(*) AS n, avg(pow(y - a - b * y_prev, 2)) AS straight, avg(pow(y - o * y_prev, 2)) AS origin FROM t JOIN k ON fold = f GROUP BY f) "
    "SELECT CAST(f AS INT) AS fold, true AS intercept, CAST(n AS BIGINT) AS n, round(straight / 1e8, 3) AS mse FROM e UNION ALL SELECT CAST(f AS INT), false, CAST(n AS BIGINT), round(origin / 1e8, 3) FROM e",
)
def _(spark, sf):
    """The recorded errors of two linear maps, whose values are known, in each fold."""
    train, _ = train_test(rows(spark, sf))
    out = searches.fold_scores(train, ["y_prev"], "y", "key", models.grid_of(fitIntercept=[True, False], solver=["normal"]), folds=3, kind="linear")
    return out.select("fold", F.get_json_object("params", "$.fitIntercept").cast("boolean").alias("intercept"), "n", r(F.col("mse") / 1e8, 3).alias("mse"))


@query("m13_nested_ensemble")
def _(spark, sf):
    train, test = train_test(rows(spark, sf))
    fitted, _ = searches.nested_ensemble(train, _FEATURES, "y", "key", {"maxDepth": [2, 3, 4], "stepSize": [0.1, 0.3], "maxIter": [5, 10]}, outer=3, inner=3, trials=3, parallel=8)
    return models.predict_mean(fitted, test, _FEATURES).select("entity", "period", "prediction")


@query(
    "m13_nested_linear",
    f"WITH {_PREV_SQL}, {_fold_sql(3)}, k AS (SELECT f, regr_slope(y, y_prev) AS b, regr_intercept(y, y_prev) AS a FROM t JOIN folds ON fold <> f GROUP BY f), e AS (SELECT f, avg(pow(y - a - b * y_prev, 2)) AS mse FROM t JOIN k ON fold = f GROUP BY f), "
    "g AS (SELECT regr_slope(y, y_prev) AS b, regr_intercept(y, y_prev) AS a FROM t) "
    "SELECT CAST(f AS INT) AS fold, round(mse / 1e8, 3) AS mse, round(b, 6) AS slope, round(a, 3) AS intercept FROM e, g",
)
def _(spark, sf):
    """Outer errors and refitted lines of an ensemble of linear models, whose values are known."""
    train, _ = train_test(rows(spark, sf))
    fitted, errors = searches.nested_ensemble(train, ["y_prev"], "y", "key", {"solver": ["normal"]}, outer=3, inner=2, trials=1, kind="linear")
    lines = [models.coefficients(m, ["y_prev"]) for m in fitted]
    found = spark.createDataFrame([(o, e, c["y_prev"], c["intercept"]) for o, (e, c) in enumerate(zip(errors, lines))], "fold int, mse double, slope double, intercept double")
    return found.select("fold", r(F.col("mse") / 1e8, 3).alias("mse"), r("slope", 6).alias("slope"), r("intercept", 3).alias("intercept"))


_OLS = "regr_slope(y, y_prev) AS b{0}, regr_intercept(y, y_prev) AS a{0}"


@query(
    "m15_multi_event_ensemble",
    f"WITH {_PREV_SQL}, f AS (SELECT {_OLS.format(1)} FROM h WHERE y_prev IS NOT NULL AND period = 1999), g AS (SELECT {_OLS.format(2)} FROM h WHERE y_prev IS NOT NULL AND period = 1998) SELECT entity, period, round(0.7 * (a1 + b1 * y_prev) + 0.3 * (a2 + b2 * y_prev), 3) AS prediction FROM h, f, g WHERE y_prev IS NOT NULL AND period >= 2000",
)
def _(spark, sf):
    df = rows(spark, sf)
    fitted = models.multi_event_ensemble([df.where("period = 1999"), df.where("period = 1998")], ["y_prev"], "y", "linear", solver="normal")
    out = models.predict_mean(fitted, df.where("period >= 2000"), ["y_prev"], [0.7, 0.3])
    return out.select("entity", "period", r("prediction", 3).alias("prediction"))


@query(
    "m16_poll_stacking",
    f"WITH {_PREV_SQL}, x AS (SELECT entity, period, y, y_prev AS u, size AS v FROM h WHERE y_prev IS NOT NULL), m AS (SELECT avg(y) AS my, avg(u) AS mu, avg(v) AS mv, covar_pop(u, u) AS uu, covar_pop(v, v) AS vv, covar_pop(u, v) AS uv, covar_pop(u, y) AS uy, covar_pop(v, y) AS vy FROM x), "
    "k AS (SELECT *, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS a, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS b FROM m) SELECT entity, period, round(my + a * (u - mu) + b * (v - mv), 2) AS prediction FROM x, k",
)
def _(spark, sf):
    df = rows(spark, sf).withColumn("poll", F.col("size") * 100)
    model = models.stack_with_poll(df, "y", "y_prev", "poll")
    out = models.predict(model, df.withColumn("_poll", F.col("poll") / 100), ["y_prev", "_poll"])
    return out.select("entity", "period", r("prediction", 2).alias("prediction"))


@query("m17_feature_selection")
def _(spark, sf):
    train, _ = train_test(rows(spark, sf))
    scores = models.importances(models.fit("forest", train, _FEATURES, "y", numTrees=10, maxDepth=4), _FEATURES, train)
    kept = models.cumulative_features(scores, 0.999)
    left = models.recursive_elimination(train, _FEATURES, "y", 2, numTrees=5, maxDepth=3)
    return scores.withColumns({"cumulative": F.col("feature").isin(kept), "recursive": F.col("feature").isin(left), "top": F.col("feature").isin(models.top_features(scores, 2))})


@query(
    "s16_model_save_load",
    f"WITH {_PREV_SQL}, f AS (SELECT regr_slope(y, y_prev) AS b, regr_intercept(y, y_prev) AS a FROM h WHERE y_prev IS NOT NULL AND period < 2000) SELECT entity, period, round(a + b * y_prev, 3) AS prediction FROM h, f WHERE y_prev IS NOT NULL AND period >= 2000",
)
def _(spark, sf):
    train, test = train_test(rows(spark, sf))
    path = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    files.save_models(spark, {"y": (models.fit("linear", train, ["y_prev"], "y", solver="normal"), ["y_prev"])}, path, sf, train)
    model, names = files.load_models(spark, path)["y"]
    return models.predict(model, test, names).select("entity", "period", r("prediction", 3).alias("prediction"))


# ---- explanation ----


def linear_model(spark, sf):
    df = rows(spark, sf)
    return df, models.fit("linear", df, ["y_prev"], "y", solver="normal")


_FIT_SQL = f"WITH {_PREV_SQL}, x AS (SELECT entity, period, y, y_prev FROM h WHERE y_prev IS NOT NULL), f AS (SELECT regr_slope(y, y_prev) AS b, regr_intercept(y, y_prev) AS a, avg(y_prev) AS m FROM x)"


def _mixed_sql(x: str) -> str:
    spread = f"(({x}) % {explain._PRIME} * {explain._SPREAD} % {explain._PRIME})"
    return f"({spread} * {spread} % {explain._PRIME})"


# the keys of ``explain.shuffle_keys`` and the permutation of ``explain.shuffled``
_KEYS_SQL = f"keys AS MATERIALIZED (SELECT job, list_transform(range(1, {explain.ROUNDS + 1}), lambda i: {_mixed_sql(_mixed_sql(f'job * {explain.ROUNDS} + i') + ' + i')}) AS ks FROM (SELECT unnest(range(20)) AS job))"
_MIRROR_SQL = f"(((k * (n // {explain._PRIME} + 1) + k - p) % n + n) % n)"
_SHUFFLED_SQL = f"list_reduce(list_prepend(p0, ks), lambda p, k: CASE WHEN {_mixed_sql(f'greatest(p, {_MIRROR_SQL}) + k')} < {explain._PRIME // 2} THEN {_MIRROR_SQL} ELSE p END)"
_POS_SQL = f"pos AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {stable_sql('key')}, key) - 1 AS p0, count(*) OVER () AS n FROM (SELECT entity || '|' || period AS key, y, y_prev, size FROM h WHERE y_prev IS NOT NULL))"


@query(
    "x1_permutation_importance",
    f"WITH {_PREV_SQL}, {_POS_SQL}, {_KEYS_SQL}, m AS (SELECT avg(y) AS my, avg(y_prev) AS mu, avg(size) AS mv, covar_pop(y_prev, y_prev) AS uu, covar_pop(size, size) AS vv, covar_pop(y_prev, size) AS uv, covar_pop(y_prev, y) AS uy, covar_pop(size, y) AS vy FROM pos), "
    "k AS (SELECT *, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS a, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS b FROM m), base AS (SELECT avg(pow(y - my - a * (y_prev - mu) - b * (size - mv), 2)) AS mse FROM pos, k), "
    f"sent AS (SELECT job, {_SHUFFLED_SQL} AS p, CASE WHEN job < 10 THEN y_prev ELSE size END AS v FROM pos, keys), "
    "e AS (SELECT job, avg(pow(y - my - a * (CASE WHEN job < 10 THEN v ELSE y_prev END - mu) - b * (CASE WHEN job < 10 THEN size ELSE v END - mv), 2)) AS mse FROM sent JOIN pos ON p = p0, k GROUP BY job) "
    "SELECT CASE WHEN job < 10 THEN 'y_prev' ELSE 'size' END AS feature, round(avg(e.mse - base.mse) / 1e8, 3) AS score, round(stddev_pop(e.mse - base.mse) / 1e8, 3) AS deviation FROM e, base GROUP BY 1",
)
def _(spark, sf):
    df = rows(spark, sf)
    model = models.fit("linear", df, ["y_prev", "size"], "y", solver="normal")
    out = explain.permutation_importance(lambda d: models.predict(model, d, ["y_prev", "size"]), df, "key", ["y_prev", "size"], "y", repeats=10)
    return out.select("feature", r(F.col("score") / 1e8, 3).alias("score"), r(F.col("deviation") / 1e8, 3).alias("deviation"))


@query(
    "x1_permuted_column",
    f"WITH {_PREV_SQL}, {_POS_SQL}, {_KEYS_SQL}, sent AS (SELECT {_SHUFFLED_SQL} AS p, y_prev AS mixed FROM pos, keys WHERE job = 3) SELECT key, round(mixed, 2) AS y_prev FROM pos JOIN sent ON p = p0",
)
def _(spark, sf):
    mixed = explain.permute(rows(spark, sf), "key", "y_prev", 42, job=3)
    return mixed.select("key", r("y_prev", 2).alias("y_prev"))


@query("x2_linear_shapley", f"{_FIT_SQL} SELECT entity || '|' || period AS key, 'y_prev' AS feature, round(b * (y_prev - m), 3) AS value FROM x, f")
def _(spark, sf):
    df, model = linear_model(spark, sf)
    weights = models.coefficients(model, ["y_prev"])
    return explain.linear_shapley(df, "key", weights).withColumn("value", r("value", 3))


@query(
    "x2_sampled_shapley",
    f"WITH {_PREV_SQL}, x AS (SELECT entity || '|' || period AS key, y, y_prev, size FROM h WHERE y_prev IS NOT NULL), m AS (SELECT covar_pop(y_prev, y_prev) AS uu, covar_pop(size, size) AS vv, covar_pop(y_prev, size) AS uv, covar_pop(y_prev, y) AS uy, covar_pop(size, y) AS vy FROM x), "
    f"k AS (SELECT (uy * vv - vy * uv) / (uu * vv - uv * uv) AS a, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS b FROM m), refs AS (SELECT avg(y_prev) AS ru, avg(size) AS rv FROM (SELECT * FROM x ORDER BY {stable_sql('key')}, key LIMIT 8)) "
    "SELECT 'y_prev' AS feature, round(avg(abs(a * (y_prev - ru))), 2) AS importance FROM x, k, refs UNION ALL SELECT 'size', round(avg(abs(b * (size - rv))), 2) FROM x, k, refs",
)
def _(spark, sf):
    """Eight references and four orders with their reverses; of a linear model the values are known."""
    df = rows(spark, sf)
    model = models.fit("linear", df, ["y_prev", "size"], "y", solver="normal")
    values = explain.sampled_shapley(lambda d: models.predict(model, d, ["y_prev", "size"]), df, "key", ["y_prev", "size"])
    return explain.shapley_importance([values], softmax=False).withColumn("importance", r("importance", 2))


@query("x2_tree_shapley", f"WITH {_PREV_SQL} SELECT CAST(count(*) AS BIGINT) AS n, 0.0 AS gap FROM h WHERE y_prev IS NOT NULL")
def _(spark, sf):
    """Values of every row add up to its prediction less the mean: the largest relative gap over the whole table."""
    df = rows(spark, sf)
    model = models.fit("forest", df, _FEATURES, "y", numTrees=20, maxDepth=6)
    values, mean = tree_shapley.tree_shapley(model, df, "key", _FEATURES)
    sums = values.groupBy("key").agg(F.sum("value").alias("s"))
    both = models.predict(model, df, _FEATURES).select("key", "prediction").join(sums, "key")
    gap = F.max(F.abs(F.col("s") + mean - F.col("prediction")) / F.greatest(F.abs("prediction"), F.lit(1.0)))
    return both.agg(F.count(F.lit(1)).alias("n"), r(gap, 8).alias("gap"))


#: Fifty points of the feature's axis.
_GRID = [10_000.0 * i for i in range(1, 51)]


@query("x3_partial_dependence", f"{_FIT_SQL} SELECT CAST(g AS DOUBLE) AS at, round(a + b * g, 3) AS mean FROM f, (SELECT unnest(range(10000, 510000, 10000)) AS g)")
def _(spark, sf):
    df, model = linear_model(spark, sf)
    out = explain.partial_dependence(lambda d: models.predict(model, d, ["y_prev"]), df, "key", "y_prev", _GRID)
    return out.select("at", r("mean", 3).alias("mean"))


@query("x3_ice_curves", f"{_FIT_SQL} SELECT entity || '|' || period AS key, CAST(g AS DOUBLE) AS at, round(b * (g - 10000), 3) AS curve FROM x, f, (SELECT unnest(range(10000, 510000, 10000)) AS g)")
def _(spark, sf):
    df, model = linear_model(spark, sf)
    out = explain.partial_dependence(lambda d: models.predict(model, d, ["y_prev"]), df, "key", "y_prev", _GRID, ice=True)
    return out.select("key", "at", r("curve", 3).alias("curve"))


@query("x4_local_effects")
def _(spark, sf):
    df = rows(spark, sf)
    model = models.fit("forest", df, ["y_prev", "size"], "y", numTrees=5, maxDepth=3)
    return explain.local_effects(lambda d: models.predict(model, d, ["y_prev", "size"]), df, "key", "y_prev", 50)


@query("s17_explanation_sink", f"{_FIT_SQL} SELECT 'y_prev' AS feature, round(avg(abs(b * (y_prev - m))), 2) AS importance FROM x, f GROUP BY 1")
def _(spark, sf):
    df, model = linear_model(spark, sf)
    values = explain.linear_shapley(df, "key", models.coefficients(model, ["y_prev"]))
    path = files.write_parquet(values, shared_folder(spark), f"shap-{uuid.uuid4().hex}")
    return explain.shapley_importance([spark.read.parquet(path)]).withColumn("importance", r("importance", 2))


# ---- whole jobs ----


def region_events(spark, sf):
    """(region, kind, period) events with shares and their history."""
    p = region_panel(spark, sf).withColumn("entity", F.concat_ws("|", "region", "kind"))
    p = p.withColumns({f"vote_{g}": F.lit(None).cast("double") for g in ("tg", "td", "gcg", "dcd")})
    shares = ["pvote_par", *[f"pvote_{b}" for b in BLOCS]]
    return P.with_history(P.clean_events(p).select("entity", "region", "kind", "period", "size", "participants", "valid", *[f"vote_{b}" for b in BLOCS], *shares), shares)


@query(
    "v12_cleaned_events",
    f"WITH {PANEL_SQL}, c AS (SELECT entity, kind, period, {share_sql('participants', 'size')} AS pvote_par, {share_sql('CASE WHEN participants = 0 THEN 0 ELSE vote_g END', '(CASE WHEN participants = 0 THEN 0 ELSE vote_g + vote_cg + vote_c + vote_cd + vote_d END)')} AS pvote_g FROM panel) "
    f"SELECT entity, period, pvote_par, pvote_g, {rank_sql('kind, period', 'pvote_g', 4)} AS percentile_pvote_g, lag(pvote_g) OVER (PARTITION BY entity, kind ORDER BY period) AS previous_pvote_g, lag(pvote_g, 2) OVER (PARTITION BY entity, kind ORDER BY period) AS previousprevious_pvote_g FROM c",
)
def _(spark, sf):
    p = panel(spark, sf).withColumns({f"vote_{g}": F.lit(None).cast("double") for g in ("tg", "td", "gcg", "dcd")})
    clean = P.clean_events(p).select("entity", "kind", "period", "pvote_par", "pvote_g")
    out = P.with_history(clean, ["pvote_g"])
    return out.select("entity", "period", "pvote_par", "pvote_g", "percentile_pvote_g", "previous_pvote_g", "previousprevious_pvote_g")


_FILL_SQL = (
    f"{_LONG_SQL}, {PLACES_SQL}, e AS (SELECT p.entity, p.region, p.period, p.kind || p.period AS event, p.size, l.lat, l.long, round(w.raw * 100) AS a, o.raw * 100 AS b FROM panel p LEFT JOIN places l USING (entity) LEFT JOIN long w ON w.entity = p.entity AND w.period = p.period - 1 AND w.feature = 'accounts/amount' LEFT JOIN long o ON o.entity = p.entity AND o.period = p.period - 1 AND o.feature = 'accounts/orders'), "
    "k AS (SELECT event, avg(CASE WHEN a IS NULL THEN 1.0 ELSE 0.0 END) AS na, avg(CASE WHEN b IS NULL THEN 1.0 ELSE 0.0 END) AS nb, avg(a) AS ma, avg(b) AS mb FROM e GROUP BY event), m AS (SELECT event, region, avg(a) AS ra, avg(b) AS rb FROM e GROUP BY event, region)"
)


@query(
    "v12_assembled_panel",
    f"{_FILL_SQL} SELECT e.entity, e.event, e.size, round(lat, 6) AS lat, round(CASE WHEN na < 0.8 THEN coalesce(a, ra, ma) END, 5) AS amount, round(CASE WHEN nb < 0.8 THEN coalesce(b, rb, mb) END, 3) AS orders FROM e JOIN k ON e.event = k.event JOIN m ON m.event = e.event AND m.region = e.region",
)
def _(spark, sf):
    events = panel(spark, sf).select("entity", "region", "period", F.concat("kind", F.col("period").cast("string")).alias("event"), "size")
    long = unpivot_years(yearly_wide(spark, sf), "entity", "accounts").withColumns({"period": F.col("period") + 1, "raw": F.round(F.col("raw") * 100)})
    wide = pivot_values(long, ["entity", "period"], "feature", ["accounts/amount", "accounts/orders"], ["raw"])
    out = P.assemble(events, places(spark, sf).drop("region"), wide, ["entity", "event", "size"])
    return out.select("entity", "event", "size", r("lat").alias("lat"), r(F.col("`F_raw_accounts/amount`"), 5).alias("amount"), r(F.col("`F_raw_accounts/orders`"), 3).alias("orders"))


@query("v12_indicator_panel")
def _(spark, sf):
    ind = P.indicators({"accounts": yearly_wide(spark, sf)}, "entity")
    region = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").cast("bigint").alias("region"))
    wide = P.features_wide(ind.join(region, "entity"), None, ["accounts/amount", "accounts/orders"])
    return wide


@query(
    "v13_backfilled_panel",
    f"{_LONG_SQL}, h AS (SELECT DISTINCT feature, period AS source FROM long WHERE raw IS NOT NULL), d AS (SELECT DISTINCT kind, period FROM panel WHERE valid_amount IS NOT NULL), w AS (SELECT f.feature, t.period, max(h.source) AS source FROM (SELECT DISTINCT feature FROM h) f, (SELECT DISTINCT period FROM panel) t JOIN h ON h.feature = f.feature AND h.source <= t.period AND h.source >= t.period - 10 GROUP BY 1, 2), "
    "o AS (SELECT kind, period, lag(period) OVER (PARTITION BY kind ORDER BY period) AS prev FROM d), t AS (SELECT p.entity, p.kind, p.period, p.valid_amount, q.valid_amount AS previous_valid_amount FROM panel p JOIN o ON o.kind = p.kind AND o.period = p.period LEFT JOIN panel q ON q.entity = p.entity AND q.kind = p.kind AND q.period = o.prev AND q.valid_amount IS NOT NULL WHERE p.valid_amount IS NOT NULL) "
    "SELECT t.entity, t.period, t.valid_amount, t.previous_valid_amount, l.feature, w.source, l.raw FROM t JOIN w ON w.period = t.period JOIN long l ON l.entity = t.entity AND l.feature = w.feature AND l.period = w.source",
)
def _(spark, sf):
    long = cut_lineage(unpivot_years(yearly_wide(spark, sf), "entity", "accounts"))
    targets = cut_lineage(panel(spark, sf).select("entity", "kind", "period", "valid_amount"))
    out = P.legacy_panel(long, targets, "valid_amount")
    return out.select("entity", "period", "valid_amount", "previous_valid_amount", "feature", "source", "raw")


@query("m20_backtest_grid")
def _(spark, sf):
    grid = [{"model": "linear"}, {"model": "boosting", "maxIter": 3, "maxDepth": 2}]
    return backtest.backtest_grid(region_events(spark, sf), grid, ["size"], ["par", "g", "d"], [1998, 1999, 2000], "BUILDING", parallel=4)


@query("v12_backtest_report")
def _(spark, sf):
    events = cut_lineage(region_events(spark, sf))
    truth = events.where("period = 2000 AND kind = 'BUILDING'").select("entity", "size", "participants", "valid", *[f"vote_{b}" for b in BLOCS], "pvote_par", *[f"pvote_{b}" for b in BLOCS])
    _, report = backtest.backtest_report(events, truth, ["par", *BLOCS], BLOCS, ["size"], "linear", 2000, "BUILDING")
    return report

