"""Preparation, validation and learning on a table derived from orders and their lines.

Fits have no SQL twin; what surrounds them has, and so has a line through one feature.
"""

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from airgrid.constants import SIX_FOLD_CUTS
from airgrid.learning import models as M
from airgrid.learning import normal as N
from airgrid.learning import prepare as P
from airgrid.learning import scores as S
from airgrid.learning import validate as V
from airgrid.operators.aggregates import expand_predictions, station_days
from airgrid.operators.sets import top
from airgrid.operators.splits import named_split, random_split, six_folds, time_split
from airgrid.operators.windows import lag_rows
from airgrid.session import settle, shared_folder
from bindings.registry import d_text, query, r6, rounded
from bindings.splits import _sets
from bindings.windows import _DAILY

_NUMERIC = ["x1", "x2", "x3"]


def _folded(t):
    """Training table with the six time folds and a feature vector without gaps."""
    filled = settle(t.training.na.fill(0.0, ["x2"]))
    folded = time_split(filled, "date", six_folds, "foldNumber")
    return settle(VectorAssembler(inputCols=_NUMERIC, outputCol="features").transform(folded))


def _split(t):
    return settle(t.training.withColumn("Set", random_split(F.col("date"))))


def _parts(df):
    return [df.where(F.col("Set") == n) for n in ("train", "valid", "test")]


def _search_table(t, maps, found):
    rows = [(", ".join(f"{p.name}={v}" for p, v in m.items()), float(s), float(d))
            for m, s, d in zip(maps, found.scores, found.deviations)]
    return t.spark.createDataFrame(rows, "params string, score double, deviation double")


@query("ml_feature_vectors")
def _(t):
    train, valid, test = _parts(_split(t))
    _, frames = P.fit_features(train, [valid, test], P.feature_pipeline(_NUMERIC, ["priority"], impute=True))
    out = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return out.select("label_id", "Set", F.array_join(F.transform(vector_to_array("features"), lambda v: F.round(v, 6)), " ").alias("features"))


@query("ml_quantile_buckets")
def _(t):
    train = t.training
    model = P.feature_pipeline(_NUMERIC, buckets=10, scale=False).fit(train)
    return model.transform(train).select("label_id", *[c + "_bucket" for c in _NUMERIC])


@query("ml_impute_means", f"""
       SELECT label_id, coalesce(x2, (SELECT avg(x2) FROM {{training}} WHERE {_sets('CAST(date AS VARCHAR)')} = 'train')) AS x2,
              coalesce(CASE WHEN label_id % 7 > 0 THEN priority END, 'VV_likely') AS priority FROM {{training}}""")
def _(t):
    gaps = _split(t).withColumn("priority", F.when(F.col("label_id") % 7 > 0, F.col("priority")))
    parts = P.impute_means(*(lambda a, b, c: (a, [b, c]))(*_parts(gaps)), ["x2"], ["priority"])
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("label_id", "x2", "priority")


@query("ml_encode_labels", f"""
       WITH codes AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1e0 AS code
                      FROM (SELECT DISTINCT p_type FROM {{part}} WHERE p_type < 'P'))
       SELECT p_partkey, coalesce(code, (SELECT count(*) + 0e0 FROM codes)) AS p_type_code FROM {{part}} LEFT JOIN codes USING (p_type)""")
def _(t):
    known = t.part.where("p_type < 'P'").select("p_partkey", "p_type")
    others = t.part.where("p_type >= 'P'").select("p_partkey", "p_type")
    coded = P.encode_labels(known, [others], ["p_type"])
    return coded[0].unionByName(coded[1]).select("p_partkey", "p_type_code")


@query("ml_encode_labels_plain", """
       SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1e0 AS o_orderpriority_code FROM {orders}""")
def _(t):
    coded, = P.encode_labels(t.orders.select("o_orderkey", "o_orderpriority"), [], ["o_orderpriority"], unknown=False)
    return coded.select("o_orderkey", "o_orderpriority_code")


@query("ml_pca")
def _(t):
    train, valid, test = _parts(_split(t))
    train, valid, test = P.impute_means(train, [valid, test], ["x2"])
    train, valid, test = [VectorAssembler(inputCols=_NUMERIC, outputCol="features").transform(x) for x in (train, valid, test)]
    frames, _ = P.project_pca(train, [valid, test], explained=0.9)
    out = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return out.select("label_id", "Set", F.round(vector_to_array("pca")[0], 6).alias("first"))


@query("ml_time_cross_validation")
def _(t):
    tree = M.regressor("decision_tree", "value")
    maps = V.grid({tree.maxDepth: [2, 4]})
    return _search_table(t, maps, V.time_cross_validate(_folded(t), tree, maps, S.evaluator("value")))


@query("ml_random_cross_validation")
def _(t):
    line = M.regressor("linear", "value")
    maps = V.grid({line.regParam: [0.0, 10.0]})
    model = V.random_cross_validate(_folded(t), line, maps, S.evaluator("value"))
    return t.spark.createDataFrame([(m[line.regParam], float(s)) for m, s in zip(maps, model.avgMetrics)],
                                   "reg_param double, score double")


@query("ml_random_holdout_search")
def _(t):
    line = M.regressor("linear", "value")
    maps = V.grid({line.regParam: [0.0, 10.0]})
    model = V.random_holdout_search(_folded(t), line, maps, S.evaluator("value"))
    return t.spark.createDataFrame([(m[line.regParam], float(s)) for m, s in zip(maps, model.validationMetrics)],
                                   "reg_param double, score double")


@query("ml_penalised_search")
def _(t):
    tree = M.regressor("decision_tree", "value")
    maps = V.sampled_grid({tree.maxDepth: [2, 3, 4, 5], tree.minInstancesPerNode: [1, 20]}, 3)
    assembled = VectorAssembler(inputCols=_NUMERIC, outputCol="features").transform(_split(t).na.fill(0.0, ["x2"]))
    train, valid, _ = _parts(assembled)
    return _search_table(t, maps, V.holdout_search(train, valid, tree, maps, S.evaluator("value"), penalised=True))


@query("ml_halving_search")
def _(t):
    tree = M.regressor("decision_tree", "value")
    maps = V.grid({tree.maxDepth: list(range(2, 10)), tree.minInstancesPerNode: [1, 5, 10, 20, 40]})
    assembled = settle(VectorAssembler(inputCols=_NUMERIC, outputCol="features").transform(_split(t).na.fill(0.0, ["x2"])))
    train, valid, _ = _parts(assembled)
    found, seen = V.halving_search(train, valid, tree, maps, S.evaluator("value"), ["label_id"], penalised=True)
    rows = [(r, float(s), maps[i][tree.maxDepth], maps[i][tree.minInstancesPerNode], v, maps[i] is found.params) for r, s, i, v in seen]
    return t.spark.createDataFrame(rows, "rung int, share double, max_depth int, min_instances int, score double, chosen boolean")


@query("ml_baselines")
def _(t):
    ready = time_split(_folded(t), "date", named_split)
    train, _, test = _parts(ready)
    train = settle(train)
    scored = None
    for name in M.REGRESSORS:
        fitted = M.regressor(name, "value").fit(train).transform(test)
        row = S.regression_metrics(fitted).select(F.lit(name).alias("model_name"), "*")
        scored = row if scored is None else scored.unionByName(row)
    return scored


@query("ml_metrics", f"""
       SELECT {r6('1 - sum((actual - prediction) * (actual - prediction)) / (var_pop(actual) * count(actual))')} AS r2,
              {r6('sqrt(avg((actual - prediction) * (actual - prediction)))')} AS rmse, avg(abs(actual - prediction)) AS mae,
              avg((actual - prediction) * (actual - prediction)) AS mse FROM {{scored}}""")
def _(t):
    return rounded(S.regression_metrics(t.scored, "actual"), "r2", "rmse")


@query("ml_feature_importance")
def _(t):
    model = M.regressor("gradient_boosted", "value", maxIter=5).fit(_folded(t))
    return top(M.feature_importances(model, _NUMERIC, t.spark), 10, "importance", ["feature"])


@query("ml_compare_models")
def _(t):
    tree, line = M.regressor("decision_tree", "value"), M.regressor("linear", "value")
    table, _ = S.compare_models(_folded(t), {"tree": (tree, V.grid({tree.maxDepth: [3]})),
                                             "line": (line, V.grid({line.regParam: [0.0]}))}, "value")
    return S.welch_to_previous(table).select("model_name", "r2_score", "r2_std_dev", "p_value_to_prev", "params")


_WELCH = """
    WITH l AS (SELECT *, lag(r2_score) OVER w AS m, lag(r2_std_dev) OVER w AS s FROM {comparison}
               WINDOW w AS (PARTITION BY study ORDER BY r2_score, model_name)),
    v AS (SELECT *, r2_std_dev * r2_std_dev / 6 AS a, s * s / 6 AS b FROM l),
    q AS (SELECT *, (r2_score - m) / sqrt(nullif(a + b, 0)) AS tt, (a + b) * (a + b) / nullif(a * a / 5 + b * b / 5, 0) AS dof FROM v),
    -- Student's density in the angle atan(t / sqrt(dof)), by the midpoint rule
    i AS (SELECT unnest(range(0, 4000)) AS i),
    d AS (SELECT study, model_name, sum(pow(cos((i + 0.5) * atan(tt / sqrt(dof)) / 4000), dof - 1)) * atan(tt / sqrt(dof)) / 4000 AS part,
                 sum(pow(cos((i + 0.5) * pi() / 2 / 4000), dof - 1)) * pi() / 2 / 4000 AS half FROM q, i WHERE tt IS NOT NULL
          GROUP BY study, model_name, tt, dof),
    p AS (SELECT q.*, 0.5 - d.part / (2 * d.half) AS p_value_to_prev FROM q LEFT JOIN d USING (study, model_name))"""


def _welch(t):
    return S.welch_to_previous(t.comparison, ["study"], ["r2_score", "model_name"])


@query("ml_welch_test", _WELCH + f"SELECT study, model_name, {r6('p_value_to_prev', 5)} AS p_value_to_prev FROM p")
def _(t):
    return rounded(_welch(t).select("study", "model_name", "p_value_to_prev"), "p_value_to_prev", digits=5)


@query("ml_best_model", _WELCH + """,
       o AS (SELECT *, row_number() OVER w AS place, lag(runtime) OVER w AS before FROM p WINDOW w AS (PARTITION BY study ORDER BY r2_score, model_name)),
       k AS (SELECT * FROM o WHERE place = 1 OR (r2_score > m AND (runtime <= before OR (p_value_to_prev < 0.05 AND runtime < 2 * before))))
       SELECT study, arg_max(model_name, place) AS model_name, arg_max(r2_score, place) AS r2_score, arg_max(runtime, place) AS runtime
       FROM k GROUP BY study""")
def _(t):
    return S.best_model(_welch(t), ["study"], ["r2_score", "model_name"])


@query("ml_pca_choice")
def _(t):
    line = M.regressor("linear", "value")
    table, _ = S.compare_pca(_folded(t), line, V.grid({line.regParam: [0.0]}), "value", 2)
    return table.select("model_name", "r2_score", "r2_std_dev")


@query("ml_stacking")
def _(t):
    train, _, test = _parts(time_split(_folded(t).drop("foldNumber"), "date", named_split))
    folded = time_split(train, "date", lambda r: F.floor(F.least(r, F.lit(0.999)) * 3).cast("int"), "foldNumber")
    bases = {"tree": M.regressor("decision_tree", "value"), "line": M.regressor("linear", "value")}
    return S.regression_metrics(M.fit_stacking(folded, bases).transform(test))


_LINE = "regr_intercept(value, x1) AS b0, regr_slope(value, x1) AS b1"


def _one_feature(label="value"):
    return Pipeline(stages=[VectorAssembler(inputCols=["x1"], outputCol="one"),
                            M.regressor("linear", label, "one", maxIter=100, solver="normal")])


def _places(t):
    """Training and test rows, the test rows with one of a place that no model knows."""
    train, _, test = _parts(_split(t))
    lost = test.limit(1).select(*[F.lit(-1).cast("long").alias(c) if c == "label_id" else F.lit("nowhere").alias(c) if c == "location" else c for c in test.columns])
    return train, test.unionByName(lost)


@query("ml_per_location", f"""
       WITH s AS (SELECT *, {_sets('CAST(date AS VARCHAR)')} AS part FROM {{training}}),
       f AS (SELECT location, {_LINE} FROM s WHERE part = 'train' GROUP BY location)
       SELECT label_id, location, {r6('b0 + b1 * x1', 4)} AS prediction FROM s LEFT JOIN f USING (location) WHERE part = 'test'
       UNION ALL SELECT -1, 'nowhere', NULL""")
def _(t):
    train, test = _places(t)
    out = N.predict_by_group(test, N.fit_by_group(train, ["x1"], "value", ["location"]), ["x1"], ["location"])
    return rounded(out.select("label_id", "location", "prediction"), "prediction", digits=4)


@query("ml_per_location_score", f"""
       WITH s AS (SELECT *, {_sets('CAST(date AS VARCHAR)')} AS part FROM {{training}}),
       f AS (SELECT location, {_LINE} FROM s WHERE part = 'train' GROUP BY location),
       p AS (SELECT value, b0 + b1 * x1 AS pred FROM s JOIN f USING (location) WHERE part = 'test')
       SELECT {r6('1 - sum((value - pred) * (value - pred)) / (var_pop(value) * count(*))')} AS r2 FROM p""")
def _(t):
    train, test = _places(t)
    out = N.predict_by_group(test, N.fit_by_group(train, ["x1"], "value", ["location"]), ["x1"], ["location"])
    return rounded(S.regression_metrics(out).select("r2"), "r2")


@query("ml_per_grid", f"""
       WITH f AS (SELECT grid_id, {_LINE}, count(*) AS n, var_pop(x1) AS spread, avg(value) AS mean FROM {{training}} GROUP BY grid_id)
       SELECT label_id, {r6('CASE WHEN spread > 0 THEN b0 + b1 * x1 ELSE mean END', 3)} AS prediction FROM {{training}} LEFT JOIN f USING (grid_id)""")
def _(t):
    fits = N.fit_by_group(t.training, ["x1"], "value", ["grid_id"])
    return rounded(N.predict_by_group(t.training, fits, ["x1"], ["grid_id"]).select("label_id", "prediction"), "prediction", digits=3)


@query("ml_per_location_trees")
def _(t):
    train, test = _places(t)
    tree = Pipeline(stages=[VectorAssembler(inputCols=["x1", "x3"], outputCol="features"), M.regressor("decision_tree", "value", maxDepth=4)])
    return M.fit_per_location(train, test, tree).select("label_id", "location", F.round("prediction", 4).alias("prediction"))


@query("ml_second_stage")
def _(t):
    wide = expand_predictions(t.predictions, ["grid_id", "date"], ["rank", "l_partkey", "pred"])
    means = t.predictions.groupBy("grid_id", "date").agg(F.avg("value").alias("value"))
    rows = wide.join(means, ["grid_id", "date"])
    model = M.second_stage(rows, [f"pred{i}" for i in range(1, 21)], "value")
    return model.transform(rows).select("grid_id", "date", F.round("prediction", 6).alias("prediction"))


@query("ml_persistence", f"""
       WITH l AS (SELECT *, lag(value, 1) OVER (PARTITION BY location ORDER BY date_utc) AS lag1 FROM {_DAILY})
       SELECT {d_text('date_utc')} AS date_utc, location, {r6('coalesce(lag1, (SELECT avg(lag1) FROM l))')} AS prediction FROM l""")
def _(t):
    lagged = lag_rows(station_days(t.labels_station, ["location"]), ["location"], "date_utc",
                      {"value_lag1day": ("value", 1)}, one_per_day=True)
    return rounded(S.persistence_baseline(lagged).select("date_utc", "location", "prediction"), "prediction")


@query("ml_retrain_and_predict", f"""
       WITH f AS (SELECT {_LINE} FROM {{training}} WHERE label_id % 5 > 0)
       SELECT label_id, grid_id, {r6('b0 + b1 * x1', 4)} AS prediction FROM {{training}}, f WHERE label_id % 5 = 0""")
def _(t):
    out = M.retrain_and_predict(t.training.where("label_id % 5 > 0"), t.training.where("label_id % 5 = 0"), _one_feature(), {},
                                ["label_id", "grid_id"])
    return rounded(out, "prediction", digits=4)


@query("ml_save_and_load", f"""
       WITH f AS (SELECT {_LINE} FROM {{training}})
       SELECT label_id, {r6('b0 + b1 * x1', 4)} AS prediction FROM {{training}}, f""")
def _(t):
    path = f"{shared_folder(t.spark)}/airgrid-line-{uuid.uuid4().hex}"
    M.save_model(_one_feature().fit(t.training), path)
    return rounded(M.load_pipeline(path).transform(t.training).select("label_id", "prediction"), "prediction", digits=4)


@query("ml_impute_column")
def _(t):
    out = M.impute_column(t.training, "x2", ["label_id"], "date", ["value", "grid_id"])
    return out.select("label_id", F.round("x2_imputed", 4).alias("x2_imputed"))


@query("ml_impute_column_linear")
def _(t):
    out = M.impute_column(t.training, "x2", ["label_id"], "date", ["value", "grid_id"], "linear", cross_validated=True)
    return out.select("label_id", F.round("x2_imputed", 4).alias("x2_imputed"))


@query("ml_impute_line", f"""
       WITH k AS (SELECT label_id, date, x2, CASE WHEN label_id % 5 > 0 THEN x1 END AS x1 FROM {{training}}),
       r AS (SELECT *, percent_rank() OVER (ORDER BY date) AS r FROM k WHERE x2 IS NOT NULL),
       t AS (SELECT * FROM r WHERE r < 0.12 OR (r >= 0.17 AND r < 0.28) OR (r >= 0.33 AND r < 0.45) OR (r >= 0.5 AND r < 0.62)
                                OR (r >= 0.67 AND r < 0.78) OR (r >= 0.83 AND r < 0.95)),
       m AS (SELECT avg(x1) AS m FROM t),
       f AS (SELECT regr_intercept(x2, coalesce(x1, m)) AS b0, regr_slope(x2, coalesce(x1, m)) AS b1 FROM t, m)
       SELECT label_id, {r6('b0 + b1 * coalesce(x1, m)', 4)} AS x2_imputed FROM k, f, m WHERE x2 IS NULL""")
def _(t):
    gaps = t.training.withColumn("x1", F.when(F.col("label_id") % 5 > 0, F.col("x1"))).select("label_id", "date", "x1", "x2")
    out = M.impute_column(gaps, "x2", ["label_id"], "date", learner="linear", cross_validated=True)
    return rounded(out, "x2_imputed", digits=4)


# number of a row's time fold, by its rank r
FOLD_SQL = "CASE " + " ".join(f"WHEN r < {cut} THEN {i}" for i, cut in enumerate(SIX_FOLD_CUTS)) + f" ELSE {len(SIX_FOLD_CUTS)} END"

_FOLDED_LINE = f"""
       k AS (SELECT label_id, date, x2, CASE WHEN label_id % 5 > 0 THEN x1 END AS x1 FROM {{training}}),
       r AS (SELECT *, {FOLD_SQL} AS fold FROM (SELECT *, percent_rank() OVER (ORDER BY date) AS r FROM k WHERE x2 IS NOT NULL)),
       m AS (SELECT avg(x1) AS m FROM r WHERE fold % 2 = 0),
       t AS (SELECT fold, coalesce(x1, m) AS x, x2 AS y FROM r, m),
       o AS (SELECT unnest([0e0, 0.5e0, 2e0]) AS penalty),
       g AS (SELECT fold, penalty, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) / (var_pop(x) * (1 + penalty)) AS b FROM t, o GROUP BY fold, penalty),
       e AS (SELECT g.fold, penalty, 1 - sum((y - my - b * (x - mx)) * (y - my - b * (x - mx))) / (var_pop(y) * count(*)) AS score
             FROM g JOIN t ON t.fold = g.fold + 1 WHERE g.fold % 2 = 0 GROUP BY g.fold, penalty),
       c AS (SELECT penalty, avg(score) AS score FROM e GROUP BY penalty),
       w AS (SELECT arg_max(penalty, (score, -penalty)) AS penalty FROM c)"""


def _folded_line(t):
    gaps = t.training.withColumn("x1", F.when(F.col("label_id") % 5 > 0, F.col("x1"))).select("label_id", "date", "x1", "x2")
    return M.impute_line(gaps, "x2", ["label_id"], "date", penalties=(0.0, 0.5, 2.0))


@query("ml_impute_search", f"""
       WITH {_FOLDED_LINE},
       f AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(x, y) / (var_pop(x) * (1 + any_value(penalty))) AS b FROM t, w)
       SELECT label_id, {r6('my + b * (coalesce(x1, m) - mx)', 4)} AS x2_imputed FROM k, f, m WHERE x2 IS NULL""")
def _(t):
    out, _ = _folded_line(t)
    return rounded(out, "x2_imputed", digits=4)


@query("ml_impute_search_scores", f"""
       WITH {_FOLDED_LINE} SELECT penalty, {r6('score')} AS score, penalty = (SELECT penalty FROM w) AS chosen FROM c""")
def _(t):
    _, fit = _folded_line(t)
    rows = [(p, s, p == fit.penalty) for p, s in fit.scores.items()]
    return rounded(t.spark.createDataFrame(rows, "penalty double, score double, chosen boolean"), "score")
