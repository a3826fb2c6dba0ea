"""Fits on a signal with known shape, and the rules around them."""

import datetime as dt
import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from airgrid.learning import models as M
from airgrid.learning import prepare as P
from airgrid.learning import scores as S
from airgrid.learning import validate as V
from airgrid.operators.splits import six_folds, time_split


@pytest.fixture(scope="module")
def signal(spark):
    rng = random.Random(0)
    rows = []
    for i in range(600):
        a, b = rng.random(), rng.random()
        rows.append((i, dt.date(2020, 1, 1) + dt.timedelta(days=i // 2), rng.choice(["dl", "la"]), a, b, 3 * a - 2 * b + rng.gauss(0, 0.02)))
    df = spark.createDataFrame(rows, "id int, date date, location string, a double, b double, value double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).cache()


@pytest.fixture(scope="module")
def folded(signal):
    return time_split(signal, "date", six_folds, "foldNumber").cache()


def test_folds_move_forward_in_time(folded):
    spans = {r[0]: (r[1], r[2]) for r in folded.groupBy("foldNumber").agg(F.min("date"), F.max("date")).collect()}
    pairs = V.fold_pairs(folded)
    assert pairs == [(f, f + 1) for f in range(0, 12, 2)]
    for train, valid in pairs:
        assert spans[train][1] < spans[valid][0]


def test_time_cross_validation_finds_the_better_map(folded):
    line = M.regressor("linear", "value")
    maps = V.grid({line.regParam: [0.0, 50.0]})
    found = V.time_cross_validate(folded, line, maps, S.evaluator("value"))
    assert found.params[line.regParam] == 0.0
    assert found.score > 0.95 and found.score == max(found.scores)
    assert list(found.model.coefficients) == pytest.approx([3, -2], abs=0.05)


def test_smaller_is_better_for_rmse(folded):
    line = M.regressor("linear", "value")
    maps = V.grid({line.regParam: [0.0, 50.0]})
    assert V.time_cross_validate(folded, line, maps, S.evaluator("value", "rmse")).params[line.regParam] == 0.0


def test_cross_validation_needs_pairs(folded):
    line = M.regressor("linear", "value")
    with pytest.raises(ValueError):
        V.time_cross_validate(folded.where("foldNumber = 0"), line, V.grid({}), S.evaluator("value"))


def test_penalty_lowers_an_overfit_score(folded):
    tree = M.regressor("decision_tree", "value")
    train, valid = folded.where("foldNumber = 0"), folded.where("foldNumber = 1")
    maps = V.grid({tree.maxDepth: [6]})
    plain = V.holdout_search(train, valid, tree, maps, S.evaluator("value")).score
    assert V.holdout_search(train, valid, tree, maps, S.evaluator("value"), penalised=True).score < plain


def test_sampled_grid_is_repeatable():
    tree = M.regressor("decision_tree", "value")
    choices = {tree.maxDepth: [1, 2, 3], tree.minInstancesPerNode: [1, 2]}
    assert len(V.grid(choices)) == 6
    assert V.sampled_grid(choices, 2) == V.sampled_grid(choices, 2)
    assert len(V.sampled_grid(choices, 9)) == 6


@pytest.mark.parametrize("name", sorted(M.REGRESSORS))
def test_every_learner_learns(signal, name):
    fitted = M.regressor(name, "value").fit(signal).transform(signal)
    assert S.regression_metrics(fitted).first()["r2"] > (0.5 if name != "factorization" else -1)


def test_metrics_match_the_evaluator(signal):
    scored = M.regressor("linear", "value").fit(signal).transform(signal)
    ours = S.regression_metrics(scored).first()
    for metric in ("r2", "rmse", "mae", "mse"):
        assert ours[metric] == pytest.approx(S.evaluator("value", metric).evaluate(scored))


def test_stacking_beats_its_worst_base(folded):
    train, test = folded.where("foldNumber < 8").withColumn("foldNumber", F.col("id") % 3), folded.where("foldNumber >= 8")
    bases = {"tree": M.regressor("decision_tree", "value", maxDepth=2), "line": M.regressor("linear", "value")}
    stacked = S.regression_metrics(M.fit_stacking(train, bases).transform(test)).first()["r2"]
    worst = S.regression_metrics(bases["tree"].fit(train).transform(test)).first()["r2"]
    assert stacked > worst and stacked > 0.95


def test_one_model_per_location(signal):
    shifted = signal.withColumn("value", F.when(F.col("location") == "dl", F.col("value") + 100).otherwise(F.col("value")))
    out = M.fit_per_location(shifted, shifted, M.regressor("linear", "value"))
    assert out.count() == shifted.count()
    assert S.regression_metrics(out).first()["r2"] > 0.999


def test_encoder_gives_unseen_texts_the_last_code(table):
    train, test = table([("b",), ("a",), ("c",)], "t string"), table([("a",), ("z",), (None,)], "t string")
    coded = P.encode_labels(train, [test], ["t"])
    assert dict(tuple(r) for r in coded[0].collect()) == {"a": 0.0, "b": 1.0, "c": 2.0}
    assert [r[1] for r in coded[1].collect()] == [0.0, 3.0, 3.0]


def test_means_come_from_training_rows_per_column(table):
    train, test = table([(1.0, 10.0, "x"), (3.0, None, None)], "a double, b double, t string"), table([(None, None, None)], "a double, b double, t string")
    filled = P.impute_means(train, [test], ["a", "b"], ["t"])
    assert tuple(filled[1].first()) == (2.0, 10.0, "VV_likely")
    assert [r["t"] for r in filled[0].collect()] == ["x", "VV_likely"]


def test_feature_pipeline_is_fitted_on_train(table):
    schema = "n double, m double, t string"
    train = table([(float(i), float(i * i), "ab"[i % 2]) for i in range(20)], schema)
    model, frames = P.fit_features(train, [table([(5.0, 1.0, "new")], schema)], P.feature_pipeline(["n", "m"], ["t"]))
    assert P.feature_names(model) == ["t_code", "n", "m"]
    assert len(frames[1].first()["features"]) == 3


def test_pca_keeps_enough_variance(signal):
    wide = VectorAssembler(inputCols=["a", "a", "b"], outputCol="three").transform(signal)
    frames, k = P.project_pca(wide, [wide], features="three", explained=0.9)
    assert k == 2 and len(frames[1].first()["pca"]) == 2


def test_student_tail_known_values(table):
    df = table([(0.0, 5.0), (2.015048, 5.0), (-2.015048, 5.0), (1.812461, 10.0), (3.0, 8.25)], "t double, d double")
    found = [r[0] for r in df.select(S.student_upper_tail(F.col("t"), F.col("d"))).collect()]
    assert found[:4] == pytest.approx([0.5, 0.05, 0.95, 0.05], abs=1e-6)
    assert 0.0 < found[4] < 0.01


def test_welch_and_choice(table):
    schema = "model_name string, r2_score double, r2_std_dev double, runtime double"
    rows = [("a", 0.5, 0.01, 10.0), ("b", 0.6, 0.01, 15.0), ("c", 0.61, 0.2, 20.0), ("d", 0.8, 0.01, 100.0)]
    tested = S.welch_to_previous(table(rows, schema))
    p = {r["model_name"]: r["p_value_to_prev"] for r in tested.collect()}
    assert p["a"] is None and p["b"] < 0.001 and p["c"] > 0.4
    # c is not surely better, d takes five times as long
    assert S.best_model(tested).first()["model_name"] == "b"
    level = S.welch_to_previous(table([("a", 0.5, 0.0, 1.0), ("b", 0.5, 0.0, 1.0)], schema))
    assert [r["p_value_to_prev"] for r in level.collect()] == [None, None]
    assert S.best_model(level).first()["model_name"] == "a"


def test_persistence(table):
    df = table([(1.0, None), (2.0, 4.0), (3.0, 8.0)], "value double, value_lag1day double")
    assert [r["prediction"] for r in S.persistence_baseline(df).orderBy("value").collect()] == [6.0, 4.0, 8.0]


def test_siblings():
    assert M.siblings("max_Column_WV") == ["min_Column_WV", "median_Column_WV"]
    assert M.siblings("median_Optical_Depth_047") == ["min_Optical_Depth_047", "max_Optical_Depth_047"]
    assert M.siblings("value") == []


@pytest.mark.parametrize("learner", ["linear", "gradient_boosted"])
def test_imputation_fills_only_gaps(signal, learner):
    holes = signal.select("id", "date", "a", "b", F.when(F.col("id") % 5 > 0, F.col("value")).alias("value"))
    out = M.impute_chain(holes, ["value"], ["id"], "date", learner=learner)
    assert out.columns == holes.columns and out.where("value IS NULL").count() == 0
    joined = out.join(signal.select("id", F.col("value").alias("truth")), "id")
    assert joined.where("id % 5 > 0 AND value <> truth").count() == 0
    assert joined.where("id % 5 = 0").agg(F.corr("value", "truth")).first()[0] > 0.9


def test_importances_and_saving(spark, signal, tmp_path):
    model = M.regressor("decision_tree", "value").fit(signal)
    weights = dict(tuple(r) for r in M.feature_importances(model, ["a", "b"], spark).collect())
    assert weights["a"] > weights["b"] and sum(weights.values()) == pytest.approx(1)
    pipeline = M.second_stage(signal, ["a", "b"], "value")
    M.save_model(pipeline, f"{tmp_path}/model")
    same = M.load_pipeline(f"{tmp_path}/model").transform(signal)
    assert S.regression_metrics(same).first()["r2"] > 0.95
