"""Metrics, model comparison and model choice."""

from __future__ import annotations

import time

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airgrid.session import discard, settle
from airgrid.constants import COMPARISON_RUNS, RUNTIME_FACTOR, SIGNIFICANCE
from airgrid.learning.validate import time_cross_validate


def regression_metrics(df: DataFrame, label: str = "value", prediction: str = "prediction",
                       keys: list[str] = ()) -> DataFrame:
    """r2, rmse, mae and mse in one pass."""
    y, error = F.col(label), F.col(label) - F.col(prediction)
    usable = df.where(y.isNotNull() & F.col(prediction).isNotNull())
    mse = F.avg(error * error)
    return usable.groupBy(*keys).agg(
        (1 - F.sum(error * error) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"),
        F.sqrt(mse).alias("rmse"), F.avg(F.abs(error)).alias("mae"), mse.alias("mse"))


def evaluator(label: str, metric: str = "r2") -> RegressionEvaluator:
    return RegressionEvaluator(labelCol=label, metricName=metric)


def persistence_baseline(df: DataFrame, previous: str = "value_lag1day") -> DataFrame:
    """Yesterday's value as prediction; where there is none, the mean of the known ones."""
    mean = df.agg(F.avg(previous)).first()[0]
    return df.withColumn("prediction", F.coalesce(F.col(previous), F.lit(mean)))


def constant_baseline(df: DataFrame, value: float = 0.0) -> DataFrame:
    return df.withColumn("prediction", F.lit(value))


def compare_models(df: DataFrame, candidates: dict, label: str, fold: str = "foldNumber",
                   parallelism: int = 4) -> tuple[DataFrame, dict]:
    """Score {name: (estimator, maps)} by time folds; a row per model, worst first, and the results."""
    results, rows = {}, []
    judge = evaluator(label)
    df = settle(df, (fold,))  # once for all, so that no runtime includes it
    for name, (estimator, maps) in candidates.items():
        begun = time.monotonic()
        found = time_cross_validate(df, estimator, maps, judge, fold, parallelism, settled=True)
        results[name] = found
        chosen = ", ".join(f"{p.name}={v}" for p, v in sorted(found.params.items(), key=lambda i: i[0].name))
        rows.append((name, found.score, found.deviation, time.monotonic() - begun, chosen))
    discard(df)
    table = df.sparkSession.createDataFrame(
        rows, "model_name string, r2_score double, r2_std_dev double, runtime double, params string")
    return table.orderBy("r2_score"), results


def compare_pca(df: DataFrame, estimator, maps: list[dict], label: str, k: int, fold: str = "foldNumber",
                features: str = "features", parallelism: int = 4) -> tuple[DataFrame, dict]:
    """The same learner on plain features and on k principal components, scored by time folds.

    The components are fitted inside each training fold.
    """
    reduced = Pipeline(stages=[PCA(k=k, inputCol=features, outputCol="_pca"),
                               estimator.copy({estimator.featuresCol: "_pca"})])
    return compare_models(df, {"plain": (estimator, maps), f"pca{k}": (reduced, maps)}, label, fold, parallelism)


def student_upper_tail(t: Column, dof: Column, steps: int = 400) -> Column:
    """P(T > t) of Student's t with `dof` degrees of freedom.

    With x = sqrt(dof) tan(a) the density is cos(a)^(dof - 1) up to a constant, integrated here by
    Simpson's rule.
    """

    def integral(end):
        h = end / steps
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0),
            lambda acc, i: acc + F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            * F.pow(F.greatest(F.cos(i * h), F.lit(0.0)), dof - 1)) * h / 3

    angle = F.atan(t / F.sqrt(dof))
    return F.lit(0.5) - integral(angle) / (2 * integral(F.lit(3.141592653589793 / 2)))


def welch_to_previous(df: DataFrame, group: list[str] = (), order: list[str] = ("r2_score",),
                      n: int = COMPARISON_RUNS) -> DataFrame:
    """One-sided Welch test of each model against the one before it, by increasing score.

    A comparison table has one row per model, so its groups are small.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    paired = df.select("*", F.lag("r2_score").over(window).alias("_m"), F.lag("r2_std_dev").over(window).alias("_s"))
    a, b = F.col("r2_std_dev") * F.col("r2_std_dev") / n, F.col("_s") * F.col("_s") / n
    spread = a + b
    tested = paired.withColumn("_spread", spread).withColumn(
        "_dof", F.when(spread > 0, spread * spread / (a * a / (n - 1) + b * b / (n - 1)))).withColumn(
        "_t", F.when(F.col("_spread") > 0, (F.col("r2_score") - F.col("_m")) / F.sqrt("_spread")))
    return tested.withColumn("p_value_to_prev", student_upper_tail(F.col("_t"), F.col("_dof"))) \
        .drop("_m", "_s", "_spread", "_t", "_dof")


def best_model(df: DataFrame, group: list[str] = (), order: list[str] = ("r2_score",)) -> DataFrame:
    """The last model, by increasing score, that beats the one before it.

    Beating means a better score in no more time, or a significantly better one in less than
    twice the time. The first model stands when no later one qualifies.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    placed = df.select("*", F.row_number().over(window).alias("_place"),
                       F.lag("r2_score").over(window).alias("_score"), F.lag("runtime").over(window).alias("_time"))
    better = F.col("r2_score") > F.col("_score")
    quick = F.col("runtime") <= F.col("_time")
    sure = (F.col("p_value_to_prev") < SIGNIFICANCE) & (F.col("runtime") < RUNTIME_FACTOR * F.col("_time"))
    qualified = placed.where((F.col("_place") == 1) | (better & (quick | F.coalesce(sure, F.lit(False)))))
    return qualified.groupBy(*group).agg(
        *[F.max_by(c, "_place").alias(c) for c in ("model_name", "r2_score", "runtime")])
