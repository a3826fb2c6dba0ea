"""Regressors, stacking, per-location models and chained imputation."""

from __future__ import annotations

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor, FMRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.constants import SIBLING_STATISTICS, SUMMARY_BANDS
from airgrid.learning.normal import PENALTIES, LinearFit, fit_by_folds
from airgrid.learning.prepare import feature_pipeline
from airgrid.learning.validate import grid, time_cross_validate
from airgrid.operators.clean import feature_columns
from airgrid.operators.splits import six_folds, time_split, two_way
from airgrid.session import discard, settle

# learner name -> class and defaults
REGRESSORS = {
    "decision_tree": (DecisionTreeRegressor, {"seed": 42}),
    "random_forest": (RandomForestRegressor, {"seed": 42}),
    "gradient_boosted": (GBTRegressor, {"maxIter": 10, "seed": 42}),
    "linear": (LinearRegression, {"maxIter": 10}),
    "generalized_linear": (GeneralizedLinearRegression, {}),
    "factorization": (FMRegressor, {"maxIter": 20, "seed": 42}),
}


def regressor(name: str, label: str, features: str = "features", **params) -> Estimator:
    kind, defaults = REGRESSORS[name]
    return kind(featuresCol=features, labelCol=label, **{**defaults, **params})


def feature_importances(model: Model, names: list[str], spark) -> DataFrame:
    """Feature and importance, as a table of one row per feature."""
    weights = model.featureImportances.toArray()
    return spark.createDataFrame([(n, float(w)) for n, w in zip(names, weights)], "feature string, importance double")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


class StackedModel:
    """Base models and the learner over their predictions."""

    def __init__(self, bases: dict[str, Model], assembler: VectorAssembler, meta: Model):
        self.bases, self.assembler, self.meta = bases, assembler, meta

    def transform(self, df: DataFrame) -> DataFrame:
        columns = df.columns
        stacked = self.assembler.transform(_predictions(df, self.bases))
        return self.meta.transform(stacked).select(*columns, self.meta.getPredictionCol())


def _predictions(df: DataFrame, models: dict[str, Model]) -> DataFrame:
    for name, model in models.items():
        df = model.transform(df).withColumnRenamed(model.getPredictionCol(), f"_pred_{name}")
    return df


def fit_stacking(train: DataFrame, bases: dict[str, Estimator], meta: Estimator | None = None,
                 label: str = "value", fold: str = "foldNumber") -> StackedModel:
    """Meta learner over out-of-fold predictions of the bases; the bases are then refitted on all rows."""
    train = settle(train, (fold,))
    folds = sorted(r[0] for r in train.select(fold).distinct().collect())
    if len(folds) < 2:
        raise ValueError("stacking needs at least two folds")
    parts = []
    for held_out in folds:
        rest = train.where(F.col(fold) != held_out)
        fitted = {name: base.fit(rest) for name, base in bases.items()}
        parts.append(_predictions(train.where(F.col(fold) == held_out), fitted)
                     .select(label, *[f"_pred_{n}" for n in bases]))
    out_of_fold = parts[0]
    for part in parts[1:]:
        out_of_fold = out_of_fold.unionByName(part)
    assembler = VectorAssembler(inputCols=[f"_pred_{n}" for n in bases], outputCol="_stack")
    meta = meta or LinearRegression()
    meta = meta.copy({meta.featuresCol: "_stack", meta.labelCol: label})
    stacked = StackedModel({n: b.fit(train) for n, b in bases.items()}, assembler,
                           meta.fit(assembler.transform(out_of_fold)))
    discard(train)
    return stacked


def fit_per_location(train: DataFrame, test: DataFrame, estimator: Estimator, location: str = "location") -> DataFrame:
    """One model per location of the training rows, predictions of its test rows stacked.

    Test rows of a location without training rows come back with a NULL prediction. Locations are
    the cities of the study, a handful.
    """
    known = [row[0] for row in train.select(location).distinct().orderBy(location).toLocalIterator()]
    seen = F.lit(False)
    for place in known:
        seen = seen | F.col(location).eqNullSafe(place)
    out = test.where(~seen).withColumn("prediction", F.lit(None).cast("double"))
    for place in known:
        here = F.col(location).eqNullSafe(place)
        predicted = estimator.fit(train.where(here)).transform(test.where(here))
        out = out.unionByName(predicted, allowMissingColumns=True)
    return out


def second_stage(train: DataFrame, columns: list[str], label: str) -> PipelineModel:
    """Linear model over expanded cell predictions."""
    assembler = VectorAssembler(inputCols=columns, outputCol="_cells")
    return PipelineModel([assembler, LinearRegression(featuresCol="_cells", labelCol=label).fit(
        assembler.transform(train))])


def retrain_and_predict(train: DataFrame, submission: DataFrame, estimator: Estimator, params: dict,
                        keys: list[str], prediction: str = "prediction") -> DataFrame:
    """Fit the chosen parameters on all training rows and predict the submission rows."""
    return estimator.fit(train, params).transform(submission).select(*keys, prediction)


def siblings(column: str, bands=tuple(SUMMARY_BANDS)) -> list[str]:
    """The other statistics of the same band."""
    for band in bands:
        for kind in SIBLING_STATISTICS:
            if column == f"{kind}_{band}":
                return [f"{other}_{band}" for other in SIBLING_STATISTICS if other != kind]
    return []


def impute_column(df: DataFrame, column: str, keys: list[str], date: str, drop: list[str] = (),
                  learner: str = "gradient_boosted", cross_validated: bool = False, search=None) -> DataFrame:
    """Predict the missing values of one column: keys and `<column>_imputed`, missing rows only.

    The features are fitted on the training part of the time split, the model likewise. Gaps in
    numeric features become the training mean; a feature without any training value is left out.
    `search(rows, model)` picks among settings by the folds and returns the fitted winner.
    """
    known, unknown = df.where(F.col(column).isNotNull()), df.where(F.col(column).isNull())
    _, numeric, text = feature_columns(df, [*keys, date, *drop], column)
    cut = six_folds if cross_validated else (lambda rank: two_way(rank, 0.8))
    # read by every stage of the pipeline and by the learner
    folded = settle(time_split(known, date, cut, alias="foldNumber"))
    train = folded.where(F.col("foldNumber") % 2 == 0)
    held = train.agg(*[F.count(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(c) for c in numeric]).first() if numeric else {}
    numeric = [c for c in numeric if held[c]]
    prepared = feature_pipeline(numeric, text, impute=True).fit(train)
    model = regressor(learner, column)

    def ready(frame):
        return prepared.transform(frame)

    fitted = search(ready(folded), model) if search else model.fit(ready(train))
    discard(folded)
    return fitted.transform(ready(unknown)).select(*keys, F.col("prediction").alias(column + "_imputed"))


def impute_in_place(df: DataFrame, column: str, fit: LinearFit | PipelineModel, prepared: PipelineModel | None = None) -> DataFrame:
    """`df` with the gaps of a column predicted in the rows where they stand; nothing is joined back."""
    if isinstance(fit, LinearFit):
        return df.withColumn(column, F.coalesce(F.col(column), fit.expression()))
    predicted = fit.transform(prepared.transform(df))
    return predicted.withColumn(column, F.coalesce(F.col(column), F.col("prediction"))).select(df.columns)


def fit_imputer(folded: DataFrame, column: str, features: list[str], text: list[str], fold: str, learner: str,
                penalties: tuple[float, ...] = PENALTIES, choices: dict | None = None) -> tuple[LinearFit | Model, PipelineModel | None]:
    """The model of a column's known values that the time folds choose, and its feature pipeline (None for a line).

    A line is searched over penalties from sums alone; texts are no features of it. Other learners are searched over
    `choices` (parameter name to values) by training each even fold and scoring the odd one after it; without choices
    the even folds train one model.
    """
    if learner == "linear":
        return fit_by_folds(folded, features, column, fold, penalties), None
    known = folded.where(F.col(column).isNotNull())
    train = known.where(F.col(fold) % 2 == 0)
    held = train.agg(*[F.count(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(c) for c in features]).first() if features else {}
    prepared = feature_pipeline([c for c in features if held[c]], text, impute=True).fit(train)
    model = regressor(learner, column)
    if not choices:
        return model.fit(prepared.transform(train)), prepared
    maps = grid({model.getParam(name): values for name, values in choices.items()})
    ready = prepared.transform(known).select(column, fold, "features")
    return time_cross_validate(ready, model, maps, RegressionEvaluator(labelCol=column, metricName="r2"), fold).model, prepared


def impute_chain(df: DataFrame, columns: list[str], keys: list[str], date: str, drop: list[str] = (),
                 learner: str = "gradient_boosted", **search) -> DataFrame:
    """Impute columns one after the other, each able to use the ones filled before it.

    Rows get their time fold once; each column's model is chosen by it (`fit_imputer`) and predicts in place. Rounds are
    written to the shared folder, so the plan does not grow and lost executors cost no earlier round; the round before
    is deleted then.
    """
    fold = "_fold"
    out = settle(time_split(df, date, six_folds, alias=fold))
    _, numeric, text = feature_columns(df, [*keys, date, *drop], "")
    for column in columns:
        apart = {column, *siblings(column)}
        fit, prepared = fit_imputer(out, column, [c for c in numeric if c not in apart], text, fold, learner, **search)
        before, out = out, settle(impute_in_place(out, column, fit, prepared))
        discard(before)
    return out.select(df.columns)


def impute_line(df: DataFrame, column: str, keys: list[str], date: str, drop: list[str] = (),
                penalties: tuple[float, ...] = PENALTIES) -> tuple[DataFrame, LinearFit]:
    """Keys and `<column>_imputed` of the rows without a value, and the line that the time folds of the others chose."""
    known = df.where(F.col(column).isNotNull())
    _, numeric, _ = feature_columns(df, [*keys, date, *drop], column)
    folded = settle(time_split(known, date, six_folds, alias="_fold"))
    fit = fit_by_folds(folded, numeric, column, "_fold", penalties)
    discard(folded)
    return df.where(F.col(column).isNull()).select(*keys, fit.expression().alias(column + "_imputed")), fit
