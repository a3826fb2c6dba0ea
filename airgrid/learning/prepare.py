"""Feature pipelines and imputation fitted on training rows."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    PCA, Imputer, QuantileDiscretizer, StandardScaler, StringIndexer, VectorAssembler, VectorIndexer,
)
from pyspark.sql import DataFrame

from airgrid.constants import MISSING_TEXT


def feature_pipeline(numeric: list[str], text: list[str] = (), max_categories: int = 4,
                     buckets: int | None = None, scale: bool = True, impute: bool = False) -> Pipeline:
    """Index texts, optionally fill or bucket numbers, assemble, index small categories, scale by deviation.

    With `impute` gaps in numbers become the mean of the rows it is fitted on. Without it they
    stay NaN, and scaling turns a column with a gap into NaN on every row.
    """
    stages, inputs = [], []
    if impute and numeric:
        full = [c + "_full" for c in numeric]
        stages.append(Imputer(strategy="mean", inputCols=list(numeric), outputCols=full))
        numeric = full
    if text:
        coded = [c + "_code" for c in text]
        stages.append(StringIndexer(inputCols=list(text), outputCols=coded, handleInvalid="keep"))
        inputs += coded
    if buckets:
        bucketed = [c + "_bucket" for c in numeric]
        stages.append(QuantileDiscretizer(numBuckets=buckets, inputCols=list(numeric), outputCols=bucketed,
                                          handleInvalid="keep"))
        inputs += bucketed
    else:
        inputs += list(numeric)
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_assembled", handleInvalid="keep"))
    stages.append(VectorIndexer(inputCol="_assembled", outputCol="_indexed" if scale else "features",
                                handleInvalid="keep", maxCategories=max_categories))
    if scale:
        stages.append(StandardScaler(inputCol="_indexed", outputCol="features", withStd=True, withMean=False))
    return Pipeline(stages=stages)


def feature_names(model: PipelineModel) -> list[str]:
    """Input columns in vector order."""
    for stage in model.stages:
        if isinstance(stage, VectorAssembler):
            return stage.getInputCols()
    raise ValueError("the pipeline assembles no vector")


def fit_features(train: DataFrame, others: list[DataFrame], pipeline: Pipeline) -> tuple[PipelineModel, list[DataFrame]]:
    """Fit on the training rows only; transform them and the other frames."""
    model = pipeline.fit(train)
    return model, [model.transform(df) for df in (train, *others)]


def impute_means(train: DataFrame, others: list[DataFrame], columns: list[str],
                 text: list[str] = ()) -> list[DataFrame]:
    """Missing numbers become the training mean, missing texts a fixed category."""
    model = Imputer(strategy="mean", inputCols=list(columns), outputCols=list(columns)).fit(train)
    out = [model.transform(df) for df in (train, *others)]
    return [df.fillna(MISSING_TEXT, subset=list(text)) if text else df for df in out]


def encode_labels(train: DataFrame, others: list[DataFrame], columns: list[str], unknown: bool = True,
                  suffix: str = "_code") -> list[DataFrame]:
    """Alphabetical codes from the training rows; with `unknown` unseen texts share the last code."""
    indexer = StringIndexer(inputCols=list(columns), outputCols=[c + suffix for c in columns],
                            stringOrderType="alphabetAsc", handleInvalid="keep" if unknown else "error")
    model = indexer.fit(train)
    return [model.transform(df) for df in (train, *others)]


def project_pca(train: DataFrame, others: list[DataFrame], k: int | None = None, explained: float = 0.95,
                features: str = "features", output: str = "pca") -> tuple[list[DataFrame], int]:
    """Principal components fitted on the training rows; k by explained variance when not given."""
    size = len(train.select(features).first()[0])
    if k is None:
        shares = PCA(k=size, inputCol=features, outputCol=output).fit(train).explainedVariance.toArray()
        total, k = 0.0, 0
        for share in shares:
            total, k = total + share, k + 1
            if total >= explained:
                break
    model = PCA(k=k, inputCol=features, outputCol=output).fit(train)
    return [model.transform(df) for df in (train, *others)], k
