"""Time-valid cross-validation and parameter search."""

from __future__ import annotations

import random
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from statistics import fmean, pstdev

from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.session import discard, settle


def grid(choices: dict) -> list[dict]:
    """All combinations of {param: values}."""
    builder = ParamGridBuilder()
    for param, values in choices.items():
        builder = builder.addGrid(param, values)
    return builder.build()


def sampled_grid(choices: dict, n: int, seed: int = 42) -> list[dict]:
    """n combinations drawn without repeats, all of them when there are no more."""
    maps = grid(choices)
    return maps if len(maps) <= n else random.Random(seed).sample(maps, n)


@dataclass
class SearchResult:
    model: Model
    params: dict
    score: float
    deviation: float
    scores: list[float]
    deviations: list[float]


def fold_pairs(df: DataFrame, fold: str = "foldNumber") -> list[tuple[int, int]]:
    """(train, validate) fold numbers present in the data: each even fold with the next odd one."""
    present = {r[0] for r in df.select(fold).distinct().collect()}
    return [(f, f + 1) for f in sorted(present) if f % 2 == 0 and f + 1 in present]


def _scores(estimator, maps, evaluator, train, valid, parallelism, penalised):
    """One score per parameter map; the fold's frames stay cached while its models are fitted."""
    train, valid = train.persist(), valid.persist()
    try:
        def score(item):
            index, model = item
            held_out = evaluator.evaluate(model.transform(valid))
            if penalised:
                held_out -= evaluator.evaluate(model.transform(train)) - held_out
            return index, held_out

        fits = estimator.fitMultiple(train, maps)
        with ThreadPool(min(parallelism, len(maps))) as pool:
            found = dict(pool.map(lambda _: score(next(fits)), maps))
        return [found[i] for i in range(len(maps))]
    finally:
        train.unpersist()
        valid.unpersist()


def time_cross_validate(df: DataFrame, estimator: Estimator, maps: list[dict], evaluator: Evaluator,
                        fold: str = "foldNumber", parallelism: int = 4, penalised: bool = False,
                        settled: bool = False) -> SearchResult:
    """Train on each even fold, validate on the one after it, refit the best parameters on all rows.

    `penalised` scores held_out - (train - held_out), which counts over-fitting against a model.
    The table is computed once and stored by fold, so that each fold reads only its own files; a
    caller that has `settled` it so keeps the files, else they are deleted at the end.
    """
    df = df if settled else settle(df, (fold,))
    pairs = fold_pairs(df, fold)
    if not pairs:
        raise ValueError("no even fold is followed by an odd one")
    columns = []
    for train_fold, valid_fold in pairs:
        columns.append(_scores(estimator, maps, evaluator, df.where(F.col(fold) == train_fold),
                               df.where(F.col(fold) == valid_fold), parallelism, penalised))
    per_map = list(zip(*columns))
    means, spreads = [fmean(s) for s in per_map], [pstdev(s) for s in per_map]
    pick = max if evaluator.isLargerBetter() else min
    best = pick(range(len(maps)), key=means.__getitem__)
    model = estimator.fit(df, maps[best])
    if not settled:
        discard(df)
    return SearchResult(model, maps[best], means[best], spreads[best], means, spreads)


def random_cross_validate(df: DataFrame, estimator: Estimator, maps: list[dict], evaluator: Evaluator,
                          folds: int = 3, parallelism: int = 4, seed: int = 42):
    return CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds,
                          parallelism=parallelism, seed=seed).fit(df)


def random_holdout_search(df: DataFrame, estimator: Estimator, maps: list[dict], evaluator: Evaluator,
                          ratio: float = 0.75, parallelism: int = 4, seed: int = 42):
    return TrainValidationSplit(estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator,
                                trainRatio=ratio, parallelism=parallelism, seed=seed).fit(df)


def holdout_search(train: DataFrame, valid: DataFrame, estimator: Estimator, maps: list[dict],
                   evaluator: Evaluator, parallelism: int = 4, penalised: bool = False) -> SearchResult:
    """Best parameters by the validation rows; the test rows decide nothing."""
    scores = _scores(estimator, maps, evaluator, train, valid, parallelism, penalised)
    pick = max if evaluator.isLargerBetter() else min
    best = pick(range(len(maps)), key=scores.__getitem__)
    return SearchResult(estimator.fit(train, maps[best]), maps[best], scores[best], 0.0, scores, [0.0] * len(maps))


def hash_share(keys: list[str], share: float, seed: int = 42):
    """Rows of a share of all, by a hash of their key; the rows of a smaller share are among those of a larger one."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(1 << 30)) < int(share * (1 << 30))


def halving_search(train: DataFrame, valid: DataFrame, estimator: Estimator, maps: list[dict], evaluator: Evaluator, keys: list[str],
                   factor: int = 3, least: float = 0.05, parallelism: int = 4, penalised: bool = False) -> tuple[SearchResult, list[tuple]]:
    """Successive halving: all settings on a small share of the training rows, the best third on three times as many, and so on.

    Shares are nested samples by a hash of the row's keys; the last rung trains on all rows. Every rung scores on the
    same validation rows, which decide alone; `penalised` takes off what a setting scores better on its training rows.
    Gives the winner refitted on all training rows, and (rung, share, place in maps, score) of every evaluation.
    """
    rungs = 1
    while factor ** rungs <= len(maps) and factor ** -rungs >= least:
        rungs += 1
    left, seen, scores = list(range(len(maps))), [], []
    better = 1 if evaluator.isLargerBetter() else -1
    for rung in range(rungs):
        share = float(factor) ** (rung + 1 - rungs)
        rows = train if share == 1 else train.where(hash_share(keys, share))
        scores = _scores(estimator, [maps[i] for i in left], evaluator, rows, valid, parallelism, penalised)
        seen += [(rung, share, i, float(s)) for i, s in zip(left, scores)]
        order = sorted(range(len(left)), key=lambda k: (-better * scores[k], left[k]))
        if rung < rungs - 1:
            order = order[:max(1, -(-len(left) // factor))]
        left, scores = [left[k] for k in order], [scores[k] for k in order]
    best = left[0]
    return SearchResult(estimator.fit(train, maps[best]), maps[best], scores[0], 0.0, scores, [0.0] * len(scores)), seen
