"""Linear models from sums: one grouped aggregation gives the fit and the score of every fold, penalty and place.

The sums of products of features and label add up over folds, so a search needs no further pass over rows: a fit solves
the sums of its training fold, and its error on another fold is a quadratic form in that fold's sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.operators.ordering import attach

#: Penalties tried by default, as a share of each feature's own sum of squares.
PENALTIES = (0.0, 0.001, 0.01, 0.1, 1.0)


def _numbers(columns: list[str], gaps: dict[str, float]) -> list[Column]:
    """Columns as doubles; NULL and NaN become the gap's value, if there is one."""
    return [F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), F.lit(gaps.get(c)).cast("double")) for c in columns]


def moments(df: DataFrame, features: list[str], label: str, groups: list[str] = (), gaps: dict[str, float] | None = None,
            shift: dict[str, float] | None = None) -> DataFrame:
    """groups and `sums`, the upper triangle of the products of (1, features, label), over the rows without a gap.

    `gaps` fills missing features; `shift` is taken off features and label first, so that large values do not cancel.
    """
    names = [*features, label]
    shift = shift or {}
    rows = df.select(*groups, *[(c - F.lit(float(shift.get(n, 0.0)))).alias(f"_z{i}") for i, (n, c) in enumerate(zip(names, _numbers(names, gaps or {})))])
    rows = rows.dropna(subset=[f"_z{i}" for i in range(len(names))])
    z = [F.lit(1.0), *[F.col(f"_z{i}") for i in range(len(names))]]
    sums = [F.sum(z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z))]
    return rows.groupBy(*groups).agg(F.array(*sums).alias("sums"))


def square(sums: np.ndarray) -> np.ndarray:
    """Symmetric matrix (or matrices) from upper triangles."""
    size = int((np.sqrt(8 * sums.shape[-1] + 1) - 1) / 2)
    out = np.zeros((*sums.shape[:-1], size, size))
    at = np.triu_indices(size)
    out[..., at[0], at[1]] = sums
    out[..., at[1], at[0]] = sums
    return out


def solve(m: np.ndarray, penalty: float = 0.0) -> np.ndarray:
    """Intercept and coefficients of the rows behind a matrix of sums; dependent features get the smallest ones.

    The penalty adds to each feature its own centred sum of squares times itself and leaves the intercept free.
    """
    n = m[0, 0]
    means = m[0, 1:] / n
    centred = m[1:, 1:] - n * np.outer(means, means)
    gram, cross = centred[:-1, :-1], centred[:-1, -1]
    # features of very different size weigh alike in what counts as dependent
    scale = np.sqrt(np.maximum(np.diag(gram), 0))
    scale[scale == 0] = 1.0
    slopes = np.linalg.pinv(gram / np.outer(scale, scale) + penalty * np.eye(len(gram)), rcond=1e-10, hermitian=True) @ (cross / scale) / scale
    return np.concatenate([[means[-1] - means[:-1] @ slopes], slopes])


def r2(m: np.ndarray, fit: np.ndarray) -> float:
    """Share of the label's variance in the rows behind `m` that the fit explains; NaN without variance."""
    weights = np.concatenate([fit, [-1.0]])
    whole = m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
    return float(1 - weights @ m @ weights / whole) if whole > 0 else float("nan")


@dataclass
class LinearFit:
    """A line over columns, as an expression; gaps in features are filled as when it was fitted."""

    features: list[str]
    intercept: float
    slopes: list[float]
    gaps: dict[str, float] = field(default_factory=dict)
    penalty: float = 0.0
    scores: dict[float, float] = field(default_factory=dict)

    def expression(self) -> Column:
        out = F.lit(float(self.intercept))
        for column, slope in zip(_numbers(self.features, self.gaps), self.slopes):
            out = out + column * F.lit(float(slope))
        return out


def _fold_pairs(folds: list[int]) -> list[tuple[int, int]]:
    return [(f, f + 1) for f in sorted(folds) if f % 2 == 0 and f + 1 in folds]


def fit_by_folds(df: DataFrame, features: list[str], label: str, fold: str, penalties: tuple[float, ...] = PENALTIES) -> LinearFit:
    """The line whose penalty scores best, fitted on all rows with a label; two passes whatever the number of settings.

    Each even fold is fitted and scored on the odd one after it; without such a pair the first penalty is taken. Gaps of
    a feature become its mean over the even folds, a feature without a value there is left out. Ties go to the penalty
    named first.
    """
    known = df.where(F.nanvl(F.col(f"`{label}`").cast("double"), F.lit(None)).isNotNull())
    even = F.col(fold) % 2 == 0
    values = _numbers([*features, label], {})
    means = known.agg(*[F.avg(F.when(even, c)).alias(f"_{i}") for i, c in enumerate(values)], F.avg(values[-1]).alias("_all")).first()
    held = [(f, means[i]) for i, f in enumerate(features) if means[i] is not None]
    features, gaps = [f for f, _ in held], dict(held)
    if means["_all"] is None:
        raise ValueError(f"no row has a value of {label}")
    shift = {**gaps, label: means["_all"]}
    found = {r[fold]: square(np.array(r["sums"], dtype=float)) for r in moments(known, features, label, [fold], gaps, shift).collect()}
    scores = {}
    for penalty in penalties:
        parts = [r2(found[b], solve(found[a], penalty)) for a, b in _fold_pairs([f for f in found if f is not None])]
        parts = [p for p in parts if not np.isnan(p)]
        scores[penalty] = float(np.mean(parts)) if parts else float("nan")
    usable = [p for p in penalties if not np.isnan(scores[p])]
    best = max(usable, key=lambda p: scores[p]) if usable else penalties[0]
    fit = solve(sum(found.values()), best)
    intercept = fit[0] + shift[label] - sum(b * shift[f] for f, b in zip(features, fit[1:]))
    return LinearFit(features, float(intercept), [float(b) for b in fit[1:]], gaps, best, scores)


def fit_by_group(df: DataFrame, features: list[str], label: str, groups: list[str], penalty: float = 0.0) -> DataFrame:
    """groups, intercept and slopes (array) of one line for each group, all from one aggregation.

    Groups are rows of its result, solved where they lie, so their number is not bounded and no job runs for each.
    Rows with a gap in a feature or the label do not count.
    """
    shift = df.agg(*[F.avg(c).alias(f"_{i}") for i, c in enumerate(_numbers([*features, label], {}))]).first()
    shift = {n: shift[i] or 0.0 for i, n in enumerate([*features, label])}
    sums = moments(df, features, label, groups, shift=shift)
    means = np.array([shift[n] for n in [*features, label]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
            fits = [solve(m, penalty) for m in square(flat.reshape(b.num_rows, -1))] if b.num_rows else []
            intercepts = [f[0] + means[-1] - f[1:] @ means[:-1] for f in fits]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(intercepts, pa.float64()), pa.array([f[1:].tolist() for f in fits], pa.list_(pa.float64()))],
                                             names=[*b.schema.names[:-1], "intercept", "slopes"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema.fields[:-1])
    return sums.mapInArrow(run, f"{kinds}, intercept double, slopes array<double>")


def predict_by_group(df: DataFrame, fits: DataFrame, features: list[str], groups: list[str], prediction: str = "prediction") -> DataFrame:
    """`df` with each row's prediction by its group's line; NULL for a group without one, or a gap in a feature."""
    known = attach(df, fits.select(*groups, F.col("intercept").alias("_intercept"), F.col("slopes").alias("_slopes")), groups)
    out = F.col("_intercept")
    for i, c in enumerate(_numbers(features, {})):
        out = out + c * F.col("_slopes")[i]
    return known.withColumn(prediction, out).drop("_intercept", "_slopes")
