"""Train, validation and test sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.constants import OUTER_EDGE_CUTS, SIX_FOLD_CUTS
from airgrid.functions.features import by_cuts
from airgrid.operators.ordering import percent_rank


def six_folds(rank: Column) -> Column:
    """Folds 0..11 by time rank: even ones train, the odd one after each validates."""
    return by_cuts(rank, [(cut, i) for i, cut in enumerate(SIX_FOLD_CUTS)], len(SIX_FOLD_CUTS))


def two_way(rank: Column, cut: float) -> Column:
    """0 below the cut, else 1."""
    return by_cuts(rank, [(cut, 0)], 1)


def named_split(rank: Column) -> Column:
    return by_cuts(rank, [(0.8, "train"), (0.9, "valid")], "test")


def outer_edge_split(rank: Column) -> Column:
    return by_cuts(rank, OUTER_EDGE_CUTS, "test")


def nested_splits(rank: Column) -> tuple[Column, Column]:
    """Two splits, one over the first half of the time and one over all of it."""
    first = F.when(rank < 0.4, "train").when(rank < 0.45, "valid").when(rank <= 0.5, "test")
    return first, named_split(rank)


def interleaved_split(rank: Column, rounds: int = 10) -> Column:
    """Each tenth of the time: eight parts train, one valid, one test; the last rank is test."""
    cuts = []
    for i in range(rounds):
        cuts += [((10 * i + part) / (10 * rounds), name) for part, name in ((8, "train"), (9, "valid"), (10, "test"))]
    return by_cuts(rank, cuts[:-1], "test")


def hash_share(key: Column, seed: int) -> Column:
    """Even number in [0, 1) fixed by the key's text and the seed."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(2 ** 32))


def random_split(key: Column, seed: int = 42, shares=(0.8, 0.1, 0.1), names=("train", "valid", "test")) -> Column:
    """Set by the hash of a key: a date keeps its rows together, a row key splits rows.

    A function of the key alone: no shuffle, and the same answer on any partitioning.
    """
    total, cuts = 0.0, []
    for share, name in zip(shares[:-1], names):
        total = math.fsum((total, share))
        cuts.append((total, name))
    return by_cuts(hash_share(key, seed), cuts, names[-1])


def calendar_split(date: Column, first_test_day: str) -> Column:
    return F.when(date < F.lit(first_test_day).cast("date"), "train").otherwise("test")


def time_split(df: DataFrame, date: str, split, alias: str = "Set", keep_rank: bool = False, **kwargs) -> DataFrame:
    """Add `split(rank)` of the row's time rank."""
    ranked = percent_rank(df, date, "_rank", **kwargs)
    out = ranked.withColumn(alias, split(F.col("_rank")))
    return out.withColumnRenamed("_rank", "rank") if keep_rank else out.drop("_rank")


def nested_time_split(df: DataFrame, date: str, alias: str = "Set") -> DataFrame:
    """Both nested splits as columns <alias>_1 and <alias>_2."""
    ranked = percent_rank(df, date, "_rank")
    first, second = nested_splits(F.col("_rank"))
    return ranked.withColumns({f"{alias}_1": first, f"{alias}_2": second}).drop("_rank")
