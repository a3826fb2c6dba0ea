"""Unions and ordered output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack(*frames: DataFrame, by_position: bool = False, allow_missing: bool = False) -> DataFrame:
    """All rows of all frames, matched by column name unless asked by position."""
    if by_position:
        return reduce(DataFrame.union, frames)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def ordered(df: DataFrame, *columns: str, descending: bool = False) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c in columns])


def top(df: DataFrame, n: int, column: str, tie: list[str] = (), descending: bool = True) -> DataFrame:
    """The n first rows by a column, ties broken by `tie`."""
    return df.orderBy(F.col(column).desc() if descending else F.col(column).asc(), *tie).limit(n)
