"""Mergeable quantile sketches: one binary per key and day, merged over windows without going back to the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch. The share of rows below an answer is off by less than ERROR (with 99 % confidence) for one sketch
#: or many merged ones alike; keys with fewer rows than SIZE are exact.
SIZE = 400
ERROR = 0.01


def quantile_sketches(df: DataFrame, keys: list[str], columns: list[str], size: int = SIZE) -> DataFrame:
    """keys, and for each column its smallest and largest value, its number of values and a sketch of them.

    Missing values (NULL, NaN) do not count; a key without any has a NULL sketch. Everything here merges.
    """
    aggregates = []
    for c in columns:
        value = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        aggregates += [F.min(value).alias(f"min_{c}"), F.max(value).alias(f"max_{c}"), F.count(value).alias(f"n_{c}"),
                       F.when(F.count(value) > 0, F.kll_sketch_agg_double(value, F.lit(size))).alias(f"sketch_{c}")]
    return df.groupBy(*keys).agg(*aggregates)


def merge_sketches(sketches: DataFrame, keys: list[str], columns: list[str], size: int = SIZE) -> DataFrame:
    """The same table for coarser keys, from its rows alone."""
    aggregates = []
    for c in columns:
        aggregates += [F.min(f"min_{c}").alias(f"min_{c}"), F.max(f"max_{c}").alias(f"max_{c}"), F.sum(f"n_{c}").alias(f"n_{c}"),
                       F.when(F.sum(f"n_{c}") > 0, F.kll_merge_agg_double(f"sketch_{c}", F.lit(size))).alias(f"sketch_{c}")]
    return sketches.groupBy(*keys).agg(*aggregates)


def quantile(column: str, share: float) -> Column:
    """A value of the column that about this share of its rows is at or below; NULL without rows."""
    return F.when(F.col(f"sketch_{column}").isNotNull(), F.kll_sketch_get_quantile_double(F.col(f"sketch_{column}"), F.lit(share)))


def window_quantiles(sketches: DataFrame, asked: DataFrame, on: list[str], day: str, asked_day: str, columns: list[str],
                     shares: dict[str, float], back: int = 0, ahead: int = 0) -> DataFrame:
    """For each asked key and day: min, max, n and quantiles over the days around it, from one sketch a day.

    `shares` names the quantiles, as in {"median": 0.5} for median_<column>. A window without rows gives none.
    """
    ends = F.date_sub(F.to_date(asked_day), back), F.date_add(F.to_date(asked_day), ahead)
    span = abs(back + ahead) + 1

    def stretch(date):
        return F.floor(F.unix_date(date) / span)

    # stretches of days as long as a window: an asked day is copied to the two that its window meets, not to each day of it,
    # and a sketch moves once; what an asked day is copied to is not in the planner's sizes, so neither side is broadcast
    wanted = asked.select(*on, asked_day).distinct().select("*", F.least(*ends).alias("_from"), F.greatest(*ends).alias("_to"))
    wanted = wanted.withColumn("_stretch", F.explode(F.sequence(stretch("_from"), stretch("_to"))))
    placed = sketches.withColumn("_day", F.to_date(day)).drop(day).withColumn("_stretch", stretch("_day"))
    around = wanted.hint("merge").join(placed, [*on, "_stretch"]).where(F.col("_day").between(F.col("_from"), F.col("_to")))
    merged = merge_sketches(around, [*on, asked_day], columns)
    return merged.select(*on, asked_day, *[e for c in columns for e in (
        F.col(f"min_{c}"), F.col(f"max_{c}"), F.col(f"n_{c}"), *[quantile(c, share).alias(f"{name}_{c}") for name, share in shares.items()])])
