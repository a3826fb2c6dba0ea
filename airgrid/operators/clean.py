"""Filters, sentinel handling and column housekeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid.constants import LABEL_MAX_INCLUSIVE, LABEL_MIN_EXCLUSIVE, SLOTS


def _floating(df: DataFrame, columns=None) -> list[str]:
    wanted = set(columns or df.columns)
    return [f.name for f in df.schema.fields
            if f.name in wanted and isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def valid_labels(df: DataFrame, column: str = "value", low: float = LABEL_MIN_EXCLUSIVE,
                 high: float = LABEL_MAX_INCLUSIVE) -> DataFrame:
    return df.where((F.col(column) > low) & (F.col(column) <= high))


def out_of_range(df: DataFrame, columns: list[str], low: float = LABEL_MIN_EXCLUSIVE,
                 high: float = LABEL_MAX_INCLUSIVE) -> DataFrame:
    """Rows with any column below `low`, and with any above `high`, in one pass."""
    below = above = F.lit(False)
    for c in columns:
        below, above = below | (F.col(c) < low), above | (F.col(c) > high)
    return df.agg(F.count_if(below).alias("n_below"), F.count_if(above).alias("n_above"))


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop(subset=list(columns))


def mask_bands(df: DataFrame, bands: list[str], keep: Column) -> DataFrame:
    """Set the bands to NULL where `keep` does not hold; rows stay."""
    return df.withColumns({b: F.when(keep, F.col(b)) for b in bands})


def sentinel_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """-inf to NULL."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(float("-inf")).cast(df.schema[c].dataType))
                           for c in _floating(df, columns)})


def nonfinite_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """+inf, -inf and NaN to NULL, in every floating column by default."""
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
                           for c in _floating(df, columns)})


def strip_aggregate_names(df: DataFrame) -> DataFrame:
    """`max(avg(x))` to `x`."""
    names = {}
    for c in df.columns:
        bare = c
        while "(" in bare and bare.endswith(")"):
            bare = bare[bare.index("(") + 1:-1]
        names[c] = bare
    return df.withColumnsRenamed(names)


def rename_slot(df: DataFrame, templates: list[str], slot: str, placeholder: str = "XX", suffix: str = "") -> DataFrame:
    """Columns named by template with the slot filled in lose the slot."""
    return df.withColumnsRenamed({t.replace(placeholder, slot): t.replace(placeholder, suffix) for t in templates})


def drop_slots(df: DataFrame, templates: list[str], slots=tuple(SLOTS), placeholder: str = "XX") -> DataFrame:
    return df.drop(*[t.replace(placeholder, s) for t in templates for s in slots])


def slot_columns(df: DataFrame, slot: str) -> list[str]:
    return [c for c in df.columns if c.endswith(slot)]


def feature_columns(df: DataFrame, drop: list[str] = (), label: str | None = None) -> tuple[list, list, list]:
    """All, numeric and text feature names; arrays and other nested columns are neither."""
    fields = [f for f in df.schema.fields if f.name not in drop and f.name != label]
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    return [f.name for f in fields if f.name in {*numeric, *text}], numeric, text


def casts(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast columns; text that does not parse gives NULL."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def _long(df: DataFrame, counts: dict[str, Column], value: str) -> DataFrame:
    one = df.agg(*[v.alias(k) for k, v in counts.items()])
    return one.unpivot([], list(counts), "column", value)


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count of NULL or NaN per column."""
    floating = set(_floating(df))
    return _long(df, {c: F.count_if(F.col(c).isNull() | F.isnan(c) if c in floating else F.col(c).isNull())
                      for c in columns or df.columns}, "n_missing")


def sentinel_profile(df: DataFrame, columns: list[str] | None = None, sentinel: float = float("-inf")) -> DataFrame:
    """Count of sentinel values per floating column."""
    return _long(df, {c: F.count_if(F.col(c) == sentinel) for c in _floating(df, columns)}, "n_sentinel")


def nonfinite_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count of NaN and infinite values per floating column."""
    return _long(df, {c: F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))) for c in _floating(df, columns)},
                 "n_nonfinite")


def assert_finite(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The frame itself, once no floating column holds NaN or an infinity."""
    bad = {r["column"]: r["n_nonfinite"] for r in nonfinite_profile(df, columns).where("n_nonfinite > 0").collect()}
    if bad:
        raise ValueError(f"non-finite values: {bad}")
    return df


def fill_with_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL to the column's own mean."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return df.fillna({c: means[c] for c in columns if means[c] is not None})


def mismatches(df: DataFrame, left: str, right: str) -> DataFrame:
    """How many rows carry two different values."""
    return df.agg(F.count_if(F.col(left) != F.col(right)).alias("n_mismatch"))
