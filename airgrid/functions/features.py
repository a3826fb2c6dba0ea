"""Feature expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airgrid.constants import (
    AOD_INTERCEPT, AOD_SLOPE, AQI_BOUNDS, AQI_TOP, CHANGE_VARIABLES, GFS_VARIABLES, SLOTS,
)


def calendar_parts(date) -> list[Column]:
    """Day of month, day of week (1 = Sunday), day of year, ISO week, month, year."""
    return [
        F.dayofmonth(date).alias("day_of_month"),
        F.dayofweek(date).alias("day_of_week"),
        F.dayofyear(date).alias("day_of_year"),
        F.weekofyear(date).alias("week_of_year"),
        F.month(date).alias("month"),
        F.year(date).alias("year"),
    ]


def iso_date_text(text) -> Column:
    """The date part of an ISO time text."""
    return F.substring_index(text, "T", 1)


def iso_year_month(text) -> list[Column]:
    date = F.to_date(iso_date_text(text))
    return [F.year(date).alias("utc_year"), F.month(date).alias("utc_month")]


def epoch_ms(column) -> Column:
    return F.timestamp_millis(column)


def scaled_aod(x) -> Column:
    """Aerosol optical depth to particulate mass; NULL and 0 give NULL."""
    return F.when(x != 0, AOD_SLOPE * x + AOD_INTERCEPT)


def slot_mean(variable: str, mode: str = "len") -> Column:
    """Mean of the four forecast slots of a variable.

    `len`: missing counts as 0, always divided by the number of slots. `strict`: NULL when any
    slot is missing. `skip_null`: mean of the slots that are not missing.
    """
    parts = [F.col(variable + s) for s in SLOTS]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    if mode == "len":
        return total / len(SLOTS)
    if mode == "strict":
        return sum(parts[1:], parts[0]) / len(SLOTS)
    if mode == "skip_null":
        used = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
        return total / F.nullif(used, F.lit(0))
    raise ValueError(f"unknown mode {mode!r}")


def slot_applies(slot: str, label_date, label_hour, forecast_date) -> Column:
    """True when this slot of this forecast day is the first one after the label starts."""
    hour = int(slot)
    return ((forecast_date == label_date) & (label_hour < hour)) | (
        (forecast_date > label_date) & (label_hour >= hour))


def selected_slots(label_date, label_hour, forecast_date, variables=GFS_VARIABLES, slots=SLOTS) -> list[Column]:
    """Each slot column where it applies, else NULL."""
    return [
        F.when(slot_applies(s, label_date, label_hour, forecast_date), F.col(v + s)).alias(v + s)
        for s in slots for v in variables
    ]


def wind_speed(u, v) -> Column:
    return F.hypot(u, v)


def intraday_changes(variables=CHANGE_VARIABLES) -> list[Column]:
    """Last slot minus first slot."""
    return [(F.col(v + SLOTS[-1]) - F.col(v + SLOTS[0])).alias("change_in_" + v) for v in variables]


def elevation_range(low: str = "min_elevation", high: str = "max_elevation") -> Column:
    return F.col(high) - F.col(low)


def aqi_class(value) -> Column:
    """Air-quality class; missing stays missing."""
    out = F.lit(AQI_TOP)
    for bound, name in reversed(AQI_BOUNDS):
        out = F.when(value <= bound, name).otherwise(out)
    return F.when(value.isNotNull() & ~F.isnan(value), out)


def aqi_hit(actual, predicted) -> Column:
    return (aqi_class(actual) == aqi_class(predicted)).cast("int")


def with_imputed(column: str) -> Column:
    return F.coalesce(F.col(column), F.col(column + "_imputed")).alias(column)


def by_cuts(rank, cuts, last) -> Column:
    """First value whose cut the rank is below, else `last`; `cuts` is [(cut, value)] ascending."""
    out = F.lit(last)
    for cut, value in reversed(list(cuts)):
        out = F.when(rank < cut, value).otherwise(out)
    return out
