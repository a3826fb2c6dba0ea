"""Jobs keyed by ground station, and the scoring report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.constants import DEPLOYED_FEATURES, DEPTH_BANDS, GFS_VARIABLES, SIBLING_STATISTICS, SLOTS
from airgrid.functions.features import (
    aqi_class, aqi_hit, calendar_parts, scaled_aod, selected_slots, slot_mean, wind_speed,
)
from airgrid.functions.geo import city_code, rounded_key, unshift_longitude
from airgrid.learning.models import retrain_and_predict
from airgrid.learning.prepare import encode_labels, impute_means
from airgrid.operators.aggregates import band_min_max_median, class_hit_rate, mean_by, mean_error, station_days
from airgrid.operators.clean import casts, nonfinite_to_null, valid_labels
from airgrid.operators.joins import box_join, cells_in_boxes, dimension_join, equi_join, interval_means, latest_value_lookup
from airgrid.operators.ordering import attach
from airgrid.operators.raster import elevation_summary
from airgrid.operators.sets import stack
from airgrid.operators.splits import named_split, time_split
from airgrid.operators.windows import day_difference_lags, trailing_means
from airgrid.session import settle

STATION_KEYS = ["location", "parameter", "country", "city", "latitude", "longitude"]
# the coordinate alone, as in the original job: stations at one place then share a series and tie by day
SERIES_KEYS = ["city", "latitude", "longitude"]


def station_series(records: DataFrame, keys: list[str] = STATION_KEYS, series: list[str] = STATION_KEYS) -> DataFrame:
    """Daily station labels with lags of the value and of its daily change.

    One row per station and day after the daily mean, so a series is as long as the calendar and
    its days are unique. `SERIES_KEYS` lags by place instead.
    """
    coded = valid_labels(records).withColumn("city", city_code(F.col("city")))
    return day_difference_lags(station_days(coded, keys), series, "date_utc")


def forecast_history(parts: list[DataFrame], shifted: bool = True) -> DataFrame:
    """Forecast histories as one table: coordinates of any type as numbers, columns by position, longitudes of 0..360 unshifted."""
    numbers = [casts(p, {"latitude": "double", "longitude": "double"}) for p in parts]
    whole = stack(*numbers, by_position=True)
    return whole.withColumn("longitude", unshift_longitude(F.col("longitude"))) if shifted else whole


def station_table(labels: DataFrame, aerosol: DataFrame, elevation: DataFrame, forecasts: DataFrame, radius: float,
                  value: str = "Optical_Depth_047") -> DataFrame:
    """Station days with aerosol mean of the last day, elevation, and the strongest forecast nearby.

    Readings are summed per time before they meet the labels. Points within the box are matched
    once per pair of places, not per day, and the forecast maxima are taken in the scan's own task.
    """
    def keyed(df):
        return df.withColumns({"_y": rounded_key(F.col("latitude")), "_x": rounded_key(F.col("longitude"))})

    read = interval_means(keyed(labels), keyed(aerosol).select("_y", "_x", "aod_reading_time", value),
                          ["_y", "_x"], "datetime_utc", "aod_reading_time", [value], back=1, mode="calendar")
    # read three times below: for the places, the days and the result
    raised = settle(read.drop("_y", "_x").join(elevation, ["latitude", "longitude"], "left"))

    days = raised.select("latitude", "longitude", "date_utc", F.hour("datetime_utc").alias("_hour")).distinct()
    places = box_join(days.select("latitude", "longitude").distinct(),
                      forecasts.select("latitude", "longitude").distinct(), radius, how="inner")
    asked = days.join(places, ["latitude", "longitude"])
    asked = asked.select("*", F.explode(F.array(F.col("date_utc"), F.date_add("date_utc", 1))).alias("date"))
    points = forecasts.withColumnsRenamed({"latitude": "right_latitude", "longitude": "right_longitude"})
    near = asked.join(points, ["right_latitude", "right_longitude", "date"])
    keys = ["latitude", "longitude", "date_utc", "_hour"]
    strongest = near.select(*keys, *selected_slots(F.col("date_utc"), F.col("_hour"), F.col("date"))) \
        .groupBy(*keys).agg(*[F.max(v + s).alias(v + s) for s in SLOTS for v in GFS_VARIABLES])
    return attach(raised.withColumn("_hour", F.hour("datetime_utc")), strongest, keys).drop("_hour")


def deployed_features(table: DataFrame, station: list[str], date: str, scaled: list[str],
                      trailing: list[str]) -> DataFrame:
    """The deployed model's features: calendar, scaled aerosol, trailing means, slot means, wind."""
    out = table.select(
        "*", *calendar_parts(F.col(date)),
        *[scaled_aod(F.col(c)).alias(c + "_scaled") for c in scaled],
        *[slot_mean(v).alias(v) for v in GFS_VARIABLES])
    out = out.withColumn("wind_speed", wind_speed(F.col("u_pbl"), F.col("v_pbl")))
    out = trailing_means(out, station, date, [c + "_scaled" for c in trailing], [1])
    return nonfinite_to_null(out)


def deployed_inputs(features: DataFrame, date: str, numeric: list[str], text: list[str], split=named_split,
                    ) -> dict[str, DataFrame]:
    """Training, validation and test rows by time, gaps filled and texts coded as the training rows say."""
    # read by both fits and once for each part
    marked = settle(time_split(features, date, split))
    names = ("train", "valid", "test")
    parts = [marked.where(F.col("Set") == n) for n in names]
    filled = impute_means(parts[0], parts[1:], numeric, text)
    coded = encode_labels(filled[0], filled[1:], text) if text else filled
    return dict(zip(names, coded))


def deployed_projection(features: DataFrame) -> DataFrame:
    """Only the features the deployed model reads, with label and date."""
    return features.select(*DEPLOYED_FEATURES)


def deployed_table(labels: DataFrame, cells: DataFrame, angles: DataFrame, forecasts: DataFrame, elevation: DataFrame,
                   key: str = "grid_id", date: str = "date") -> DataFrame:
    """The deployed model's table end to end: one row per label and day with its 25 features, label and date.

    Depths are the minimum, maximum and median of a day's cells, multi-angle values and forecasts the day's means;
    depths are scaled to particulates, and the scaled ones of the first band get their mean of the last day. `labels`
    has one row per key and day; all tables share the names of key and date.
    """
    by = [key, date]

    def asked(df: DataFrame) -> DataFrame:
        """Rows of the labels' keys and days; as IN, this goes below the aggregations that `df` may come from."""
        return df.where(F.struct(*by).isin(labels.select(*by)))

    depths = [f"{s}_{b}" for b in DEPTH_BANDS for s in SIBLING_STATISTICS]
    table = equi_join(labels.select(*by, "value"), band_min_max_median(asked(cells), by, DEPTH_BANDS).select(*by, *depths), by)
    table = equi_join(table, mean_by(asked(angles), by, ["Aerosol_Optical_Depth", "Angstrom_Exponent_550_860nm"]), by)
    table = equi_join(table, mean_by(asked(forecasts), by, [v + s for s in SLOTS for v in GFS_VARIABLES]), by)
    table = dimension_join(table, elevation, [key])
    features = deployed_features(table, [key], date, [*depths, "Aerosol_Optical_Depth"], depths[:len(SIBLING_STATISTICS)])
    return deployed_projection(features.withColumn("pm25_date_d", F.col(date)))


def point_elevations(points: DataFrame, raster: DataFrame, half_width: float, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Each distinct point with the least, greatest and mean elevation of the raster cells (lat, lon, elevation) around it."""
    places = points.select(lat, lon).distinct().where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    boxes = places.select("*", *[(F.col(c).cast("double") + d).alias(n) for n, c, d in (
        ("min_lon", lon, -half_width), ("max_lon", lon, half_width), ("min_lat", lat, -half_width), ("max_lat", lat, half_width))])
    around = cells_in_boxes(raster.select("lat", "lon", "elevation"), boxes, tile=4 * half_width)
    return dimension_join(places, elevation_summary(around, [lat, lon], "elevation", percentiles=False), [lat, lon])


def scoring_report(scored: DataFrame, prediction: str = "prediction", actual: str = "actual") -> dict[str, DataFrame]:
    """Row classes, hit rate per class and mean errors of predictions."""
    rows = scored.select(
        "*", aqi_class(F.col(prediction)).alias("predicted_aqi"), aqi_class(F.col(actual)).alias("actual_aqi"),
        aqi_hit(F.col(actual), F.col(prediction)).alias("aqi_hit"))
    return {"rows": rows, "hits": class_hit_rate(rows), "errors": mean_error(rows, prediction, actual)}


def predict_and_report(train: DataFrame, held_out: DataFrame, estimator, params: dict, keys: list[str],
                       label: str = "value") -> dict[str, DataFrame]:
    """Refit on all training rows, predict the held-out ones, and score the predictions."""
    predicted = retrain_and_predict(train, held_out, estimator, params, [*keys, label])
    return scoring_report(predicted.withColumnRenamed(label, "actual"))


def point_answers(requests: DataFrame, series: DataFrame, date: str = "date_utc", digits: int = 2) -> DataFrame:
    return latest_value_lookup(requests, series, date, digits=digits)
