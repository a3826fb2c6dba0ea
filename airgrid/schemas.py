"""Explicit schemas of the tables the jobs read."""

from pyspark.sql import types as T

from airgrid.constants import AOD_BANDS, GFS_VARIABLES, MISR_VARIABLES, SLOTS


def _aod(*tail: str) -> T.StructType:
    fields = [T.StructField("index", T.LongType()), T.StructField("lon", T.FloatType()),
              T.StructField("lat", T.FloatType())]
    fields += [T.StructField(b, T.FloatType()) for b in AOD_BANDS]
    fields += [T.StructField("AOD_QA", T.IntegerType()), T.StructField("grid_id", T.StringType())]
    return T.StructType(fields + [T.StructField(c, T.StringType()) for c in tail])


AOD_BY_DATE = _aod("utc_date")
AOD_BY_LABEL = _aod("aod_reading_end", "pm25_reading_date")
AOD_BY_LOCATION = _aod("aod_reading_end", "location")

GRIDS = T.StructType([T.StructField(c, T.StringType()) for c in ("grid_id", "location", "tz", "wkt")])

LABELS_GRID = T.StructType([
    T.StructField("datetime", T.StringType()),
    T.StructField("grid_id", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("location", T.StringType()),
    T.StructField("tz", T.StringType()),
    T.StructField("wkt", T.StringType()),
])

MISR = T.StructType(
    [T.StructField(v, T.DoubleType()) for v in MISR_VARIABLES]
    + [T.StructField(c, T.StringType()) for c in ("grid_id", "misr_reading_end", "pm25_reading_date")]
)

GFS = T.StructType(
    [T.StructField("date", T.StringType()), T.StructField("grid_id", T.StringType()),
     T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())]
    + [T.StructField(v + s, T.DoubleType()) for s in SLOTS for v in GFS_VARIABLES]
)

GEOS = T.StructType(
    [T.StructField("time", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in ("lat", "lon", "lev")]
    + [T.StructField("grid_id", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("pm25_rh35_gcc", "co", "no2", "o3", "so2")]
)

SUBMISSION = T.StructType([
    T.StructField("grid_id", T.StringType()),
    T.StructField("datetime", T.StringType()),
    T.StructField("value", T.DoubleType()),
])
