"""Scalar features."""

from pyspark.sql import functions as F

from airgrid.constants import GFS_VARIABLES, SLOTS
from airgrid.functions import features as X
from bindings.registry import d_text, query, r6, rounded, ts_text


@query("feat_calendar_parts", """
       SELECT event_id, day(ts) AS day_of_month, dayofweek(ts) + 1 AS day_of_week, dayofyear(ts) AS day_of_year,
              week(ts) AS week_of_year, month(ts) AS month, year(ts) AS year FROM {events}""")
def _(t):
    return t.events.select("event_id", *X.calendar_parts(F.col("ts")))


@query("feat_conversions", f"""
       SELECT label_id, {d_text('datetime')} AS day, strftime(datetime, '%Y-%m-%d') AS day_text,
              {ts_text('datetime')} AS stamp FROM {{labels_grid}}""")
def _(t):
    iso = t.labels_grid.select("label_id", F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))
    return iso.select("label_id", F.to_date("iso").alias("day"),
                      F.date_format(F.to_timestamp("iso"), "yyyy-MM-dd").alias("day_text"),
                      F.to_timestamp("iso").alias("stamp"))


@query("feat_date_arithmetic", f"""
       SELECT label_id, {d_text("datetime + INTERVAL '1' DAY")} AS next_day, {d_text("datetime - INTERVAL '1' DAY")} AS day_before,
              hour(datetime) AS hour FROM {{labels_grid}}""")
def _(t):
    return t.labels_grid.select("label_id", F.date_add("datetime", 1).alias("next_day"),
                                F.date_sub("datetime", 1).alias("day_before"), F.hour("datetime").alias("hour"))


@query("feat_iso_date", """
       SELECT label_id, strftime(datetime, '%Y-%m-%d') AS utc_date, year(datetime) AS utc_year, month(datetime) AS utc_month
       FROM {labels_grid}""")
def _(t):
    iso = t.labels_grid.select("label_id", F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))
    return iso.select("label_id", X.iso_date_text("iso").alias("utc_date"), *X.iso_year_month("iso"))


@query("feat_scaled_aod", f"""
       SELECT index, {r6('CASE WHEN Optical_Depth_047 <> 0 THEN 46.759e0 * Optical_Depth_047 + 7.1333e0 END')} AS scaled
       FROM {{aod_cells}}""")
def _(t):
    return rounded(t.aod_cells.select("index", X.scaled_aod(F.col("Optical_Depth_047")).alias("scaled")), "scaled")


def _sum(v):
    return " + ".join(f"coalesce({v}{s}, 0)" for s in SLOTS)


def _used(v):
    return " + ".join(f"CASE WHEN {v}{s} IS NOT NULL THEN 1 ELSE 0 END" for s in SLOTS)


_KEY = "grid_id, CAST(date AS VARCHAR) AS date, latitude"


@query("feat_slot_mean", f"SELECT {_KEY}, " + ", ".join(f"({_sum(v)}) / 4 AS {v}" for v in GFS_VARIABLES) + " FROM {gfs}")
def _(t):
    return t.gfs.select("grid_id", "date", "latitude", *[X.slot_mean(v).alias(v) for v in GFS_VARIABLES])


@query("feat_slot_mean_strict", f"SELECT {_KEY}, " + ", ".join(
    f"({' + '.join(v + s for s in SLOTS)}) / 4 AS {v}_merged" for v in GFS_VARIABLES) + " FROM {gfs}")
def _(t):
    return t.gfs.select("grid_id", "date", "latitude",
                        *[X.slot_mean(v, "strict").alias(v + "_merged") for v in GFS_VARIABLES])


@query("feat_slot_mean_skip_null", f"SELECT {_KEY}, " + ", ".join(
    f"({_sum(v)}) / nullif({_used(v)}, 0) AS {v}" for v in GFS_VARIABLES) + " FROM {gfs}")
def _(t):
    return t.gfs.select("grid_id", "date", "latitude", *[X.slot_mean(v, "skip_null").alias(v) for v in GFS_VARIABLES])


@query("feat_wind_speed", f"SELECT {_KEY}, " + ", ".join(
    f"{r6(f'sqrt(u_pbl{s} * u_pbl{s} + v_pbl{s} * v_pbl{s})')} AS wind_speed{s}" for s in SLOTS) + " FROM {gfs}")
def _(t):
    names = [f"wind_speed{s}" for s in SLOTS]
    return rounded(t.gfs.select("grid_id", "date", "latitude", *[
        X.wind_speed(F.col("u_pbl" + s), F.col("v_pbl" + s)).alias(n) for s, n in zip(SLOTS, names)]), *names)


@query("feat_intraday_change", f"""SELECT {_KEY}, pbl_surface18 - pbl_surface00 AS change_in_pbl_surface,
       t_surface18 - t_surface00 AS change_in_t_surface, v_pbl18 - v_pbl00 AS change_in_v_pbl,
       vrate_pbl18 - vrate_pbl00 AS change_in_vrate_pbl FROM {{gfs}}""")
def _(t):
    return t.gfs.select("grid_id", "date", "latitude", *X.intraday_changes())


@query("feat_elevation_range", "SELECT grid_id, max_elevation - min_elevation AS elevation_range FROM {elevation}")
def _(t):
    return t.elevation.select("grid_id", X.elevation_range().alias("elevation_range"))


def aqi_sql(c):
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} <= 30 THEN 'Good' WHEN {c} <= 60 THEN 'Satisfactory' "
            f"WHEN {c} <= 90 THEN 'Moderately Polluted' WHEN {c} <= 120 THEN 'Poor' WHEN {c} <= 250 THEN 'Very Poor' "
            f"ELSE 'Severe' END")


@query("feat_aqi_class", f"SELECT event_id, value, {aqi_sql('value')} AS aqi FROM {{labels_station}}")
def _(t):
    return t.labels_station.select("event_id", "value", X.aqi_class(F.col("value")).alias("aqi"))


@query("feat_aqi_hit", f"""SELECT l_orderkey, l_linenumber, l_partkey, prediction,
       CAST({aqi_sql('prediction')} = {aqi_sql('actual')} AS INT) AS aqi_hit FROM {{scored}}""")
def _(t):
    return t.scored.select("l_orderkey", "l_linenumber", "l_partkey", "prediction",
                           X.aqi_hit(F.col("actual"), F.col("prediction")).alias("aqi_hit"))


@query("feat_with_imputed", "SELECT index, coalesce(Optical_Depth_047, FineModeFraction) AS Optical_Depth_047 FROM {aod_cells}")
def _(t):
    cells = t.aod_cells.withColumn("Optical_Depth_047_imputed", F.col("FineModeFraction"))
    return cells.select("index", X.with_imputed("Optical_Depth_047"))


@query("feat_array_access", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS second, CAST(NULL AS DOUBLE) AS ninth
       FROM {lineitem}""")
def _(t):
    built = t.lineitem.withColumn("a", F.array("l_tax", "l_quantity"))
    return built.select("l_orderkey", "l_linenumber", "l_partkey", F.try_element_at("a", F.lit(2)).alias("second"),
                        F.get("a", 8).alias("ninth"))


@query("feat_constant_prediction", "SELECT label_id, value, 0e0 AS prediction FROM {labels_grid}")
def _(t):
    from airgrid.learning.scores import constant_baseline

    return constant_baseline(t.labels_grid.select("label_id", "value"))
