"""Joins on equal keys, time intervals, forecast days and boxes."""

from pyspark.sql import functions as F

from airgrid.constants import GFS_VARIABLES, NO_DATA_ANSWER, SLOTS
from airgrid.operators import joins as J
from airgrid.operators.aggregates import mean_by
from airgrid.operators.lookup import LatestValues
from bindings.registry import d_text, query, ts_text

_FEW = [v + s for s in SLOTS for v in GFS_VARIABLES[:2]]


@query("jn_left", f"""
       SELECT label_id, value, l.AOD_Uncertainty FROM {{labels_grid}} g
       LEFT JOIN {{aod_cells}} l ON g.grid_id = l.grid_id AND g.datetime = l.aod_reading_end""")
def _(t):
    cells = t.aod_cells.select("grid_id", F.col("aod_reading_end").alias("datetime"), "AOD_Uncertainty")
    return J.equi_join(t.labels_grid, cells, ["grid_id", "datetime"]).select("label_id", "value", "AOD_Uncertainty")


@query("jn_inner", """
       SELECT label_id, index FROM {labels_grid} g JOIN {aod_cells} l ON g.grid_id = l.grid_id AND g.date = l.utc_date""")
def _(t):
    cells = t.aod_cells.select("grid_id", F.col("utc_date").alias("date"), "index")
    return J.equi_join(t.labels_grid, cells, ["grid_id", "date"], "inner").select("label_id", "index")


@query("jn_dimension", "SELECT label_id, min_elevation FROM {labels_grid} LEFT JOIN {elevation} USING (grid_id)")
def _(t):
    return J.dimension_join(t.labels_grid, t.elevation, ["grid_id"]).select("label_id", "min_elevation")


@query("jn_right", """
       SELECT label_id, g.value, n FROM (SELECT grid_id, utc_date, count(*) AS n FROM {aod_cells} GROUP BY 1, 2) c
       RIGHT JOIN {labels_grid} g ON c.grid_id = g.grid_id AND c.utc_date = g.date""")
def _(t):
    cells = t.aod_cells.groupBy("grid_id", F.col("utc_date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return J.equi_join(cells, t.labels_grid, ["grid_id", "date"], "right").select("label_id", "value", "n")


@query("jn_full_misr", f"""
       SELECT coalesce(g.grid_id, m.grid_id) AS grid_id, {ts_text('coalesce(g.datetime, m.datetime)')} AS datetime,
              label_id, m.depth FROM {{labels_grid}} g
       FULL JOIN (SELECT grid_id, datetime, avg(Aerosol_Optical_Depth) AS depth FROM {{misr}} GROUP BY 1, 2) m
         ON g.grid_id = m.grid_id AND g.datetime = m.datetime""")
def _(t):
    means = mean_by(t.misr, ["grid_id", "datetime"], ["Aerosol_Optical_Depth"]) \
        .withColumnRenamed("Aerosol_Optical_Depth", "depth")
    return J.equi_join(t.labels_grid, means, ["grid_id", "datetime"], "full") \
        .select("grid_id", "datetime", "label_id", "depth")


def _interval_sql(low, high, how="LEFT"):
    return f"""
       SELECT label_id, {ts_text('r.time')} AS time, r.co FROM {{labels_grid}} g
       {how} JOIN {{geos}} r ON g.grid_id = r.grid_id AND r.time >= {low} AND r.time <= {high}"""


def _interval(t, **how):
    joined = J.interval_join(t.labels_grid, t.geos.select("grid_id", "time", "co"), ["grid_id"], "datetime", "time", **how)
    return joined.select("label_id", "time", "co")


@query("jn_look_back_calendar", _interval_sql("date_trunc('day', g.datetime) - INTERVAL '1' DAY", "g.datetime"))
def _(t):
    return _interval(t, back=1, mode="calendar")


@query("jn_look_back_exact", _interval_sql("g.datetime - INTERVAL '24' HOUR", "g.datetime", "INNER"))
def _(t):
    return _interval(t, back=1, mode="exact", how="inner")


@query("jn_look_ahead_exact", _interval_sql("g.datetime", "g.datetime + INTERVAL '24' HOUR", "INNER"))
def _(t):
    return _interval(t, ahead=1, mode="exact", how="inner")


@query("jn_day_either_side", _interval_sql("date_trunc('day', g.datetime) - INTERVAL '1' DAY",
                                           "date_trunc('day', g.datetime) + INTERVAL '1' DAY"))
def _(t):
    return _interval(t, back=1, ahead=1, mode="calendar")


@query("jn_rounded_look_back", f"""
       SELECT l.event_id, r.reading FROM {{labels_station}} l
       LEFT JOIN (SELECT event_id AS reading, * EXCLUDE (event_id) FROM {{aod_ee}}) r
         ON round(l.latitude, 2) = round(r.latitude, 2) AND round(l.longitude, 2) = round(r.longitude, 2)
        AND r.aod_reading_time <= l.datetime_utc
        AND r.aod_reading_time >= date_trunc('day', l.datetime_utc) - INTERVAL '1' DAY""")
def _(t):
    readings = t.aod_ee.select(F.col("event_id").alias("reading"), "latitude", "longitude", "aod_reading_time")
    return J.rounded_interval_join(t.labels_station, readings, "datetime_utc", "aod_reading_time", back=1,
                                   mode="calendar").select("event_id", "reading")


@query("jn_interval_means", """
       SELECT label_id, avg(r.pm25_rh35_gcc) AS avg_pm25_rh35_gcc, avg(r.co) AS avg_co FROM {labels_grid} g
       LEFT JOIN {geos} r ON g.grid_id = r.grid_id AND r.time <= g.datetime
        AND r.time >= date_trunc('day', g.datetime) - INTERVAL '1' DAY GROUP BY label_id""")
def _(t):
    return J.interval_means(t.labels_grid, t.geos, ["grid_id"], "datetime", "time", ["pm25_rh35_gcc", "co"],
                            back=1, mode="calendar").select("label_id", "avg_pm25_rh35_gcc", "avg_co")


@query("jn_interval_means_week", """
       SELECT label_id, avg(r.co) AS avg_co FROM {labels_grid} g
       LEFT JOIN {geos} r ON g.grid_id = r.grid_id AND r.time <= g.datetime + INTERVAL '1' DAY
        AND r.time >= g.datetime - INTERVAL '6' DAY GROUP BY label_id""")
def _(t):
    return J.interval_means(t.labels_grid, t.geos, ["grid_id"], "datetime", "time", ["co"], back=6, ahead=1,
                            mode="exact").select("label_id", "avg_co")


@query("jn_forecast_days_left", f"""
       SELECT label_id, {d_text('f.date')} AS forecast_date, latitude, t_surface06 FROM {{labels_grid}} g
       LEFT JOIN {{gfs}} f ON g.grid_id = f.grid_id
        AND (f.date = g.date OR f.date = CAST(g.date + INTERVAL '1' DAY AS DATE))""")
def _(t):
    forecasts = t.gfs.withColumnRenamed("date", "forecast_date")
    return J.day_pair_join(t.labels_grid, forecasts, ["grid_id"], "date", "forecast_date") \
        .select("label_id", "forecast_date", "latitude", "t_surface06")


@query("jn_forecast_days_full", f"""
       SELECT coalesce(g.grid_id, f.grid_id) AS grid_id, label_id, {d_text('f.date')} AS forecast_date, latitude
       FROM {{labels_grid}} g FULL JOIN {{gfs}} f ON g.grid_id = f.grid_id
        AND (f.date = g.date OR f.date = CAST(g.date + INTERVAL '1' DAY AS DATE))""")
def _(t):
    forecasts = t.gfs.select("grid_id", F.col("date").alias("forecast_date"), "latitude")
    return J.day_pair_join(t.labels_grid, forecasts, ["grid_id"], "date", "forecast_date", "full") \
        .select("grid_id", "label_id", "forecast_date", "latitude")


def slot_sql(columns, label_date="g.date", hour="hour(g.datetime)"):
    """Max over the two forecast days of the slots that follow the label."""
    return ", ".join(
        f"max(CASE WHEN (f.date = {label_date} AND {hour} < {int(c[-2:])}) OR (f.date > {label_date} AND {hour} >= {int(c[-2:])})"
        f" THEN f.{c} END) AS {c}" for c in columns)


@query("jn_forecast_for_labels", f"""
       SELECT label_id, f.latitude, {slot_sql(_FEW)} FROM {{labels_grid}} g
       LEFT JOIN {{gfs}} f ON g.grid_id = f.grid_id
        AND (f.date = g.date OR f.date = CAST(g.date + INTERVAL '1' DAY AS DATE))
       GROUP BY label_id, f.latitude""")
def _(t):
    return J.forecast_for_labels(t.labels_grid.select("label_id", "grid_id", "datetime"), t.gfs, ["grid_id"], "datetime",
                                 "date", GFS_VARIABLES[:2], keep=("latitude",)).drop("grid_id", "datetime")


_SITES = """(SELECT DISTINCT latitude, longitude, CAST(datetime_utc AS DATE) AS date_utc FROM {labels_station})"""


@query("jn_box", f"""
       WITH s AS (SELECT * FROM {_SITES}),
       m AS (SELECT s.latitude, s.longitude, date_utc, p.latitude AS right_latitude, p.longitude AS right_longitude,
                    p.date, p.t_surface00
             FROM s JOIN {{points}} p ON (p.date = date_utc OR p.date = CAST(date_utc + INTERVAL '1' DAY AS DATE))
             WHERE abs(round(p.latitude, 2) - round(s.latitude, 2)) <= 0.375
               AND abs(round(p.longitude, 2) - round(s.longitude, 2)) <= 0.375)
       SELECT latitude, longitude, {d_text('date_utc')} AS date_utc, right_latitude, right_longitude,
              {d_text('date')} AS date, t_surface00
       FROM s LEFT JOIN m USING (latitude, longitude, date_utc)""")
def _(t):
    sites = t.labels_station.select("latitude", "longitude", F.to_date("datetime_utc").alias("date_utc")).distinct()
    points = t.points.select("latitude", "longitude", "date", "t_surface00")
    return J.box_join(sites, points, 0.375, dates=("date_utc", "date"))


@query("jn_exact_coordinates", """
       SELECT event_id, min_elevation FROM {labels_station} l
       LEFT JOIN {places} p ON l.latitude = p.latitude AND l.longitude = p.longitude""")
def _(t):
    return J.equi_join(t.labels_station, t.places, ["latitude", "longitude"]).select("event_id", "min_elevation")


@query("jn_imputation_back", """
       SELECT index, coalesce(Optical_Depth_047, filled) AS depth FROM {aod_cells}
       LEFT JOIN (SELECT grid_id, utc_date, avg(Column_WV) AS filled FROM {aod_cells}
                  WHERE Optical_Depth_047 IS NULL GROUP BY 1, 2) USING (grid_id, utc_date)""")
def _(t):
    gaps = t.aod_cells.where("Optical_Depth_047 IS NULL").groupBy("grid_id", "utc_date").agg(F.avg("Column_WV").alias("filled"))
    return J.equi_join(t.aod_cells, gaps, ["grid_id", "utc_date"]).select(
        "index", F.coalesce("Optical_Depth_047", "filled").alias("depth"))


@query("jn_metadata_labels", """
       SELECT granule_id, label_id FROM (SELECT granule_id, location, area, CAST(time_end AS DATE) AS date FROM {sat_metadata}) m
       JOIN (SELECT label_id, location, CAST(substr(grid_id, 2) AS BIGINT) AS area, date FROM {labels_grid}) g
       USING (location, area, date)""")
def _(t):
    granules = t.sat_metadata.select("granule_id", "location", "area", F.to_date("time_end").alias("date"))
    labels = t.labels_grid.select("label_id", "location", F.expr("substr(grid_id, 2)").cast("long").alias("area"), "date")
    return J.equi_join(granules, labels, ["location", "area", "date"], "inner").select("granule_id", "label_id")


@query("jn_granule_look_back", f"""
       SELECT granule_id, label_id FROM {{labels_grid}} g JOIN {{sat_metadata}} m
         ON CAST(substr(grid_id, 2) AS BIGINT) = m.area AND m.time_end <= g.datetime
        AND m.time_end >= g.datetime - INTERVAL '24' HOUR""")
def _(t):
    labels = t.labels_grid.withColumn("area", F.expr("substr(grid_id, 2)").cast("long"))
    return J.interval_join(labels, t.sat_metadata.select("granule_id", "area", "time_end"), ["area"], "datetime",
                           "time_end", back=1, how="inner").select("granule_id", "label_id")


def _lookup_sql(digits):
    return f"""
       SELECT latitude, longitude, coalesce(CAST(CAST(answer AS BIGINT) AS VARCHAR), '{NO_DATA_ANSWER.replace("'", "''")}') AS answer
       FROM (SELECT DISTINCT latitude + 0.002e0 AS latitude, longitude FROM {{aod_ee}} UNION ALL SELECT 1e0, 1e0) q
       LEFT JOIN (SELECT round(latitude, {digits}) AS y, round(longitude, {digits}) AS x,
                         arg_max(value, (datetime_utc, value)) AS answer FROM {{labels_station}} GROUP BY 1, 2) s
         ON round(q.latitude, {digits}) = y AND round(q.longitude, {digits}) = x"""


def _lookup(t, digits):
    asked = t.aod_ee.select((F.col("latitude") + 0.002).alias("latitude"), "longitude").distinct()
    asked = asked.union(t.spark.range(1).select(F.lit(1.0), F.lit(1.0)))
    known = t.labels_station.withColumn("value", F.col("value").cast("long"))
    return J.latest_value_lookup(asked, known, "datetime_utc", digits=digits)


@query("jn_point_lookup", _lookup_sql(2))
def _(t):
    return _lookup(t, 2)


@query("jn_point_lookup_coarse", _lookup_sql(1))
def _(t):
    return _lookup(t, 1)


@query("jn_latest_table", _lookup_sql(2))
def _(t):
    known = t.labels_station.withColumn("value", F.col("value").cast("long"))
    table = LatestValues(t.spark, "airgrid_latest", digits=2, buckets=int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    # the table of all rows but those of the last two days, then an update with each of them
    last = F.to_date(known.agg(F.max("datetime_utc").alias("last")).scalar())
    behind = F.least(F.datediff(last, F.to_date("datetime_utc")), F.lit(2))
    for days in (2, 1, 0):
        table.advance(known.where(behind == days), "datetime_utc")
    asked = t.aod_ee.select((F.col("latitude") + 0.002).alias("latitude"), "longitude").distinct()
    return table.answers(asked.union(t.spark.range(1).select(F.lit(1.0), F.lit(1.0))))
