"""End-to-end jobs."""

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from airgrid.constants import DEPLOYED_FEATURES, DEPTH_BANDS, GFS_VARIABLES, NO_DATA_ANSWER, SLOTS, SUMMARY_BANDS
from airgrid.learning.models import impute_chain, regressor
from airgrid.operators.aggregates import band_min_max_median
from airgrid.operators.sets import stack
from airgrid.plans import grid_jobs as G
from airgrid.plans import station_jobs as J
from airgrid.session import shared_folder
from airgrid.sources.readers import csv
from airgrid.sources.writers import write_csv, write_parquet
from bindings.features import aqi_sql
from bindings.geometry import CENTROIDS
from bindings.joins import slot_sql
from bindings.learning import FOLD_SQL
from bindings.rasters import BLOCKS, STATISTICS, summary_sql
from bindings.registry import d_text, query, r6, rounded, ts_text

_ALL = [v + s for s in SLOTS for v in GFS_VARIABLES]
_WHOLE = {"day_of_year", "month", "week_of_year", "min_elevation", "max_elevation", "avg_elevation", "value", "pm25_date_d"}
_CLOUD = "(AOD_QA // 8192) % 8"
_FIELDS = [("AOD_QA_Cloud_Mask", 0, 3), ("AOD_QA_LWS_Mask", 3, 2), ("AOD_QA_Adj_Mask", 5, 3), ("AOD_Level", 8, 1),
           ("Algo_init", 9, 1), ("BRF_over_snow", 10, 1), ("BRF_climatology", 11, 1), ("AOD_QA_SC_Mask", 12, 3)]


@query("job_grid_day_table", f"""
       WITH q AS (SELECT *, {', '.join(f'(AOD_QA // {2 ** (16 - s - n)}) % {2 ** n} AS {f}' for f, s, n in _FIELDS)} FROM {{aod_cells}}),
       a AS (SELECT grid_id, utc_date, {', '.join(f'min({b}) AS min_{b}, max({b}) AS max_{b}, avg({b}) AS mean_{b}' for b in [*SUMMARY_BANDS, *[f for f, _, _ in _FIELDS]])}
             FROM q WHERE AOD_QA_Cloud_Mask = 1 GROUP BY 1, 2),
       f AS (SELECT grid_id, date AS utc_date, {', '.join(f'avg({c}) AS {c}' for c in _ALL)} FROM {{gfs}} GROUP BY 1, 2)
       SELECT * REPLACE ({d_text('utc_date')} AS utc_date) FROM a JOIN f USING (grid_id, utc_date) LEFT JOIN {{elevation}} USING (grid_id)""")
def _(t):
    table, _ = G.grid_day_table(t.aod_cells, t.gfs, t.elevation)
    return table


@query("job_grid_day_labels", f"""
       WITH a AS (SELECT grid_id, utc_date, avg(Column_WV) AS mean_Column_WV, max(AOD_Uncertainty) AS max_AOD_Uncertainty
                  FROM {{aod_cells}} WHERE {_CLOUD} = 1 GROUP BY 1, 2),
       f AS (SELECT grid_id, date AS utc_date, avg(t_surface06) AS t_surface06 FROM {{gfs}} GROUP BY 1, 2),
       l AS (SELECT grid_id, utc_date, count(*) AS n_cells FROM {{aod_cells}} GROUP BY 1, 2)
       SELECT label_id, value, a.grid_id, {d_text('a.utc_date')} AS utc_date, CAST(0 AS INT) AS part, n_cells, mean_Column_WV, max_AOD_Uncertainty,
              t_surface06, min_elevation FROM a JOIN f USING (grid_id, utc_date) JOIN l USING (grid_id, utc_date)
       JOIN {{labels_grid}} g ON g.grid_id = a.grid_id AND g.date = a.utc_date LEFT JOIN {{elevation}} e ON e.grid_id = a.grid_id""")
def _(t):
    out = G.labelled_grid_days(t.aod_cells, t.gfs, t.elevation, t.labels_grid.select("label_id", "grid_id", "date", "value"))
    return out.select("label_id", "value", "grid_id", "utc_date", "part", F.size("lon_lat_list").cast("bigint").alias("n_cells"),
                      "mean_Column_WV", "max_AOD_Uncertainty", "t_surface06", "min_elevation")


_FORECASTS = """
    fc AS (SELECT {keys}, f.latitude, f.longitude, {slots} FROM {labels} g LEFT JOIN {{gfs}} f ON g.grid_id = f.grid_id
            AND (f.date = {day} OR f.date = CAST({day} + INTERVAL '1' DAY AS DATE)) GROUP BY ALL),
    nf AS (SELECT * EXCLUDE (r, clon, clat, latitude, longitude) FROM (
             SELECT *, dense_rank() OVER (PARTITION BY grid_id, datetime
                ORDER BY round(sqrt((clon - longitude) * (clon - longitude) + (clat - latitude) * (clat - latitude)), 9)) AS r
             FROM fc LEFT JOIN {centroids} ce USING (grid_id)) WHERE r = 1)"""


def _forecasts(keys, labels):
    day = "CAST(g.datetime AS DATE)"
    return _FORECASTS.format(keys=", ".join(f"g.{k}" for k in keys), labels=labels, day=day, centroids=CENTROIDS,
                             slots=slot_sql(_ALL, day)).replace("{{", "{").replace("}}", "}")


_MASKED = ("SELECT * REPLACE (" + ", ".join(f"CASE WHEN {_CLOUD} = 1 THEN {b} END AS {b}" for b in DEPTH_BANDS) + "), "
           + ", ".join(f"(AOD_QA // {2 ** (16 - s - n)}) % {2 ** n} AS {f}" for f, s, n in _FIELDS) + " FROM ")
_AVERAGED = ", ".join(f"avg({b}) AS {b}" for b in SUMMARY_BANDS) + ", CAST(trunc(avg(AOD_QA)) AS INT) AS AOD_QA"
_CELLS = f"(SELECT grid_id, lon, lat, datetime, {_AVERAGED} FROM (SELECT DISTINCT * FROM {{label_cells}}) GROUP BY 1, 2, 3, 4)"
_MEDIANS = ", ".join(f"min({b}) AS min_{b}, max({b}) AS max_{b}, quantile_disc({b}, 0.5) AS median_{b}" for b in SUMMARY_BANDS)
_ALL_MEDIANS = ", ".join(f"min({b}) AS min_{b}, max({b}) AS max_{b}, quantile_disc({b}, 0.5) AS median_{b}" for b in [*SUMMARY_BANDS, *[f for f, _, _ in _FIELDS]])


@query("job_date_validated_table", f"""
       WITH {_forecasts(['label_id', 'grid_id', 'datetime', 'value'], '{labels_grid}')},
       s AS (SELECT grid_id, datetime, {_ALL_MEDIANS} FROM ({_MASKED} {_CELLS}) GROUP BY 1, 2)
       SELECT * REPLACE ({ts_text('datetime')} AS datetime) FROM s RIGHT JOIN nf USING (grid_id, datetime) LEFT JOIN {{elevation}} USING (grid_id)""")
def _(t):
    return G.date_validated_table(t.labels_grid.select("label_id", "grid_id", "datetime", "value"), t.dealt("gfs"), t.label_cells,
                                  t.elevation, t.grids)


@query("job_cell_table", f"""
       WITH {_forecasts(['grid_id', 'datetime'], '(SELECT DISTINCT grid_id, datetime FROM {labels_grid})')},
       c AS (SELECT m.*, round(sqrt((clon - lon) * (clon - lon) + (clat - lat) * (clat - lat)), 9) AS distance
             FROM ({_MASKED} {_CELLS}) m LEFT JOIN {CENTROIDS} ce USING (grid_id)),
       d AS (SELECT grid_id, datetime, {', '.join(SUMMARY_BANDS)}, {r6('distance')} AS AOD_distance_to_grid_center,
                    dense_rank() OVER (PARTITION BY grid_id, datetime ORDER BY distance) AS AOD_distance_rank FROM c)
       SELECT * REPLACE ({ts_text('datetime')} AS datetime) FROM (SELECT label_id, grid_id, datetime, value FROM {{labels_grid}})
       LEFT JOIN (SELECT * FROM d WHERE AOD_distance_rank <= 20) USING (grid_id, datetime)
       LEFT JOIN nf USING (grid_id, datetime) LEFT JOIN {{elevation}} USING (grid_id)""")
def _(t):
    out = G.cell_table(t.labels_grid.select("label_id", "grid_id", "datetime", "value"), t.dealt("gfs"), t.label_cells, t.elevation, t.grids)
    return rounded(out, "AOD_distance_to_grid_center")


@query("job_submission_table", f"""
       WITH asked AS (SELECT DISTINCT grid_id, datetime FROM {{labels_grid}}),
       {_forecasts(['grid_id', 'datetime'], 'asked')},
       w AS (SELECT q.grid_id, lon, lat, datetime, {_AVERAGED} FROM asked q JOIN (SELECT DISTINCT * EXCLUDE (index) FROM {{aod_cells}}) c
              ON q.grid_id = c.grid_id AND c.aod_reading_end >= date_trunc('day', q.datetime) - INTERVAL '1' DAY
              AND c.aod_reading_end <= date_trunc('day', q.datetime) + INTERVAL '1' DAY GROUP BY 1, 2, 3, 4),
       s AS (SELECT grid_id, datetime, {_ALL_MEDIANS} FROM ({_MASKED} w) GROUP BY 1, 2)
       SELECT * REPLACE ({ts_text('datetime')} AS datetime) FROM s RIGHT JOIN nf USING (grid_id, datetime) LEFT JOIN {{elevation}} USING (grid_id)""")
def _(t):
    return G.submission_table(t.labels_grid, t.dealt("gfs"), t.aod_cells, t.elevation, t.grids)


@query("job_misr_merge", f"""
       WITH s AS (SELECT grid_id, datetime, {_MEDIANS} FROM {{label_cells}} GROUP BY 1, 2),
       m AS (SELECT grid_id, datetime, avg(Aerosol_Optical_Depth) AS Aerosol_Optical_Depth,
                    avg(Angstrom_Exponent_550_860nm) AS Angstrom_Exponent_550_860nm FROM {{misr}} GROUP BY 1, 2)
       SELECT * REPLACE ({ts_text('datetime')} AS datetime) FROM s FULL JOIN m USING (grid_id, datetime)""")
def _(t):
    summary = band_min_max_median(t.label_cells, ["grid_id", "datetime"], SUMMARY_BANDS)
    return G.merge_misr(summary, t.misr, ["grid_id", "datetime"], ["Aerosol_Optical_Depth", "Angstrom_Exponent_550_860nm"])


_CITY = ("CASE city WHEN 'Delhi' THEN 'dl' WHEN 'Los Angeles-Long Beach-Santa Ana' THEN 'la' WHEN 'LOS ANGELES' THEN 'la' "
         "WHEN '臺北市' THEN 'tpe' ELSE city END")
_STATIONS = f"""
    s AS (SELECT CAST(datetime_utc AS DATE) AS date_utc, location, parameter, country, {_CITY} AS city, latitude, longitude,
                 max(datetime_utc) AS datetime_utc, avg(value) AS value FROM {{labels_station}}
          WHERE value > 0 AND value <= 600 AND city IS NOT NULL GROUP BY ALL)"""


@query("job_station_series", f"""
       WITH {_STATIONS},
       a AS (SELECT *, lag(value, 1) OVER w AS value_lag1day, lag(value, 7) OVER w AS value_lag7day, lag(value, 30) OVER w AS value_lag30day
             FROM s WINDOW w AS (PARTITION BY city, latitude, longitude ORDER BY date_utc)),
       b AS (SELECT *, value_lag1day - value AS difflag FROM a)
       SELECT {d_text('date_utc')} AS date_utc, location, parameter, country, city, latitude, longitude, {ts_text('datetime_utc')} AS datetime_utc,
              value, value_lag1day, value_lag7day, value_lag30day, difflag, lag(difflag, 1) OVER w AS difflag_lag1day,
              lag(difflag, 7) OVER w AS difflag_lag7day, lag(difflag, 30) OVER w AS difflag_lag30day
       FROM b WINDOW w AS (PARTITION BY city, latitude, longitude ORDER BY date_utc)""")
def _(t):
    return J.station_series(t.labels_station)


@query("job_station_table", f"""
       WITH {_STATIONS},
       r AS (SELECT s.date_utc, s.location, s.latitude, s.longitude, s.datetime_utc, s.value, avg(e.Optical_Depth_047) AS avg_Optical_Depth_047
             FROM s LEFT JOIN {{aod_ee}} e ON round(s.latitude, 2) = round(e.latitude, 2) AND round(s.longitude, 2) = round(e.longitude, 2)
              AND e.aod_reading_time <= s.datetime_utc AND e.aod_reading_time >= s.date_utc - INTERVAL '1' DAY GROUP BY ALL),
       n AS (SELECT r.date_utc, r.location, {slot_sql(_ALL, 'r.date_utc', 'hour(r.datetime_utc)')} FROM r JOIN {{points}} f
              ON (f.date = r.date_utc OR f.date = CAST(r.date_utc + INTERVAL '1' DAY AS DATE))
             WHERE abs(round(f.latitude, 2) - round(r.latitude, 2)) <= 0.375 AND abs(round(f.longitude, 2) - round(r.longitude, 2)) <= 0.375
             GROUP BY 1, 2)
       SELECT * REPLACE ({d_text('date_utc')} AS date_utc, {ts_text('datetime_utc')} AS datetime_utc)
       FROM r LEFT JOIN {{places}} USING (latitude, longitude) LEFT JOIN n USING (date_utc, location)""")
def _(t):
    labels = J.station_series(t.labels_station).select("date_utc", "location", "latitude", "longitude", "datetime_utc", "value")
    # four histories with coordinates as text and longitudes from 0 to 360
    shifted = t.points.withColumns({"latitude": F.col("latitude").cast("string"), "longitude": (F.col("longitude") + 180).cast("string")})
    forecasts = J.forecast_history([shifted.where(F.dayofmonth("date") % 4 == k) for k in range(4)])
    return J.station_table(labels, t.aod_ee, t.places, forecasts, 0.375)


_SCALED = "CASE WHEN {0} <> 0 THEN 46.759e0 * {0} + 7.1333e0 END"


def _four(v):
    return "(" + " + ".join(f"coalesce({v}{s}, 0)" for s in SLOTS) + ") / 4"


@query("job_deployed_features", f"""
       WITH p AS (SELECT *, {_SCALED.format('t_surface06')} AS depth_scaled, {', '.join(f'{_four(v)} AS {v}' for v in GFS_VARIABLES)} FROM {{gfs}})
       SELECT grid_id, {d_text('date')} AS date, latitude, day(date) AS day_of_month, dayofweek(date) + 1 AS day_of_week, dayofyear(date) AS day_of_year,
              week(date) AS week_of_year, month(date) AS month, year(date) AS year, {r6('depth_scaled', 9)} AS depth_scaled,
              {r6("avg(depth_scaled) OVER (PARTITION BY grid_id, latitude ORDER BY CAST(epoch(date) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)", 9)}
                AS trailing1d_depth_scaled, {', '.join(GFS_VARIABLES)}, {r6('sqrt(u_pbl * u_pbl + v_pbl * v_pbl)')} AS wind_speed FROM p""")
def _(t):
    out = J.deployed_features(t.gfs.withColumn("depth", F.col("t_surface06")), ["grid_id", "latitude"], "date", ["depth"], ["depth"])
    out = out.select("grid_id", "date", "latitude", "day_of_month", "day_of_week", "day_of_year", "week_of_year", "month", "year",
                     "depth_scaled", "trailing1d_depth_scaled", *GFS_VARIABLES, "wind_speed")
    return rounded(rounded(out, "depth_scaled", "trailing1d_depth_scaled", digits=9), "wind_speed")


_DEPTHS = [f"{s}_{b}" for b in DEPTH_BANDS for s in ("min", "max", "median")]
_TRAILING = "avg({0}_scaled) OVER (PARTITION BY grid_id ORDER BY CAST(epoch(date) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)"


@query("job_deployed_table", f"""
       WITH c AS (SELECT grid_id, utc_date AS date, {', '.join(f'min({b}) AS min_{b}, max({b}) AS max_{b}, quantile_disc({b}, 0.5) AS median_{b}' for b in DEPTH_BANDS)}
                  FROM {{aod_cells}} GROUP BY 1, 2),
       a AS (SELECT grid_id, CAST(datetime AS DATE) AS date, avg(Aerosol_Optical_Depth) AS Aerosol_Optical_Depth,
                    avg(Angstrom_Exponent_550_860nm) AS Angstrom_Exponent_550_860nm FROM {{misr}} GROUP BY 1, 2),
       w AS (SELECT grid_id, date, {', '.join(f'avg({c}) AS {c}' for c in _ALL)} FROM {{gfs}} GROUP BY 1, 2),
       j AS (SELECT * FROM (SELECT grid_id, date, value FROM {{daily_grid}}) d LEFT JOIN c USING (grid_id, date) LEFT JOIN a USING (grid_id, date)
             LEFT JOIN w USING (grid_id, date) LEFT JOIN {{elevation}} USING (grid_id)),
       s AS (SELECT *, {', '.join(f'{_SCALED.format(c)} AS {c}_scaled' for c in [*_DEPTHS, 'Aerosol_Optical_Depth'])},
                    {', '.join(f'{_four(v)} AS {v}' for v in GFS_VARIABLES)} FROM j),
       f AS (SELECT *, {', '.join(f'{_TRAILING.format(c)} AS trailing1d_{c}_scaled' for c in _DEPTHS[:3])}, dayofyear(date) AS day_of_year, month(date) AS month,
                    week(date) AS week_of_year, sqrt(u_pbl * u_pbl + v_pbl * v_pbl) AS wind_speed, {d_text('date')} AS pm25_date_d FROM s)
       SELECT {', '.join(c if c in _WHOLE else f'{r6(c)} AS {c}' for c in DEPLOYED_FEATURES)} FROM f""")
def _(t):
    cells = t.aod_cells.withColumnRenamed("utc_date", "date")
    out = J.deployed_table(t.daily_grid, cells, t.misr.withColumn("date", F.to_date("datetime")), t.gfs, t.elevation)
    return rounded(out, *[c for c in DEPLOYED_FEATURES if c not in _WHOLE])


@query("job_chained_imputation")
def _(t):
    columns = [f"{s}_{b}" for b in SUMMARY_BANDS[:2] for s in ("min", "max", "median")]
    table = band_min_max_median(t.aod_cells, ["grid_id", "utc_date"], SUMMARY_BANDS)
    holes = table.withColumns({c: F.when(F.crc32(F.concat("grid_id", F.col("utc_date").cast("string"), F.lit(c))) % 9 > 0, F.col(c))
                               for c in columns})
    return impute_chain(holes, columns, ["grid_id", "utc_date"], "utc_date", learner="linear")


def _two_features(column, u, v, gap, source):
    """Fit of `column` on u and v (gaps of v at `gap`) over the rows of `source` that have it, as SQL."""
    v = f"coalesce({v}, {gap})"
    pair = {"s11": f"var_pop({u})", "s22": f"var_pop({v})", "s12": f"covar_pop({u}, {v})", "s1y": f"covar_pop({u}, {column})", "s2y": f"covar_pop({v}, {column})"}
    return (f"SELECT *, my - b1 * m1 - b2 * m2 AS b0 FROM (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, "
            f"(s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM (SELECT avg({column}) AS my, avg({u}) AS m1, avg({v}) AS m2, "
            f"{', '.join(f'{x} AS {n}' for n, x in pair.items())} FROM {source} WHERE {column} IS NOT NULL))")


@query("job_chained_lines", f"""
       WITH k AS (SELECT label_id, date, x1, x2, CASE WHEN label_id % 5 > 0 THEN x3 END AS x3 FROM {{training}}),
       r AS (SELECT *, {FOLD_SQL} AS fold FROM (SELECT *, percent_rank() OVER (ORDER BY date) AS r FROM k)),
       m AS (SELECT avg(x2) AS gap FROM r WHERE fold % 2 = 0 AND x3 IS NOT NULL),
       f AS ({_two_features('x3', 'x1', 'x2', 'gap', 'r, m')}),
       a AS (SELECT label_id, x1, x2, coalesce(x3, b0 + b1 * x1 + b2 * coalesce(x2, gap)) AS x3 FROM r, m, f),
       g AS ({_two_features('x2', 'x1', 'x3', '0', 'a')})
       SELECT label_id, {r6('coalesce(x2, b0 + b1 * x1 + b2 * x3)', 4)} AS x2, {r6('x3', 4)} AS x3 FROM a, g""")
def _(t):
    holes = t.training.select("label_id", "date", "x1", "x2", F.when(F.col("label_id") % 5 > 0, F.col("x3")).alias("x3"))
    out = impute_chain(holes, ["x3", "x2"], ["label_id"], "date", learner="linear", penalties=(0.0,))
    return rounded(out.select("label_id", "x2", "x3"), "x2", "x3", digits=4)


@query("job_scoring_rows", f"""
       SELECT l_orderkey, l_linenumber, l_partkey, prediction, actual, {aqi_sql('prediction')} AS predicted_aqi, {aqi_sql('actual')} AS actual_aqi,
              CAST({aqi_sql('prediction')} = {aqi_sql('actual')} AS INT) AS aqi_hit FROM {{scored}}""")
def _(t):
    return J.scoring_report(t.scored.drop("date"))["rows"]


@query("job_scoring_hits", f"""
       SELECT {aqi_sql('actual')} AS actual_aqi, CAST(sum(CAST({aqi_sql('prediction')} = {aqi_sql('actual')} AS INT)) AS BIGINT) AS aqi_hit,
              count(*) AS count, avg(CAST({aqi_sql('prediction')} = {aqi_sql('actual')} AS INT)) AS percentage FROM {{scored}} GROUP BY 1""")
def _(t):
    return J.scoring_report(t.scored)["hits"]


@query("job_scoring_errors", f"""
       SELECT avg(prediction) AS prediction, avg(actual) AS actual, abs(avg(prediction) - avg(actual)) AS abs_mean_error,
              {r6('sqrt(avg((prediction - actual) * (prediction - actual)))')} AS rmse FROM {{scored}}""")
def _(t):
    return rounded(J.scoring_report(t.scored)["errors"], "rmse")


@query("job_composition_features", f"""
       SELECT label_id, value, avg(r.pm25_rh35_gcc) AS avg_pm25_rh35_gcc FROM {{labels_grid}} g
       LEFT JOIN {{geos}} r ON g.grid_id = r.grid_id AND r.time <= g.datetime AND r.time >= date_trunc('day', g.datetime) - INTERVAL '1' DAY
       GROUP BY label_id, value""")
def _(t):
    return G.composition_features(t.labels_grid, t.geos, ["pm25_rh35_gcc"]).select("label_id", "value", "avg_pm25_rh35_gcc")


@query("job_elevation_table", summary_sql(BLOCKS))
def _(t):
    return rounded(G.elevation_table(t.raster, ["raster_id"]), *STATISTICS)


_RASTER = """(SELECT elevation, 20 + (raster_id % 50) * 0.25e0 + row * 0.02e0 AS lat, 60 + floor(raster_id / 50) * 0.25e0 + col * 0.02e0 AS lon FROM {raster})"""


@query("job_point_elevation", f"""
       SELECT p.latitude, p.longitude, min(elevation) AS min_elevation, max(elevation) AS max_elevation, {r6('avg(elevation)')} AS avg_elevation
       FROM (SELECT DISTINCT latitude, longitude FROM {{labels_station}}) p LEFT JOIN {_RASTER} r
         ON lat >= latitude - 0.1e0 AND lat <= latitude + 0.1e0 AND lon >= longitude - 0.1e0 AND lon <= longitude + 0.1e0 GROUP BY 1, 2""")
def _(t):
    cells = t.spark.sql(_RASTER.strip("()"), raster=t.raster)
    path = f"{shared_folder(t.spark)}/airgrid-elevations-{uuid.uuid4().hex}"
    write_parquet(J.point_elevations(t.labels_station, cells, 0.1), path)
    return rounded(t.spark.read.parquet(path), "avg_elevation")


_LAT = "degrees((y0 + row * (y1 - y0) / n_rows) / 6371007.181e0)"
_LON = "degrees((x0 + col * (x1 - x0) / n_cols) / (6371007.181e0 * cos((y0 + row * (y1 - y0) / n_rows) / 6371007.181e0)))"
_KEPT = ("CASE WHEN lpad(bin(AOD_QA), 16, '0')[1:3] IN ('000', '001', '010') AND lpad(bin(AOD_QA), 16, '0')[6:8] IN ('000', '011')"
         " THEN {} END")


def _valid(c):
    return f"(CASE WHEN {c} <> 13 AND {c} >= 3 AND {c} <= 45 THEN ({c} - 2) * 0.5 END)"


_GRANULES = f"SELECT granule_id, layer, row, col, {_LON} AS lon, {_LAT} AS lat, {_valid('raw')} AS raw, {_KEPT.format(_valid('raw_b'))} AS raw_b FROM {{granules}}"
_INSIDE = "lon >= min_lon AND lon <= max_lon AND lat >= min_lat AND lat <= max_lat"


def _granule_cells(t, average):
    return G.granule_cells(t.granules, t.grids, ["raw", "raw_b"], F.lit(13.0), F.lit(3.0), F.lit(45.0), F.lit(0.5), F.lit(2.0),
                           depth_bands=("raw_b",), average=average, digits=6)


@query("job_granule_cells", f"""
       SELECT grid_id, granule_id, layer, {r6('lon')} AS lon, {r6('lat')} AS lat, raw, raw_b FROM ({_GRANULES}) JOIN {{boxes}} ON {_INSIDE}""")
def _(t):
    return _granule_cells(t, False)


@query("job_granule_cells_averaged", f"""
       SELECT grid_id, granule_id, {r6('any_value(lon)')} AS lon, {r6('any_value(lat)')} AS lat, avg(raw) AS raw, avg(raw_b) AS raw_b
       FROM ({_GRANULES}) JOIN {{boxes}} ON {_INSIDE} GROUP BY grid_id, granule_id, row, col""")
def _(t):
    return _granule_cells(t, True)


@query("job_granule_partitions", f"""
       WITH p AS (SELECT label_id, g.grid_id, g.datetime, m.granule_id, m.area, m.time_end FROM {{labels_grid}} g JOIN {{sat_metadata}} m
                    ON CAST(substr(g.grid_id, 2) AS BIGINT) = m.area AND m.time_end <= g.datetime AND m.time_end >= g.datetime - INTERVAL '24' HOUR
                  WHERE product = 'maiac' AND split = 'train' AND contains(us_url, '.hdf'))
       SELECT p.grid_id, strftime(p.datetime, '%Y-%m') AS month, label_id, {ts_text('p.datetime')} AS label_time, {ts_text('p.time_end')} AS reading_time,
              p.granule_id, layer, {r6('lon')} AS lon, {r6('lat')} AS lat, raw, raw_b
       FROM p JOIN ({_GRANULES.replace('granule_id, layer', 'granule_id AS scene, layer')}) c ON c.scene = p.area JOIN {{boxes}} b ON b.grid_id = p.grid_id WHERE {_INSIDE}""")
def _(t):
    labels = t.labels_grid.select("label_id", "grid_id", "datetime", F.expr("substr(grid_id, 2)").cast("long").alias("area"))
    path = f"{shared_folder(t.spark)}/airgrid-cells-{uuid.uuid4().hex}"

    def run(catalog):
        readings = G.granule_readings(labels, catalog, ["area"], "maiac", ".hdf")
        return G.granule_partitions(readings, t.granules, t.grids, path, ["raw", "raw_b"], F.lit(13.0), F.lit(3.0), F.lit(45.0), F.lit(0.5), F.lit(2.0),
                                    scene="area", depth_bands=("raw_b",))

    # a catalogue that grows: the second run writes the months that it adds to
    run(t.sat_metadata.where("time_end < '1996-01-01'"))
    run(t.sat_metadata)
    names = ["grid_id", "month", "label_id", "label_time", "reading_time", "granule_id", "layer", "lon", "lat", "raw", "raw_b"]
    return rounded(t.spark.read.parquet(path).select(names), "lon", "lat")


_NAMED = """(SELECT *, CASE WHEN r < 0.8e0 THEN 'train' WHEN r < 0.9e0 THEN 'valid' ELSE 'test' END AS part
             FROM (SELECT *, percent_rank() OVER (ORDER BY date) AS r FROM {training}))"""


@query("job_deployed_inputs", f"""
       WITH n AS (SELECT * FROM {_NAMED}),
       c AS (SELECT location, row_number() OVER (ORDER BY location) - 1e0 AS code FROM (SELECT DISTINCT location FROM n WHERE part = 'train'))
       SELECT label_id, part AS "Set", coalesce(x2, (SELECT avg(x2) FROM n WHERE part = 'train')) AS x2, x3,
              coalesce(code, (SELECT count(*) + 0e0 FROM c)) AS location_code FROM n LEFT JOIN c USING (location)""")
def _(t):
    parts = J.deployed_inputs(t.training, "date", ["x2", "x3"], ["location"])
    return stack(*parts.values()).select("label_id", "Set", "x2", "x3", "location_code")


def _line_report(t):
    line = Pipeline(stages=[VectorAssembler(inputCols=["x1"], outputCol="one"),
                            regressor("linear", "value", "one", maxIter=100, solver="normal")])
    parts = J.deployed_inputs(t.training, "date", ["x2"], [])
    return J.predict_and_report(stack(parts["train"], parts["valid"]), parts["test"], line, {}, ["label_id"])


_PREDICTED = f"""(SELECT label_id, value AS actual, b0 + b1 * x1 AS prediction FROM {_NAMED}, (
    SELECT regr_intercept(value, x1) AS b0, regr_slope(value, x1) AS b1 FROM {_NAMED} WHERE part <> 'test') WHERE part = 'test')"""


@query("job_predict_and_report", f"""
       SELECT label_id, actual, {r6('prediction', 4)} AS prediction, {aqi_sql('actual')} AS actual_aqi, {aqi_sql('prediction')} AS predicted_aqi,
              CAST({aqi_sql('actual')} = {aqi_sql('prediction')} AS INT) AS aqi_hit FROM {_PREDICTED}""")
def _(t):
    return rounded(_line_report(t)["rows"], "prediction", digits=4)


@query("job_prediction_errors", f"""
       SELECT {r6('avg(prediction)', 4)} AS prediction, avg(actual) AS actual, {r6('abs(avg(prediction) - avg(actual))', 4)} AS abs_mean_error,
              {r6('sqrt(avg((prediction - actual) * (prediction - actual)))', 4)} AS rmse FROM {_PREDICTED}""")
def _(t):
    return rounded(_line_report(t)["errors"], "prediction", "abs_mean_error", "rmse", digits=4)


@query("job_report_export", f"""
       SELECT label_id, actual, {r6('prediction', 4)} AS prediction, {aqi_sql('actual')} AS actual_aqi FROM {_PREDICTED}""")
def _(t):
    path = f"{shared_folder(t.spark)}/airgrid-report-{uuid.uuid4().hex}"
    write_csv(rounded(_line_report(t)["rows"], "prediction", digits=4).select("label_id", "actual", "prediction", "actual_aqi"), path)
    return csv(t.spark, path, "label_id BIGINT, actual DOUBLE, prediction DOUBLE, actual_aqi STRING")


@query("job_point_answers", f"""
       WITH {_STATIONS},
       d AS (SELECT round(latitude, 2) AS y, round(longitude, 2) AS x, arg_max(value, (date_utc, value)) AS v FROM (
             SELECT latitude, longitude, date_utc, round(max(value)) AS value FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2)
       SELECT p.latitude, p.longitude, coalesce(CAST(v AS VARCHAR), '{NO_DATA_ANSWER.replace("'", "''")}') AS answer
       FROM (SELECT DISTINCT latitude, longitude FROM {{places}} UNION ALL SELECT -1.5e0, 2.25e0) p
       LEFT JOIN d ON d.y = round(p.latitude, 2) AND d.x = round(p.longitude, 2)""")
def _(t):
    nowhere = t.spark.range(1).select(F.lit(-1.5).alias("latitude"), F.lit(2.25).alias("longitude"))
    series = J.station_series(t.labels_station).groupBy("latitude", "longitude", "date_utc").agg(F.round(F.max("value")).alias("value"))
    return J.point_answers(t.places.select("latitude", "longitude").distinct().union(nowhere), series)


@query("job_grid_day_lists", f"""
       SELECT grid_id, {d_text('utc_date')} AS utc_date, CAST(0 AS INT) AS part, count(*) AS n_cells FROM {{aod_cells}} GROUP BY 1, 2""")
def _(t):
    _, lists = G.grid_day_table(t.aod_cells, t.gfs, t.elevation)
    return lists.select("grid_id", "utc_date", "part", F.size("lon_lat_list").alias("n_cells"))
