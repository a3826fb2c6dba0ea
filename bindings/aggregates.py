"""Aggregates."""

from pyspark.sql import functions as F

from airgrid.constants import SUMMARY_BANDS
from airgrid.functions import features as X
from airgrid.functions.quality import quality_fields
from airgrid.operators import aggregates as A
from airgrid.operators import sets
from bindings.features import aqi_sql
from airgrid.operators.sketches import ERROR, quantile_sketches, window_quantiles
from airgrid.session import settle
from bindings.registry import d_text, query, r6, rounded, ts_text

_CLOUD = "(AOD_QA // 8192) % 8"


@query("agg_mean_by_key", f"""
       SELECT grid_id, {d_text('utc_date')} AS utc_date, avg(index) AS index, avg(lon) * 0 AS zero, avg(AOD_Uncertainty) AS AOD_Uncertainty
       FROM {{aod_cells}} GROUP BY grid_id, utc_date""")
def _(t):
    cells = t.aod_cells.select("grid_id", "utc_date", "index", "AOD_Uncertainty", F.lit(0.0).alias("zero"))
    return A.mean_by(cells, ["grid_id", "utc_date"])


@query("agg_mean_skip_nan", """
       SELECT grid_id, avg(Optical_Depth_047) AS depth FROM {aod_cells} GROUP BY grid_id""")
def _(t):
    cells = t.aod_cells.select("grid_id", F.coalesce("Optical_Depth_047", F.lit(float("nan"))).alias("depth"))
    return A.mean_by(cells, ["grid_id"], skip_nan=True)


@query("agg_max_by_key", f"""
       SELECT grid_id, {d_text('utc_date')} AS utc_date, max(Optical_Depth_047) AS Optical_Depth_047, max(Column_WV) AS Column_WV
       FROM {{aod_cells}} GROUP BY grid_id, utc_date""")
def _(t):
    return A.max_by_key(t.aod_cells, ["grid_id", "utc_date"], ["Optical_Depth_047", "Column_WV"])


_MASKS = ["AOD_QA_Cloud_Mask", "AOD_QA_LWS_Mask"]
_QA_CELLS = f"""(SELECT *, {_CLOUD} AS AOD_QA_Cloud_Mask, (AOD_QA // 2048) % 4 AS AOD_QA_LWS_Mask FROM {{aod_cells}})"""


@query("agg_band_min_max_mean", f"SELECT grid_id, {d_text('utc_date')} AS utc_date, " + ", ".join(
    f"min({b}) AS min_{b}, max({b}) AS max_{b}, avg({b}) AS mean_{b}" for b in [*SUMMARY_BANDS, *_MASKS])
    + f" FROM {_QA_CELLS} WHERE AOD_QA_Cloud_Mask = 1 GROUP BY grid_id, utc_date")
def _(t):
    cells = t.aod_cells.select("*", *quality_fields(F.col("AOD_QA")))
    return A.band_min_max_mean(cells, ["grid_id", "utc_date"], [*SUMMARY_BANDS, *_MASKS], F.col("AOD_QA_Cloud_Mask") == 1)


def _median_sql(source, by):
    return f"SELECT {by}, " + ", ".join(
        f"min({b}) AS min_{b}, max({b}) AS max_{b}, quantile_disc({b}, 0.5) AS median_{b}" for b in SUMMARY_BANDS) \
        + f" FROM {source} GROUP BY ALL"


@query("agg_band_min_max_median", _median_sql("{aod_cells}", f"grid_id, {d_text('utc_date')} AS utc_date"))
def _(t):
    return A.band_min_max_median(t.aod_cells, ["grid_id", "utc_date"], SUMMARY_BANDS)


@query("agg_band_median_clear", _median_sql(f"{_QA_CELLS} WHERE AOD_QA_Cloud_Mask = 1", f"grid_id, {d_text('utc_date')} AS utc_date"))
def _(t):
    cells = t.aod_cells.select("*", *quality_fields(F.col("AOD_QA")))
    return A.band_min_max_median(cells, ["grid_id", "utc_date"], SUMMARY_BANDS, F.col("AOD_QA_Cloud_Mask") == 1)


@query("agg_band_median_exact", _median_sql("{aod_cells}", "grid_id"))
def _(t):
    return A.band_min_max_median(t.aod_cells, ["grid_id"], SUMMARY_BANDS, exact=True)


_PAIR = "concat_ws('_', CAST(CAST(AOD_Uncertainty AS INT) AS VARCHAR), CAST(CAST(Column_WV AS INT) AS VARCHAR))"


@query("agg_coordinate_list", f"""
       SELECT grid_id, {d_text('utc_date')} AS utc_date, CAST(0 AS INT) AS part, string_agg({_PAIR}, ' ' ORDER BY {_PAIR}) AS lon_lat_list
       FROM {{aod_cells}} GROUP BY grid_id, utc_date""")
def _(t):
    cells = t.aod_cells.select("grid_id", "utc_date", F.col("AOD_Uncertainty").cast("int").alias("lon"),
                               F.col("Column_WV").cast("int").alias("lat"))
    lists = A.coordinate_lists(cells, ["grid_id", "utc_date"])
    return lists.withColumn("lon_lat_list", F.array_join("lon_lat_list", " "))


@query("agg_coordinate_list_parts", f"""
       WITH p AS (SELECT grid_id, {_PAIR} AS pair, (row_number() OVER (PARTITION BY grid_id ORDER BY {_PAIR}) - 1) // 64 AS part FROM {{aod_cells}})
       SELECT grid_id, CAST(part AS INT) AS part, count(*) AS n_cells, min(pair) AS first, max(pair) AS last FROM p GROUP BY grid_id, part""")
def _(t):
    cells = t.aod_cells.select("grid_id", F.col("AOD_Uncertainty").cast("int").alias("lon"), F.col("Column_WV").cast("int").alias("lat"))
    lists = A.coordinate_lists(cells, ["grid_id"], chunk=64)
    return lists.select("grid_id", "part", F.size("lon_lat_list").alias("n_cells"),
                        F.array_min("lon_lat_list").alias("first"), F.array_max("lon_lat_list").alias("last"))


@query("agg_station_days", f"""
       SELECT {d_text('datetime_utc')} AS date_utc, location, city, latitude, longitude, {ts_text('max(datetime_utc)')} AS datetime_utc,
              avg(value) AS value FROM {{labels_station}} WHERE city IS NOT NULL GROUP BY ALL""")
def _(t):
    return A.station_days(t.labels_station, ["location", "city", "latitude", "longitude"])


@query("agg_climatology", """
       WITH p AS (SELECT *, dayofweek(date) + 1 AS day_of_week, week(date) AS week_of_year, month(date) AS month, year(date) AS year FROM {labels_grid})
       SELECT grid_id, 'day_of_week' AS calendar, day_of_week AS part, avg(value) AS value FROM p GROUP BY ALL
       UNION ALL SELECT grid_id, 'week_of_year', week_of_year, avg(value) FROM p GROUP BY ALL
       UNION ALL SELECT grid_id, 'month', month, avg(value) FROM p GROUP BY ALL
       UNION ALL SELECT grid_id, 'year', year, avg(value) FROM p GROUP BY ALL""")
def _(t):
    return A.climatology(t.labels_grid, "grid_id", "date", ["value"])


@query("agg_extremes", """
       SELECT min(latitude) AS min_latitude, max(latitude) AS max_latitude, min(longitude) AS min_longitude,
              max(longitude) AS max_longitude FROM {labels_station}""")
def _(t):
    return A.extremes(t.labels_station, ["latitude", "longitude"])


@query("agg_counts", """
       SELECT count(*) AS n_rows, count(DISTINCT grid_id) AS n_grid_id, count(DISTINCT date) AS n_date FROM {labels_grid}""")
def _(t):
    return A.counts(t.labels_grid, "grid_id", "date")


@query("agg_collapse_texts", """
       SELECT grid_id, location, value, avg(label_id) AS label_id FROM {labels_grid} GROUP BY grid_id, location, value""")
def _(t):
    return A.collapse_texts(t.labels_grid, "value")


_COLLAPSE = f"""
       SELECT grid_id, {d_text('date')} AS date, avg(pred) AS pred_mean, min(pred) AS pred_min, max(pred) AS pred_max,
              quantile_disc(pred, 0.5) AS pred_median FROM {{predictions}} GROUP BY grid_id, date"""


@query("agg_collapse_predictions", _COLLAPSE)
def _(t):
    return A.collapse_predictions(t.predictions, ["grid_id", "date"])


@query("agg_collapse_predictions_exact", _COLLAPSE)
def _(t):
    return A.collapse_predictions(t.predictions, ["grid_id", "date"], exact=True)


@query("agg_expand_predictions", f"""
       SELECT grid_id, {d_text('date')} AS date, """ + ", ".join(
    f"coalesce(max(pred) FILTER (WHERE place = {i}), 0) AS pred{i}" for i in range(1, 21)) + """
       FROM (SELECT *, row_number() OVER (PARTITION BY grid_id, date ORDER BY rank, l_partkey, pred) AS place FROM {predictions})
       GROUP BY grid_id, date""")
def _(t):
    return A.expand_predictions(t.predictions, ["grid_id", "date"], ["rank", "l_partkey", "pred"])


_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]


@query("agg_correlations", " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, {r6(f'corr({a}, {b})')} AS r FROM {{lineitem}}" for a, b in _PAIRS))
def _(t):
    return rounded(A.correlations(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]), "r")


def _rank_sql(c):
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0 AS {c}"


@query("agg_correlations_spearman", " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, {r6(f'corr({a}, {b})')} AS r FROM (SELECT {_rank_sql(a)}, {_rank_sql(b)} FROM {{lineitem}})"
    for a, b in _PAIRS))
def _(t):
    return rounded(A.correlations(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"], "spearman"), "r")


@query("agg_pair_correlation", f"""
       SELECT {r6('corr(min_elevation, value)')} AS r FROM {{labels_grid}} JOIN {{elevation}} USING (grid_id)""")
def _(t):
    joined = t.labels_grid.join(t.elevation, "grid_id")
    return rounded(joined.agg(F.corr("min_elevation", "value").alias("r")), "r")


@query("agg_describe", " UNION ALL ".join(f"""
       SELECT '{c}' AS "column", count({c}) + 0e0 AS n, avg({c}) AS mean, {r6(f'stddev_samp({c})')} AS std, min({c}) + 0e0 AS low,
              max({c}) + 0e0 AS high FROM {{aod_cells}}""" for c in ("AOD_Uncertainty", "Optical_Depth_047", "AOD_QA")))
def _(t):
    return rounded(A.describe(t.aod_cells, ["AOD_Uncertainty", "Optical_Depth_047", "AOD_QA"]), "std")


@query("agg_class_hit_rate", f"""
       WITH c AS (SELECT {aqi_sql('actual')} AS actual_aqi, CAST({aqi_sql('actual')} = {aqi_sql('prediction')} AS INT) AS hit FROM {{scored}})
       SELECT actual_aqi, CAST(sum(hit) AS BIGINT) AS aqi_hit, count(*) AS count, sum(hit) / count(*) AS percentage FROM c GROUP BY actual_aqi""")
def _(t):
    rows = t.scored.select(X.aqi_class(F.col("actual")).alias("actual_aqi"),
                           X.aqi_hit(F.col("actual"), F.col("prediction")).alias("aqi_hit"))
    return A.class_hit_rate(rows)


@query("agg_mean_error", f"""
       SELECT avg(prediction) AS prediction, avg(actual) AS actual, abs(avg(prediction) - avg(actual)) AS abs_mean_error,
              {r6('sqrt(avg((prediction - actual) * (prediction - actual)))')} AS rmse FROM {{scored}}""")
def _(t):
    return rounded(A.mean_error(t.scored), "rmse")


@query("agg_catalog_counts", f"""
       SELECT location, {ts_text('time_end')} AS time_end, count(*) AS n FROM {{sat_metadata}} GROUP BY location, time_end""")
def _(t):
    return t.sat_metadata.groupBy("location", "time_end").agg(F.count(F.lit(1)).alias("n"))


@query("agg_distinct_values", "SELECT DISTINCT city FROM {labels_station}")
def _(t):
    return t.labels_station.select("city").distinct()


@query("agg_repeated_keys", f"""
       SELECT grid_id, {d_text('date')} AS date, count(*) AS count FROM {{labels_grid}} GROUP BY grid_id, date HAVING count(*) > 1""")
def _(t):
    return A.repeated_keys(t.labels_grid, ["grid_id", "date"])


@query("set_union_by_position", """
       SELECT event_id AS id, user_id AS part FROM {events} UNION ALL SELECT o_orderkey, o_custkey FROM {orders}""")
def _(t):
    a = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("part"))
    return sets.stack(a, t.orders.select("o_orderkey", "o_custkey"), by_position=True)


@query("set_union_by_name", """
       SELECT event_id AS id, user_id AS part, NULL::VARCHAR AS status FROM {events}
       UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM {orders}""")
def _(t):
    a = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("part"))
    b = t.orders.select(F.col("o_custkey").alias("part"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return sets.stack(a, b, allow_missing=True)


@query("ord_by_key", f"""
       SELECT {ts_text('datetime')} AS datetime, grid_id, value FROM {{labels_grid}} ORDER BY datetime, grid_id""")
def _(t):
    return sets.ordered(t.labels_grid.select("datetime", "grid_id", "value"), "datetime", "grid_id")


@query("ord_by_value", "SELECT l_orderkey, l_linenumber, actual FROM {scored} ORDER BY actual")
def _(t):
    return sets.ordered(t.scored.select("l_orderkey", "l_linenumber", "actual"), "actual")


@query("ord_top_ten", """
       SELECT grid_id, sum(value) AS total FROM {labels_grid} GROUP BY grid_id ORDER BY total DESC, grid_id LIMIT 10""")
def _(t):
    totals = t.labels_grid.groupBy("grid_id").agg(F.sum("value").alias("total"))
    return sets.top(totals, 10, "total", ["grid_id"])


@query("ord_first_rows", """
       SELECT granule_id, us_url FROM {sat_metadata} ORDER BY granule_id LIMIT 218""")
def _(t):
    return sets.top(t.sat_metadata.select("granule_id", "us_url"), 218, "granule_id", descending=False)


@query("agg_sketch_windows", """
       WITH m AS (SELECT grid_id, CAST(date_trunc('month', utc_date) AS DATE) AS month, AOD_Uncertainty AS x FROM {aod_cells}),
       q AS (SELECT DISTINCT grid_id, month FROM m)
       SELECT q.grid_id, CAST(q.month AS VARCHAR) AS month, count(x) AS n_AOD_Uncertainty, min(x) AS min_AOD_Uncertainty, max(x) AS max_AOD_Uncertainty, true AS within
       FROM q JOIN m ON q.grid_id = m.grid_id AND m.month >= q.month - INTERVAL '62' DAY AND m.month <= q.month GROUP BY 1, 2""")
def _(t):
    cells = t.aod_cells.withColumn("month", F.to_date(F.date_trunc("month", "utc_date")))
    sketches = settle(quantile_sketches(cells, ["grid_id", "month"], ["AOD_Uncertainty"]))
    asked = sketches.select("grid_id", F.col("month").alias("asked"))
    found = window_quantiles(sketches, asked, ["grid_id"], "month", "asked", ["AOD_Uncertainty"], {"median": 0.5}, back=62)
    # the medians' ranks among all rows of their windows
    months = F.sequence(F.trunc(F.date_sub("asked", 62), "month"), F.col("asked"), F.expr("INTERVAL 1 MONTH"))
    days = found.withColumn("month", F.explode(months)).where(F.col("month") >= F.date_sub("asked", 62))
    rows = days.join(cells.select("grid_id", "month", "AOD_Uncertainty"), ["grid_id", "month"])
    names = ["n_AOD_Uncertainty", "min_AOD_Uncertainty", "max_AOD_Uncertainty"]
    ranked = rows.groupBy("grid_id", "asked", *names).agg(
        F.avg((F.col("AOD_Uncertainty") < F.col("median_AOD_Uncertainty")).cast("double")).alias("below"),
        F.avg((F.col("AOD_Uncertainty") <= F.col("median_AOD_Uncertainty")).cast("double")).alias("reached"))
    within = (F.col("below") <= 0.5 + ERROR) & (F.col("reached") >= 0.5 - ERROR)
    return ranked.select("grid_id", F.col("asked").alias("month"), *names, within.alias("within"))
