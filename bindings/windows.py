"""Ranks, lags, trailing windows and calendar means."""

from pyspark.sql import functions as F

from airgrid.constants import TRAILING_DAYS, TRAILING_DAYS_WIDE
from airgrid.functions.geo import planar_distance
from airgrid.operators import windows as W
from airgrid.operators.aggregates import station_days
from airgrid.operators.ordering import exact_percentiles, percent_rank, row_positions
from bindings.registry import d_text, query, r6, rounded

_DISTANCE = "round(sqrt((lon - clon) * (lon - clon) + (lat - clat) * (lat - clat)), 9)"
_PLACED = f"""(SELECT index, grid_id, utc_date, AOD_QA, Optical_Depth_047, {_DISTANCE} AS distance
               FROM {{aod_cells}} JOIN {{centres}} USING (grid_id))"""


def _placed(t):
    joined = t.aod_cells.join(t.centres, "grid_id")
    return joined.select("index", "grid_id", "utc_date", "AOD_QA", "Optical_Depth_047", F.round(planar_distance(
        F.col("lon"), F.col("lat"), F.col("clon"), F.col("clat")), 9).alias("distance"))


@query("win_nearest_rank", f"""
       SELECT index, AOD_QA, dense_rank() OVER (PARTITION BY grid_id ORDER BY distance) AS distance_rank FROM {_PLACED}""")
def _(t):
    return W.nearest_rank(_placed(t), ["grid_id"], "distance").select("index", "AOD_QA", "distance_rank")


@query("win_keep_nearest_one", f"""
       SELECT index, AOD_QA, r AS distance_rank FROM (
         SELECT *, dense_rank() OVER (PARTITION BY grid_id, utc_date ORDER BY distance) AS r FROM {_PLACED}) WHERE r = 1""")
def _(t):
    return W.nearest_rank(_placed(t), ["grid_id", "utc_date"], "distance", 1).select("index", "AOD_QA", "distance_rank")


@query("win_keep_nearest_twenty", f"""
       SELECT index, AOD_QA, r AS distance_rank FROM (
         SELECT *, dense_rank() OVER (PARTITION BY grid_id ORDER BY distance) AS r FROM {_PLACED}) WHERE r <= 20""")
def _(t):
    return W.nearest_rank(_placed(t), ["grid_id"], "distance", 20).select("index", "AOD_QA", "distance_rank")


@query("win_keep_nearest_or_missing", f"""
       SELECT label_id, r AS distance_rank FROM {{labels_grid}} g LEFT JOIN (
         SELECT grid_id, utc_date, dense_rank() OVER (PARTITION BY grid_id, utc_date ORDER BY distance) AS r FROM {_PLACED}) c
         ON g.grid_id = c.grid_id AND g.date = c.utc_date WHERE r <= 2 OR r IS NULL""")
def _(t):
    ranked = W.nearest_rank(_placed(t), ["grid_id", "utc_date"], "distance", 5)
    joined = t.labels_grid.join(ranked.withColumnRenamed("utc_date", "date"), ["grid_id", "date"], "left")
    return W.keep_nearest(joined, 2, keep_missing=True).select("label_id", "distance_rank")


@query("win_percent_rank", "SELECT label_id, percent_rank() OVER (ORDER BY date) AS rank FROM {labels_grid}")
def _(t):
    return percent_rank(t.labels_grid, "date").select("label_id", "rank")


@query("win_percent_rank_by_location", """
       SELECT label_id, percent_rank() OVER (PARTITION BY location ORDER BY value) AS rank FROM {labels_grid}""")
def _(t):
    return percent_rank(t.labels_grid, "value", keys=["location"]).select("label_id", "rank")


@query("win_exact_percentiles", f"""
       SELECT l_suppkey, {r6('quantile_cont(l_extendedprice, 0.25)')} AS q25, {r6('quantile_cont(l_extendedprice, 0.5)')} AS q50,
              {r6('quantile_cont(l_extendedprice, 0.9)')} AS q90 FROM {{lineitem}} GROUP BY l_suppkey""")
def _(t):
    return rounded(exact_percentiles(t.lineitem, ["l_suppkey"], "l_extendedprice", {"q25": 0.25, "q50": 0.5, "q90": 0.9}),
                   "q25", "q50", "q90")


@query("win_row_positions", """
       SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS position FROM {events}""")
def _(t):
    return row_positions(t.events, ["event_type"], "event_id").select("event_id", "position")


@query("win_calendar_means", """
       SELECT label_id, avg(value) OVER (PARTITION BY grid_id, dayofweek(date)) AS avg_weekday_value,
              avg(value) OVER (PARTITION BY grid_id, dayofyear(date)) AS avg_daily_value,
              avg(value) OVER (PARTITION BY grid_id, week(date)) AS avg_weekly_value,
              avg(value) OVER (PARTITION BY grid_id, month(date)) AS avg_monthly_value,
              avg(value) OVER (PARTITION BY grid_id, year(date)) AS avg_yearly_value FROM {labels_grid}""")
def _(t):
    out = W.calendar_means(t.labels_grid, "grid_id", "date", ["value"])
    return out.select("label_id", *[f"avg_{n}_value" for n in W.CALENDAR])


def _trailing_sql(days, table, key, time, seconds, column):
    frames = ", ".join(
        f"avg({column}) OVER (PARTITION BY {key} ORDER BY {seconds} RANGE BETWEEN {d * 86400} PRECEDING AND CURRENT ROW)"
        f" AS trailing{d}d_{column}" for d in days)
    return f"SELECT label_id, {frames} FROM {{{table}}}"


_SECONDS = "CAST(floor(epoch(datetime)) AS BIGINT)"


@query("win_trailing_means", _trailing_sql(TRAILING_DAYS, "labels_grid", "grid_id", "datetime", _SECONDS, "value"))
def _(t):
    out = W.trailing_means(t.labels_grid, ["grid_id"], "datetime", ["value"], TRAILING_DAYS)
    return out.select("label_id", *[f"trailing{d}d_value" for d in TRAILING_DAYS])


@query("win_trailing_means_wide", _trailing_sql(TRAILING_DAYS_WIDE, "labels_grid", "grid_id", "datetime", _SECONDS, "value"))
def _(t):
    out = W.trailing_means(t.labels_grid, ["grid_id"], "datetime", ["value"], TRAILING_DAYS_WIDE)
    return out.select("label_id", *[f"trailing{d}d_value" for d in TRAILING_DAYS_WIDE])


_EVENT_SECONDS = "CAST(floor(epoch_us(datetime_utc) / 1000000) AS BIGINT)"


@query("win_trailing_day", f"""
       SELECT event_id, avg(value) OVER (PARTITION BY location ORDER BY {_EVENT_SECONDS}
              RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS trailing1d_value FROM {{labels_station}}""")
def _(t):
    return W.trailing_means(t.labels_station, ["location"], "datetime_utc", ["value"], [1]) \
        .select("event_id", "trailing1d_value")


@query("win_trailing_label", f"""
       SELECT event_id, avg(value) OVER (PARTITION BY location ORDER BY {_EVENT_SECONDS}
              RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS trailing1d_value FROM {{labels_station}}""")
def _(t):
    return W.trailing_means(t.labels_station, ["location"], "datetime_utc", ["value"], [1], label_columns=("value",)) \
        .select("event_id", "trailing1d_value")


_DAILY = """(SELECT CAST(datetime_utc AS DATE) AS date_utc, location, avg(value) AS value FROM {labels_station} GROUP BY 1, 2)"""


def _daily(t):
    return station_days(t.labels_station, ["location"])


@query("win_row_lags", f"""
       SELECT {d_text('date_utc')} AS date_utc, location, lag(value, 1) OVER w AS lag1, lag(value, 7) OVER w AS lag7,
              lag(value, 30) OVER w AS lag30 FROM {_DAILY} WINDOW w AS (PARTITION BY location ORDER BY date_utc)""")
def _(t):
    lags = {f"lag{k}": ("value", k) for k in (1, 7, 30)}
    return W.lag_rows(_daily(t), ["location"], "date_utc", lags, one_per_day=True).select("date_utc", "location", *lags)


@query("win_row_lags_long_series", """
       SELECT event_id, lag(value, 1) OVER w AS lag1, lag(value, 7) OVER w AS lag7, lag(value, 30) OVER w AS lag30
       FROM {labels_station} WINDOW w AS (PARTITION BY parameter ORDER BY event_id)""")
def _(t):
    lags = {f"lag{k}": ("value", k) for k in (1, 7, 30)}
    return W.lag_rows(t.labels_station, ["parameter"], "event_id", lags, chunk=512).select("event_id", *lags)


@query("win_day_lags", f"""
       SELECT {d_text('a.date_utc')} AS date_utc, a.location, b.value AS lag1, c.value AS lag7
       FROM {_DAILY} a LEFT JOIN {_DAILY} b ON a.location = b.location AND b.date_utc = a.date_utc - INTERVAL '1' DAY
       LEFT JOIN {_DAILY} c ON a.location = c.location AND c.date_utc = a.date_utc - INTERVAL '7' DAY""")
def _(t):
    out = W.lag_days(_daily(t).select("location", "date_utc", "value"), ["location"], "date_utc", "value", {"lag1": 1, "lag7": 7})
    return out.drop("value")


@query("win_difference", f"""
       SELECT * FROM (SELECT {d_text('date_utc')} AS date_utc, location,
         {r6('value - lag(value, 3) OVER (PARTITION BY location ORDER BY date_utc)')} AS difference FROM {_DAILY})
       WHERE difference IS NOT NULL""")
def _(t):
    out = W.difference(_daily(t), ["location"], "date_utc", "value", 3, one_per_day=True)
    return rounded(out.select("date_utc", "location", "difference"), "difference")


@query("win_difference_lags", f"""
       WITH a AS (SELECT *, lag(value, 1) OVER w AS value_lag1day, lag(value, 7) OVER w AS value_lag7day,
                  lag(value, 30) OVER w AS value_lag30day FROM {_DAILY} WINDOW w AS (PARTITION BY location ORDER BY date_utc)),
       b AS (SELECT *, value_lag1day - value AS difflag FROM a)
       SELECT {d_text('date_utc')} AS date_utc, location, value_lag1day, value_lag7day, value_lag30day, {r6('difflag')} AS difflag,
              {r6('lag(difflag, 1) OVER w')} AS difflag_lag1day, {r6('lag(difflag, 7) OVER w')} AS difflag_lag7day,
              {r6('lag(difflag, 30) OVER w')} AS difflag_lag30day FROM b WINDOW w AS (PARTITION BY location ORDER BY date_utc)""")
def _(t):
    out = W.day_difference_lags(_daily(t), ["location"], "date_utc").drop("value", "datetime_utc")
    return rounded(out, "difflag", "difflag_lag1day", "difflag_lag7day", "difflag_lag30day")


@query("win_autocorrelation", f"""
       WITH s AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY date_utc) AS i, count(*) OVER (PARTITION BY location) AS n,
                  value - avg(value) OVER (PARTITION BY location) AS d FROM {_DAILY}),
       v AS (SELECT location, any_value(n) AS n, sum(d * d) AS whole FROM s GROUP BY location),
       k AS (SELECT unnest(range(0, 201)) AS lag),
       p AS (SELECT a.location, a.i - b.i AS lag, sum(a.d * b.d) AS p FROM s a JOIN s b ON a.location = b.location AND a.i - b.i BETWEEN 0 AND 200 GROUP BY 1, 2)
       SELECT v.location, CAST(k.lag AS INT) AS lag, CASE WHEN whole > 0 THEN {r6('coalesce(p.p, 0) / whole')} END AS acf FROM v JOIN k ON k.lag < n
       LEFT JOIN p ON p.location = v.location AND p.lag = k.lag""")
def _(t):
    return rounded(W.autocorrelation(_daily(t), ["location"], "date_utc", "value", 200, one_per_day=True), "acf")


@query("win_last_days", f"""
       SELECT event_id, {d_text('datetime_utc')} AS date_utc, value FROM {{labels_station}}
       WHERE country = 'IN' AND CAST(datetime_utc AS DATE) >= DATE '2024-01-11' ORDER BY datetime_utc DESC""")
def _(t):
    dated = t.labels_station.withColumn("date_utc", F.to_date("datetime_utc"))
    return W.last_days(dated, "date_utc", 20, "2024-01-31", F.col("country") == "IN").select("event_id", "date_utc", "value")
