"""Logical tables derived from the driver's tables by SQL that Spark and DuckDB both read.

Measured values are whole numbers held as doubles, so that sums do not depend on their order.
"""

from airgrid.constants import GFS_VARIABLES, SLOTS

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
                 "embeddings", "pages", "benchmark", "labels", "conversations")


def _lon10(key):
    """Longitude of a grid's centre in tenths of a degree."""
    return (f"(CASE {key} % 3 WHEN 0 THEN 770 WHEN 1 THEN -1180 ELSE 1210 END"
            f" + (CAST(floor({key} / 3) AS BIGINT) % 40) * 4 - 80)")


def _lat10(key):
    return (f"(CASE {key} % 3 WHEN 0 THEN 280 WHEN 1 THEN 340 ELSE 250 END"
            f" + (CAST(floor({key} / 120) AS BIGINT) % 40) * 4 - 80)")


def _tenths(expression):
    return (f"concat(CASE WHEN {expression} < 0 THEN '-' ELSE '' END, "
            f"CAST(CAST(floor(abs({expression}) / 10) AS BIGINT) AS STRING), '.', "
            f"CAST(abs({expression}) % 10 AS STRING))")


def _location(key):
    return f"CASE {key} % 3 WHEN 0 THEN 'Delhi' WHEN 1 THEN 'Los Angeles (SoCAB)' ELSE 'Taipei' END"


def _vertex(dx, dy):
    return f"{_tenths(f'(x {dx})')}, ' ', {_tenths(f'(y {dy})')}"


_GRID_OF_ORDER = "CAST(floor(o_custkey / 15) AS BIGINT)"


def _slots(value, slot, full):
    """36 forecast columns; `value` makes a whole number from a variable's and a slot's number.

    A row fills one slot, or all four where `full` holds.
    """
    return ", ".join(
        f"max(CASE WHEN {slot} = {s} OR {full} THEN {value(i, s)} END) AS {v}{name}"
        for s, name in enumerate(SLOTS) for i, v in enumerate(GFS_VARIABLES))


LOGICAL = {
    # 4-sided cells; odd keys are trapezoids
    "grids": f"""
        SELECT concat('G', CAST(k AS STRING)) AS grid_id, {_location('k')} AS location,
               CASE k % 3 WHEN 0 THEN 'Asia/Calcutta' WHEN 1 THEN 'Etc/GMT+8' ELSE 'Asia/Taipei' END AS tz,
               concat('POLYGON ((', {_vertex('- 1', '- 1')}, ', ', {_vertex('- 1', '+ 1')}, ', ',
                      {_vertex('+ 1', '+ 1')}, ', ', {_vertex('+ 1 + (k % 2) * 2', '- 1')}, ', ',
                      {_vertex('- 1', '- 1')}, '))') AS wkt
        FROM (SELECT s_suppkey AS k, {_lon10('s_suppkey')} AS x, {_lat10('s_suppkey')} AS y FROM {{supplier}}) AS s""",
    "boxes": f"""
        SELECT concat('G', CAST(k AS STRING)) AS grid_id, (x - 1) / 10e0 AS min_lon, (x + 1 + (k % 2) * 2) / 10e0 AS max_lon,
               (y - 1) / 10e0 AS min_lat, (y + 1) / 10e0 AS max_lat
        FROM (SELECT s_suppkey AS k, {_lon10('s_suppkey')} AS x, {_lat10('s_suppkey')} AS y FROM {{supplier}}) AS s""",
    "centres": f"""
        SELECT concat('G', CAST(s_suppkey AS STRING)) AS grid_id, {_lon10('s_suppkey')} / 10e0 AS clon,
               {_lat10('s_suppkey')} / 10e0 AS clat FROM {{supplier}}""",
    "aod_cells": f"""
        SELECT l_orderkey * 10 + l_linenumber AS index,
               {_lon10('l_suppkey')} / 10e0 + (l_partkey % 21 - 10) * 0.025e0 AS lon,
               {_lat10('l_suppkey')} / 10e0 + (l_orderkey % 21 - 10) * 0.025e0 AS lat,
               CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE round(l_discount * 100) END AS Optical_Depth_047,
               round(l_tax * 100) AS Optical_Depth_055, l_quantity AS AOD_Uncertainty,
               CAST(l_partkey % 100 AS DOUBLE) AS FineModeFraction, CAST(l_linenumber AS DOUBLE) AS Column_WV,
               CAST(l_orderkey % 1000 AS DOUBLE) AS Injection_Height,
               CAST((l_orderkey * 7919 + l_partkey * 31) % 65536 AS INT) AS AOD_QA,
               concat('G', CAST(l_suppkey AS STRING)) AS grid_id, CAST(l_shipdate AS DATE) AS utc_date,
               l_shipdate + (l_partkey % 24) * INTERVAL '1' HOUR AS aod_reading_end
        FROM {{lineitem}}""",
    "labels_grid": f"""
        SELECT o_orderkey AS label_id, concat('G', CAST({_GRID_OF_ORDER} AS STRING)) AS grid_id,
               o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR AS datetime, CAST(o_orderdate AS DATE) AS date,
               round(o_totalprice / 1000) AS value, {_location(_GRID_OF_ORDER)} AS location
        FROM {{orders}}""",
    # cells of each label: the lines of its order
    "label_cells": f"""
        SELECT concat('G', CAST(g AS STRING)) AS grid_id, datetime, label_id,
               {_lon10('g')} / 10e0 + (l_partkey % 21 - 10) * 0.025e0 AS lon,
               {_lat10('g')} / 10e0 + (l_suppkey % 21 - 10) * 0.025e0 AS lat,
               CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE round(l_discount * 100) END AS Optical_Depth_047,
               round(l_tax * 100) AS Optical_Depth_055, l_quantity AS AOD_Uncertainty,
               CAST(l_linenumber AS DOUBLE) AS Column_WV,
               CAST((l_orderkey * 7919 + l_partkey * 31) % 65536 AS INT) AS AOD_QA
        FROM {{lineitem}} JOIN (
            SELECT o_orderkey AS label_id, {_GRID_OF_ORDER} AS g,
                   o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR AS datetime FROM {{orders}}) AS o
          ON l_orderkey = label_id""",
    "gfs": f"""
        SELECT concat('G', CAST(l_suppkey AS STRING)) AS grid_id, CAST(l_shipdate AS DATE) AS date,
               {_lat10('l_suppkey')} / 10e0 + (l_linenumber % 2) * 0.25e0 AS latitude,
               {_lon10('l_suppkey')} / 10e0 + 0.125e0 AS longitude,
               {_slots(lambda i, s: f"CAST((l_partkey * {i + 3} + l_linenumber * {s + 1}) % 97 - 20 AS DOUBLE)",
                       'l_orderkey % 4', 'l_partkey % 3 = 0')}
        FROM {{lineitem}} GROUP BY 1, 2, 3, 4""",
    "gfs_long": """
        SELECT concat('G', CAST(l_suppkey AS STRING)) AS grid_id, CAST(l_shipdate AS DATE) AS date,
               l_partkey % 3 AS place,
               CASE l_linenumber % 3 WHEN 0 THEN 't_surface' WHEN 1 THEN 'u_pbl' ELSE 'v_pbl' END AS var,
               CASE l_orderkey % 4 WHEN 0 THEN '00' WHEN 1 THEN '06' WHEN 2 THEN '12' ELSE '18' END AS slot,
               l_quantity AS value
        FROM {lineitem}""",
    "geos": f"""
        SELECT concat('G', CAST(l_suppkey AS STRING)) AS grid_id,
               l_shipdate + (l_partkey % 24) * INTERVAL '1' HOUR AS time,
               {_lat10('l_suppkey')} / 10e0 + (l_linenumber % 5) * 0.0625e0 AS lat,
               {_lon10('l_suppkey')} / 10e0 + (l_orderkey % 5) * 0.0625e0 AS lon,
               l_quantity AS pm25_rh35_gcc, CAST(l_partkey % 50 AS DOUBLE) AS co
        FROM {{lineitem}}""",
    "misr": f"""
        SELECT concat('G', CAST({_GRID_OF_ORDER} AS STRING)) AS grid_id,
               o_orderdate + (o_orderkey % 24 + CASE WHEN o_orderkey % 5 = 0 THEN 7 ELSE 0 END) * INTERVAL '1' HOUR
                 AS datetime,
               l_quantity AS Aerosol_Optical_Depth, CAST(l_partkey % 40 AS DOUBLE) AS Angstrom_Exponent_550_860nm
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    "elevation": """
        SELECT concat('G', CAST(s_suppkey AS STRING)) AS grid_id, floor(abs(s_acctbal)) + 0e0 AS min_elevation,
               floor(abs(s_acctbal)) + 40e0 AS max_elevation, floor(abs(s_acctbal)) + 20e0 AS avg_elevation
        FROM {supplier} WHERE s_suppkey % 10 <> 9""",
    "raster": """
        SELECT CAST(floor(p_partkey / 121) AS BIGINT) AS raster_id,
               CAST(floor((p_partkey % 121) / 11) AS BIGINT) AS row, p_partkey % 11 AS col,
               CAST(p_size * 10 + p_partkey % 7 AS DOUBLE) AS elevation
        FROM {part}""",
    "granules": f"""
        SELECT l_suppkey AS granule_id, l_linenumber % 3 AS layer, l_partkey % 30 AS row,
               CAST(floor(l_partkey / 30) AS BIGINT) % 40 AS col, 30 AS n_rows, 40 AS n_cols,
               l_quantity AS raw, round(l_discount * 100) AS raw_b,
               CAST((l_orderkey * 7919 + l_partkey * 31) % 65536 AS INT) AS AOD_QA,
               x - 20000 AS x0, {_lat10('l_suppkey')} * 11119e0 + 20000 AS y0,
               x + 20000 AS x1, {_lat10('l_suppkey')} * 11119e0 - 20000 AS y1
        FROM (SELECT *, {_lon10('l_suppkey')} * 11119e0 * cos(radians({_lat10('l_suppkey')} / 10e0)) AS x FROM {{lineitem}}) AS l""",
    "granule_texts": f"""
        SELECT s_suppkey AS granule_id, concat('GROUP=GridStructure UpperLeftPointMtrs=(',
               {_tenths(_lon10('s_suppkey'))}, ',', {_tenths(_lat10('s_suppkey'))}, ') LowerRightMtrs=(',
               {_tenths('(' + _lon10('s_suppkey') + ' + 4)')}, ',', {_tenths('(' + _lat10('s_suppkey') + ' - 4)')},
               ') END') AS metadata
        FROM {{supplier}}""",
    "labels_station": """
        SELECT event_id, concat('S', CAST(user_id AS STRING)) AS location, 'pm25' AS parameter,
               CASE user_id % 2 WHEN 0 THEN 'IN' ELSE 'US' END AS country,
               CASE WHEN user_id % 11 = 10 THEN NULL WHEN user_id % 4 = 0 THEN 'Delhi' WHEN user_id % 4 = 1 THEN 'LOS ANGELES'
                    WHEN user_id % 4 = 2 THEN 'Los Angeles-Long Beach-Santa Ana' ELSE '臺北市' END AS city,
               20 + (user_id % 50) * 0.25e0 AS latitude, 60 + floor(user_id / 50) * 0.25e0 AS longitude,
               ts AS datetime_utc, round(value * 6) - 5 AS value
        FROM {events}""",
    "aod_ee": """
        -- readings of some events stand where no station is
        SELECT event_id, 20 + (user_id % 50) * 0.25e0 + (event_id % 3) * 0.001e0 + CASE WHEN event_type = 'signup' THEN 0.05e0 ELSE 0e0 END AS latitude,
               60 + floor(user_id / 50) * 0.25e0 AS longitude, CAST(floor(EPOCH_US(ts) / 1000) AS BIGINT) - 3600000 AS time,
               ts - INTERVAL '1' HOUR AS aod_reading_time, CAST(event_id % 90 AS DOUBLE) AS Optical_Depth_047
        FROM {events}""",
    "points": f"""
        SELECT CAST(ts AS DATE) AS date, 20 + (event_id % 50) * 0.25e0 + 0.1e0 AS latitude,
               60 + (event_id % 4) * 0.25e0 AS longitude,
               {_slots(lambda i, s: f"CAST((event_id * {i + 3} + {s}) % 97 - 20 AS DOUBLE)", 'user_id % 4',
                       'event_id % 3 = 0')}
        FROM {{events}} GROUP BY 1, 2, 3""",
    "places": """
        SELECT DISTINCT latitude, longitude, floor(latitude * 10) + 0e0 AS min_elevation,
               floor(latitude * 10) + 50e0 AS max_elevation, floor(latitude * 10) + 20e0 AS avg_elevation
        FROM {labels_station} WHERE latitude < 32""",
    "sat_metadata": f"""
        SELECT o_orderkey AS granule_id, CASE o_orderkey % 3 WHEN 0 THEN 'misr' WHEN 1 THEN 'maiac' ELSE 'other' END AS product,
               {_location(_GRID_OF_ORDER)} AS location, {_GRID_OF_ORDER} AS area,
               CASE WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'train' END AS split,
               o_orderdate + (o_custkey % 24) * INTERVAL '1' HOUR AS time_end,
               concat('granule/', CAST(o_orderkey AS STRING),
                      CASE o_orderkey % 5 WHEN 0 THEN '.nc' WHEN 1 THEN '.tif' ELSE '.hdf' END) AS us_url
        FROM {{orders}}""",
    "predictions": """
        SELECT concat('G', CAST(l_suppkey AS STRING)) AS grid_id, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS date,
               l_quantity AS pred, l_orderkey * 10 + l_linenumber AS rank, l_partkey, CAST(l_linenumber * 10 AS DOUBLE) AS value
        FROM {lineitem}""",
    # a row per label of the deployed model: prediction from the line, actual from the order
    "scored": """
        SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS date, l_quantity * 6 AS prediction,
               l_quantity * 6 + (l_partkey % 61) - 30 AS actual
        FROM {lineitem}""",
    "comparison": """
        SELECT p_brand AS study, p_type AS model_name, sum(round(l_discount * 100)) / count(*) AS r2_score,
               sqrt(sum(l_linenumber * l_linenumber) / (count(*) * 100e0)) AS r2_std_dev, CAST(count(*) AS DOUBLE) AS runtime
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_brand, p_type""",
    # a row per order: a value that follows from its lines, with gaps in one feature
    "training": f"""
        SELECT o_orderkey AS label_id, concat('G', CAST({_GRID_OF_ORDER} AS STRING)) AS grid_id, {_location(_GRID_OF_ORDER)} AS location,
               CAST(o_orderdate AS DATE) AS date, o_orderpriority AS priority, sum(l_quantity) AS x1,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE sum(round(l_discount * 100)) END AS x2,
               CAST(count(*) AS DOUBLE) AS x3,
               2 * sum(l_quantity) + 5 * sum(round(l_discount * 100)) + CAST(o_custkey % 17 AS DOUBLE) AS value
        FROM {{orders}} JOIN {{lineitem}} ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate, o_orderpriority""",
    "daily_grid": """
        SELECT grid_id, date, CAST(max(value) AS DOUBLE) AS value, CAST(min(label_id) AS BIGINT) AS label_id
        FROM {labels_grid} GROUP BY grid_id, date""",
}

#: Tables summed up from another one's rows: that table, and the columns by which its rows come to one task beforehand.
DEALT = {"gfs": ("lineitem", "concat('G', CAST(l_suppkey AS STRING))", "CAST(l_shipdate AS DATE)")}
