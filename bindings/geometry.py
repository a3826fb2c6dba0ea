"""Polygons, distances, keys and the quality word."""

from pyspark.sql import functions as F

from airgrid.functions import geo
from airgrid.functions.quality import binary_to_int, quality_fields, quality_keep, quality_text
from bindings.registry import query, r6, rounded

_NUMBERS = r"regexp_extract_all(wkt, '-?[0-9]+\.[0-9]+')"
_COORDINATES = f"""
    SELECT grid_id, [CAST(s AS DOUBLE) FOR s IN {_NUMBERS}] AS c FROM {{grids}}"""
_RING = f"""
    SELECT grid_id, [c[i] FOR i IN range(1, len(c) + 1, 2)] AS x,
           [c[i] FOR i IN range(2, len(c) + 1, 2)] AS y FROM ({_COORDINATES})"""


@query("geo_bounds", f"""
       SELECT grid_id, list_min(x) AS min_lon, list_max(x) AS max_lon, list_min(y) AS min_lat, list_max(y) AS max_lat
       FROM ({_RING})""")
def _(t):
    return t.grids.select("grid_id", *geo.polygon_bounds(F.col("wkt")))


@query("geo_bounds_buffered", f"""
       SELECT grid_id, {r6('list_min(x) - 0.15e0')} AS min_lon, {r6('list_max(x) + 0.15e0')} AS max_lon,
              {r6('list_min(y) - 0.15e0')} AS min_lat, {r6('list_max(y) + 0.15e0')} AS max_lat
       FROM ({_RING})""")
def _(t):
    out = t.grids.select("grid_id", *geo.polygon_bounds(F.col("wkt"), buffer=0.15))
    return rounded(out, "min_lon", "max_lon", "min_lat", "max_lat")


@query("geo_bounds_shifted", f"""
       SELECT grid_id, {r6('list_min(x) + 180 - 0.15e0')} AS min_lon, {r6('list_max(x) + 180 + 0.15e0')} AS max_lon,
              {r6('list_min(y) - 0.15e0')} AS min_lat, {r6('list_max(y) + 0.15e0')} AS max_lat
       FROM ({_RING})""")
def _(t):
    out = t.grids.select("grid_id", *geo.polygon_bounds(F.col("wkt"), buffer=0.15, lon_shift=180.0))
    return rounded(out, "min_lon", "max_lon", "min_lat", "max_lat")


@query("geo_unshift_longitude", f"""
       SELECT event_id, longitude - 180 AS unshifted, {r6("(longitude * 3 + 180) - 360 * floor((longitude * 3 + 180) / 360) - 180")} AS wrapped
       FROM {{labels_station}}""")
def _(t):
    lon = F.col("longitude")
    return rounded(t.labels_station.select(
        "event_id", geo.unshift_longitude(lon).alias("unshifted"), geo.wrap_longitude(lon * 3).alias("wrapped")), "wrapped")


# around the first vertex, for the same digits far from the origin
CENTROIDS = f"""(
       SELECT grid_id, any_value(x0) + sum((x[i] + x[i + 1]) * (x[i] * y[i + 1] - x[i + 1] * y[i])) / (3 * sum(x[i] * y[i + 1] - x[i + 1] * y[i])) AS clon,
              any_value(y0) + sum((y[i] + y[i + 1]) * (x[i] * y[i + 1] - x[i + 1] * y[i])) / (3 * sum(x[i] * y[i + 1] - x[i + 1] * y[i])) AS clat
       FROM (SELECT grid_id, x[1] AS x0, y[1] AS y0, unnest(range(1, len(x))) AS i, [v - x[1] FOR v IN x] AS x, [v - y[1] FOR v IN y] AS y
             FROM ({_RING})) GROUP BY grid_id)"""


@query("geo_centroid", f"SELECT grid_id, {r6('clon')} AS lon, {r6('clat')} AS lat FROM {CENTROIDS}")
def _(t):
    out = t.grids.select("grid_id", geo.polygon_centroid(F.col("wkt")).alias("c")).select("grid_id", "c.lon", "c.lat")
    return rounded(out, "lon", "lat")


@query("geo_point", """
       SELECT index, lon, lat, concat('POINT (', CAST(CAST(AOD_Uncertainty AS INT) AS VARCHAR), ' ',
              CAST(CAST(Column_WV AS INT) AS VARCHAR), ')') AS text FROM {aod_cells}""")
def _(t):
    cells = t.aod_cells.withColumns({"a": F.col("AOD_Uncertainty").cast("int"), "b": F.col("Column_WV").cast("int")})
    return cells.select("index", geo.point("lon", "lat").alias("p"), geo.point_text("a", "b").alias("text")) \
        .select("index", "p.lon", "p.lat", "text")


@query("geo_distance", f"""
       SELECT index, {r6('sqrt((lon - clon) * (lon - clon) + (lat - clat) * (lat - clat))')} AS distance
       FROM {{aod_cells}} JOIN {{centres}} USING (grid_id)""")
def _(t):
    joined = t.aod_cells.join(t.centres, "grid_id")
    return rounded(joined.select("index", geo.planar_distance(
        F.col("lon"), F.col("lat"), F.col("clon"), F.col("clat")).alias("distance")), "distance")


@query("geo_location_code", """
       SELECT event_id, city, CASE city WHEN 'Delhi' THEN 'dl' WHEN 'Los Angeles-Long Beach-Santa Ana' THEN 'la'
              WHEN 'LOS ANGELES' THEN 'la' WHEN '臺北市' THEN 'tpe' ELSE city END AS code FROM {labels_station}""")
def _(t):
    return t.labels_station.select("event_id", "city", geo.city_code(F.col("city")).alias("code"))


@query("geo_grid_code", """
       SELECT grid_id, CASE location WHEN 'Delhi' THEN 'dl' WHEN 'Los Angeles (SoCAB)' THEN 'la'
              WHEN 'Taipei' THEN 'tpe' END AS code FROM {grids}""")
def _(t):
    return t.grids.select("grid_id", geo.location_code(F.col("location")).alias("code"))


@query("geo_coordinate_key", """
       SELECT index, concat_ws('_', CAST(AOD_QA AS VARCHAR), CAST(index AS VARCHAR)) AS key FROM {aod_cells}""")
def _(t):
    return t.aod_cells.select("index", geo.coordinate_key("AOD_QA", "index").alias("key"))


@query("geo_rounded_key", """
       SELECT event_id, round(latitude, 2) AS lat_key, round(longitude, 1) AS lon_key FROM {aod_ee}
       WHERE event_id >= 0""")
def _(t):
    return t.aod_ee.select("event_id", geo.rounded_key(F.col("latitude")).alias("lat_key"),
                           geo.rounded_key(F.col("longitude"), 1).alias("lon_key"))


_WORD = "lpad(bin(AOD_QA), 16, '0')"


@query("qa_text", f"""
       SELECT index, CASE WHEN AOD_QA <> 0 THEN {_WORD} END AS literal, {_WORD} AS digits FROM {{aod_cells}}""")
def _(t):
    return t.aod_cells.select("index", quality_text(F.col("AOD_QA"), zero_as_null=True).alias("literal"),
                              quality_text(F.col("AOD_QA")).alias("digits"))


@query("qa_binary_to_int", """
       SELECT index, AOD_QA AS number FROM {aod_cells}""")
def _(t):
    return t.aod_cells.select("index", binary_to_int(quality_text(F.col("AOD_QA"))).alias("number"))


_FIELDS = [("AOD_QA_Cloud_Mask", 0, 3), ("AOD_QA_LWS_Mask", 3, 2), ("AOD_QA_Adj_Mask", 5, 3), ("AOD_Level", 8, 1),
           ("Algo_init", 9, 1), ("BRF_over_snow", 10, 1), ("BRF_climatology", 11, 1), ("AOD_QA_SC_Mask", 12, 3)]


@query("qa_fields", "SELECT index, " + ", ".join(
    f"(AOD_QA // {2 ** (16 - s - n)}) % {2 ** n} AS {name}" for name, s, n in _FIELDS) + " FROM {aod_cells}")
def _(t):
    return t.aod_cells.select("index", *quality_fields(F.col("AOD_QA")))


@query("qa_fields_text", "SELECT index, " + ", ".join(
    f"substring({_WORD}, {s + 1}, {n}) AS {name}_str" for name, s, n in _FIELDS) + " FROM {aod_cells}")
def _(t):
    return t.aod_cells.select("index", *quality_fields(F.col("AOD_QA"), as_text=True))


@query("qa_fields_one_based", "SELECT index, " + ", ".join(
    f"substring({_WORD}, {max(s, 1)}, {n}) AS {name}_str" for name, s, n in _FIELDS) + " FROM {aod_cells}")
def _(t):
    return t.aod_cells.select("index", *quality_fields(F.col("AOD_QA"), one_based=True, as_text=True))


@query("qa_keep_rule", f"""
       SELECT index, CASE WHEN substring({_WORD}, 1, 3) IN ('000', '001', '010')
              AND substring({_WORD}, 6, 3) IN ('000', '011') THEN Optical_Depth_055 END AS depth FROM {{aod_cells}}""")
def _(t):
    return t.aod_cells.select("index", F.when(quality_keep(F.col("AOD_QA")), F.col("Optical_Depth_055")).alias("depth"))
