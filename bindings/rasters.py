"""Granules, cubes and elevation rasters."""

from pyspark.sql import functions as F

from airgrid.constants import SPHERE_RADIUS_M
from airgrid.functions.geo import polygon_bounds
from airgrid.operators import raster as R
from airgrid.operators.joins import cells_in_boxes
from bindings.registry import d_text, query, r6, rounded

_LAT = f"degrees((y0 + row * (y1 - y0) / n_rows) / {SPHERE_RADIUS_M}e0)"
_LON = (f"degrees((x0 + col * (x1 - x0) / n_cols) / ({SPHERE_RADIUS_M}e0 * "
        f"cos((y0 + row * (y1 - y0) / n_rows) / {SPHERE_RADIUS_M}e0)))")


@query("ras_cell_coordinates", f"""
       SELECT granule_id, layer, row, col, {r6(_LON)} AS lon, {r6(_LAT)} AS lat FROM {{granules}}""")
def _(t):
    placed = R.with_cell_coordinates(t.granules)
    return rounded(placed.select("granule_id", "layer", "row", "col", "lon", "lat"), "lon", "lat")


def _corner(pattern, group):
    return f"CAST(regexp_extract(metadata, '{pattern}=\\(([+-]?[0-9]+\\.[0-9]+),([+-]?[0-9]+\\.[0-9]+)\\)', {group}) AS DOUBLE)"


@query("ras_corners", f"""
       SELECT granule_id, {_corner('UpperLeftPointMtrs', 1)} AS x0, {_corner('UpperLeftPointMtrs', 2)} AS y0,
              {_corner('LowerRightMtrs', 1)} AS x1, {_corner('LowerRightMtrs', 2)} AS y1 FROM {{granule_texts}}""")
def _(t):
    return R.with_corners(t.granule_texts).drop("metadata")


def _arrays(t):
    """Rasters of 11 rows as two-dimensional arrays, two bands."""
    rows = t.raster.groupBy("raster_id", "row").agg(
        F.array_sort(F.collect_list(F.struct("col", "elevation"))).alias("cells"))
    grids = rows.groupBy("raster_id").agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("rows"))
    return grids.select("raster_id", F.transform("rows", lambda r: r["cells"]["elevation"]).alias("high"),
                        F.transform("rows", lambda r: F.transform(r["cells"]["elevation"], lambda e: -e)).alias("low"))


@query("ras_flatten_bands", """
       SELECT raster_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col, elevation AS high, -elevation AS low FROM {raster}""")
def _(t):
    return R.flatten_bands(_arrays(t), ["high", "low"], ["raster_id"])


@query("ras_explode_layers", """
       SELECT raster_id, CAST(0 AS INT) AS layer, sum(elevation) AS total FROM {raster} GROUP BY raster_id
       UNION ALL SELECT raster_id, CAST(1 AS INT), -sum(elevation) FROM {raster} GROUP BY raster_id""")
def _(t):
    layered = _arrays(t).select("raster_id", F.array("high", "low").alias("layers"))
    out = R.explode_layers(layered, "layers", ["raster_id"])
    return out.select("raster_id", "layer", F.aggregate(F.flatten("band"), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("ras_mean_of_layers", """
       SELECT granule_id, row, col, avg(CASE WHEN raw <> 13 THEN raw END) AS raw FROM {granules} GROUP BY granule_id, row, col""")
def _(t):
    marked = t.granules.withColumn("raw", F.when(F.col("raw") == 13, F.lit(float("nan"))).otherwise(F.col("raw")))
    return R.mean_of_layers(marked, ["granule_id", "row", "col"], ["raw"])


@query("ras_fill_to_null", """
       SELECT granule_id, layer, row, col, CASE WHEN raw <> 13 THEN (raw - 2) * 0.5 END AS value FROM {granules}""")
def _(t):
    return t.granules.select("granule_id", "layer", "row", "col", R.fill_to_null(F.col("raw"), 13.0, 0.5, 2.0).alias("value"))


@query("ras_range_to_null", """
       SELECT granule_id, layer, row, col, CASE WHEN raw <> 13 AND raw >= 3 AND raw <= 45 THEN (raw - 2) * 0.5 END AS value FROM {granules}""")
def _(t):
    value = R.range_to_null(F.col("raw"), 13.0, 3.0, 45.0, 0.5, 2.0)
    return t.granules.select("granule_id", "layer", "row", "col", value.alias("value"))


_WORD = "lpad(bin(AOD_QA), 16, '0')"


@query("ras_keep_good_quality", f"""
       SELECT granule_id, layer, row, col, raw, CASE WHEN {_WORD}[1:3] IN ('000', '001', '010') AND {_WORD}[6:8] IN ('000', '011')
              THEN raw_b END AS raw_b FROM {{granules}}""")
def _(t):
    return R.keep_good_quality(t.granules, ["raw_b"]).select("granule_id", "layer", "row", "col", "raw", "raw_b")


_INSIDE = "lon >= min_lon AND lon <= max_lon AND lat >= min_lat AND lat <= max_lat"


@query("ras_cells_in_boxes", f"""
       SELECT c.grid_id AS cell_grid, b.grid_id, index FROM {{aod_cells}} c JOIN {{boxes}} b ON {_INSIDE}""")
def _(t):
    boxes = t.grids.select("grid_id", *polygon_bounds(F.col("wkt")))
    cells = t.aod_cells.withColumnRenamed("grid_id", "cell_grid").select("cell_grid", "index", "lon", "lat")
    return cells_in_boxes(cells, boxes).select("cell_grid", "grid_id", "index")


@query("ras_box_means", f"""
       SELECT b.grid_id, {d_text('utc_date')} AS utc_date, avg(Optical_Depth_047) AS Optical_Depth_047, avg(Column_WV) AS Column_WV
       FROM {{aod_cells}} c JOIN {{boxes}} b ON {_INSIDE} GROUP BY b.grid_id, utc_date""")
def _(t):
    return R.box_means(t.aod_cells.drop("grid_id"), t.boxes, ["grid_id", "utc_date"], ["Optical_Depth_047", "Column_WV"])


@query("ras_flatten_variables", """
       SELECT raster_id, CASE WHEN elevation <> 113 THEN elevation END AS "Latitude", elevation AS "Elevation" FROM {raster}""")
def _(t):
    flat = _arrays(t).select("raster_id", F.flatten("high").alias("Latitude"), F.flatten("high").alias("Elevation"))
    return R.flatten_variables(flat, ["Latitude", "Elevation"], ["raster_id"], F.lit(113.0), ["Latitude"])


@query("ras_cube_slice", f"""
       SELECT b.grid_id, count(*) AS n, sum(co) AS co FROM {{geos}} g JOIN {{boxes}} b ON {_INSIDE}
       WHERE time >= TIMESTAMP '1997-03-01 00:00:00' AND time <= TIMESTAMP '1999-02-28 12:00:00' GROUP BY b.grid_id""")
def _(t):
    cut = R.cube_slice(t.geos.drop("grid_id"), t.boxes, F.lit("1997-03-01 00:00:00").cast("timestamp_ntz"),
                       F.lit("1999-02-28 12:00:00").cast("timestamp_ntz"))
    return cut.groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"), F.sum("co").alias("co"))


_VARS, _SLOTS = ["t_surface", "u_pbl", "v_pbl"], ["00", "06", "12", "18"]
_WIDE = ", ".join(f"max(value) FILTER (WHERE var = '{v}' AND slot = '{s}') AS {v}{s}" for s in _SLOTS for v in _VARS)


@query("ras_variables_to_columns", f"SELECT grid_id, {d_text('date')} AS date, {_WIDE} FROM {{gfs_long}} GROUP BY grid_id, date")
def _(t):
    return R.variables_to_columns(t.gfs_long, ["grid_id", "date"], _VARS, _SLOTS)


@query("ras_slots_from_first", f"""
       SELECT grid_id, {d_text('date')} AS date, {_WIDE} FROM {{gfs_long}} GROUP BY grid_id, date
       HAVING count(*) FILTER (WHERE var = 't_surface' AND slot = '00') > 0""")
def _(t):
    return R.variables_to_columns(t.gfs_long, ["grid_id", "date"], _VARS, _SLOTS, from_first_slot=True)


@query("ras_join_variables", f"""
       SELECT a.grid_id, {d_text('a.date')} AS date, a.place, a.v AS t_surface, b.v AS u_pbl
       FROM (SELECT grid_id, date, place, max(value) AS v FROM {{gfs_long}} WHERE var = 't_surface' GROUP BY ALL) a
       LEFT JOIN (SELECT grid_id, date, place, max(value) AS v FROM {{gfs_long}} WHERE var = 'u_pbl' GROUP BY ALL) b
         USING (grid_id, date, place)""")
def _(t):
    return R.join_variables(t.gfs_long, ["grid_id", "date", "place"], ["t_surface", "u_pbl"])


@query("ras_stack_frames", f"SELECT grid_id, {d_text('date')} AS date, value FROM {{gfs_long}}")
def _(t):
    from airgrid.operators.sets import stack

    return stack(*[t.gfs_long.where(F.col("slot") == s).select("grid_id", "date", "value") for s in _SLOTS])


BLOCKS = """(SELECT raster_id, row // 5 AS block_row, col // 5 AS block_col, avg(elevation) AS elevation FROM (
    SELECT *, max(row) OVER (PARTITION BY raster_id) AS lr, max(col) OVER (PARTITION BY raster_id) AS lc FROM {raster})
    WHERE row < lr AND col < lc GROUP BY ALL)"""


@query("ras_coarsen", f"SELECT raster_id, block_row, block_col, elevation FROM {BLOCKS}")
def _(t):
    return R.coarsen(t.raster, ["raster_id"], "elevation")


def summary_sql(source):
    return f"""
       SELECT raster_id, {r6('min(elevation)')} AS min_elevation, {r6('max(elevation)')} AS max_elevation, {r6('avg(elevation)')} AS avg_elevation,
              {r6('quantile_cont(elevation, 0.25)')} AS pertl25_elevation, {r6('quantile_cont(elevation, 0.75)')} AS pertl75_elevation,
              {r6('quantile_cont(elevation, 0.5)')} AS median_elevation FROM {source} GROUP BY raster_id"""


STATISTICS = [f"{s}_elevation" for s in ("min", "max", "avg", "pertl25", "pertl75", "median")]


@query("ras_elevation_summary", summary_sql("{raster}"))
def _(t):
    return rounded(R.elevation_summary(t.raster, ["raster_id"]), *STATISTICS)


@query("ras_elevation_by_point", f"""
       SELECT raster_id % 7 + 0e0 AS latitude, raster_id % 3 + 0e0 AS longitude, min(elevation) AS min_elevation,
              max(elevation) AS max_elevation, avg(elevation) AS avg_elevation FROM {{raster}} GROUP BY 1, 2""")
def _(t):
    placed = t.raster.withColumns({"latitude": (F.col("raster_id") % 7).cast("double"),
                                   "longitude": (F.col("raster_id") % 3).cast("double")})
    return R.elevation_summary(placed, ["latitude", "longitude"], percentiles=False)


@query("ras_pick_dataset", "SELECT grid_id, value FROM {gfs_long} WHERE var = 'u_pbl'")
def _(t):
    return R.pick_dataset(t.gfs_long, "u_pbl", "var").select("grid_id", "value")
