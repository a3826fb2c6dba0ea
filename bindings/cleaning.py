"""Filters, sentinels, profiles and housekeeping."""

from pyspark.sql import functions as F

from airgrid.constants import DEPLOYED_FEATURES
from airgrid.functions.quality import quality_fields
from airgrid.operators import clean
from airgrid.operators.aggregates import max_by_key
from bindings.registry import d_text, query, ts_text

_CLOUD = "(AOD_QA // 8192) % 8"


@query("cln_valid_labels", "SELECT event_id, value FROM {labels_station} WHERE value > 0 AND value <= 600")
def _(t):
    return clean.valid_labels(t.labels_station).select("event_id", "value")


@query("cln_out_of_range", """
       SELECT count(*) FILTER (WHERE value < 0 OR latitude < 0) AS n_below,
              count(*) FILTER (WHERE value > 600 OR latitude > 600) AS n_above FROM {labels_station}""")
def _(t):
    return clean.out_of_range(t.labels_station, ["value", "latitude"])


@query("cln_not_null", "SELECT event_id, city FROM {labels_station} WHERE city IS NOT NULL")
def _(t):
    return clean.not_null(t.labels_station, "city").select("event_id", "city")


@query("cln_location_filter", "SELECT label_id, value FROM {labels_grid} WHERE location = 'Delhi' AND value > 100")
def _(t):
    return t.labels_grid.where("location = 'Delhi' AND value > 100").select("label_id", "value")


@query("cln_mask_bands", f"""
       SELECT index, CASE WHEN {_CLOUD} = 1 THEN Optical_Depth_047 END AS Optical_Depth_047,
              CASE WHEN {_CLOUD} = 1 THEN Column_WV END AS Column_WV FROM {{aod_cells}}""")
def _(t):
    cells = t.aod_cells.select("*", *quality_fields(F.col("AOD_QA")))
    masked = clean.mask_bands(cells, ["Optical_Depth_047", "Column_WV"], F.col("AOD_QA_Cloud_Mask") == 1)
    return masked.select("index", "Optical_Depth_047", "Column_WV")


@query("cln_cloud_filter", f"SELECT index, Optical_Depth_055 FROM {{aod_cells}} WHERE {_CLOUD} = 1")
def _(t):
    cells = t.aod_cells.select("*", *quality_fields(F.col("AOD_QA")))
    return cells.where("AOD_QA_Cloud_Mask = 1").select("index", "Optical_Depth_055")


def _marked(t):
    """Aerosol cells with all three spellings of missing."""
    number = F.col("index") % 10
    return t.aod_cells.select(
        "index",
        F.when(number == 1, F.lit(float("-inf"))).otherwise(F.col("AOD_Uncertainty")).alias("a"),
        F.when(number == 2, F.lit(float("nan"))).when(number == 3, F.lit(float("inf")))
        .otherwise(F.col("Optical_Depth_047")).alias("b"))


@query("cln_sentinel_to_null", """
       SELECT index, CASE WHEN index % 10 <> 1 THEN AOD_Uncertainty END AS a FROM {aod_cells}""")
def _(t):
    return clean.sentinel_to_null(_marked(t).select("index", "a"), ["a"])


@query("cln_nonfinite_to_null", """
       SELECT index, CASE WHEN index % 10 <> 1 THEN AOD_Uncertainty END AS a,
              CASE WHEN index % 10 NOT IN (2, 3) THEN Optical_Depth_047 END AS b FROM {aod_cells}""")
def _(t):
    return clean.nonfinite_to_null(_marked(t))


@query("cln_null_profile", """
       SELECT 'index' AS "column", count(*) FILTER (WHERE index IS NULL) AS n_missing FROM {aod_cells}
       UNION ALL SELECT 'a', 0 FROM (SELECT 1)
       UNION ALL SELECT 'b', count(*) FILTER (WHERE index % 10 = 2 OR (index % 10 <> 3 AND Optical_Depth_047 IS NULL))
       FROM {aod_cells}""")
def _(t):
    return clean.null_profile(_marked(t))


@query("cln_sentinel_profile", """
       SELECT 'a' AS "column", count(*) FILTER (WHERE index % 10 = 1) AS n_sentinel FROM {aod_cells}
       UNION ALL SELECT 'b', 0""")
def _(t):
    return clean.sentinel_profile(_marked(t))


@query("cln_nonfinite_profile", """
       SELECT 'a' AS "column", count(*) FILTER (WHERE index % 10 = 1) AS n_nonfinite FROM {aod_cells}
       UNION ALL SELECT 'b', count(*) FILTER (WHERE index % 10 IN (2, 3)) FROM {aod_cells}""")
def _(t):
    return clean.nonfinite_profile(_marked(t))


@query("cln_assert_finite", "SELECT index, AOD_Uncertainty AS a FROM {aod_cells}")
def _(t):
    return clean.assert_finite(t.aod_cells.select("index", F.col("AOD_Uncertainty").alias("a")))


@query("cln_strip_aggregate_names", """
       SELECT grid_id, max(t_surface00) AS t_surface00, max(u_pbl06) AS u_pbl06 FROM {gfs} GROUP BY grid_id""")
def _(t):
    return clean.strip_aggregate_names(t.gfs.groupBy("grid_id").agg(F.max("t_surface00"), F.max("u_pbl06")))


@query("cln_rename_slot", f"""
       SELECT grid_id, {d_text('date')} AS date, latitude, t_surface12 AS t_surface, v_pbl12 AS v_pbl FROM {{gfs}}""")
def _(t):
    named = clean.rename_slot(t.gfs, ["t_surfaceXX", "v_pblXX"], "12")
    return named.select("grid_id", "date", "latitude", "t_surface", "v_pbl")


@query("cln_drop_slots", f"""
       SELECT grid_id, {d_text('date')} AS date, latitude, t_surface00 FROM {{gfs}}""")
def _(t):
    dropped = clean.drop_slots(t.gfs.select("grid_id", "date", "latitude", "t_surface00", "u_pbl00", "u_pbl18"), ["u_pblXX"])
    return dropped


@query("cln_slot_columns", """
       SELECT grid_id, max(t_surface06) AS t_surface06, max(pbl_surface06) AS pbl_surface06, max(hindex_surface06) AS hindex_surface06,
              max(gust_surface06) AS gust_surface06, max(r_atmosphere06) AS r_atmosphere06, max(pwat_atmosphere06) AS pwat_atmosphere06,
              max(u_pbl06) AS u_pbl06, max(v_pbl06) AS v_pbl06, max(vrate_pbl06) AS vrate_pbl06 FROM {gfs} GROUP BY grid_id""")
def _(t):
    return max_by_key(t.gfs, ["grid_id"], clean.slot_columns(t.gfs, "06"))


@query("cln_feature_columns", """
       SELECT grid_id, AOD_QA, Column_WV, label_id FROM {label_cells}""")
def _(t):
    nested = t.label_cells.select("grid_id", "datetime", "label_id", "Column_WV", "AOD_QA", "lon",
                                  F.array("lon").alias("lons"))
    names, _, _ = clean.feature_columns(nested, ["datetime"], "lon")
    return nested.select(names)


@query("cln_distinct_rows", """
       SELECT DISTINCT grid_id, AOD_Uncertainty, Column_WV FROM {aod_cells}""")
def _(t):
    return t.aod_cells.select("index", "grid_id", "AOD_Uncertainty", "Column_WV").drop("index").distinct()


@query("cln_distinct_keys", "SELECT DISTINCT latitude, longitude FROM {labels_station}")
def _(t):
    return t.labels_station.dropDuplicates(["latitude", "longitude"]).select("latitude", "longitude")


@query("cln_drop_any_null", """
       SELECT index, Optical_Depth_047 FROM {aod_cells} WHERE Optical_Depth_047 IS NOT NULL""")
def _(t):
    return t.aod_cells.select("index", "Optical_Depth_047").na.drop("any")


@query("cln_feature_projection", """
       SELECT """ + ", ".join(f"AOD_Uncertainty AS {c}" if c != "pm25_date_d" else d_text("utc_date") + f" AS {c}"
                              for c in DEPLOYED_FEATURES) + " FROM {aod_cells}")
def _(t):
    from airgrid.plans.station_jobs import deployed_projection

    wide = t.aod_cells.select("*", *[
        F.col("utc_date").alias(c) if c == "pm25_date_d" else F.col("AOD_Uncertainty").alias(c) for c in DEPLOYED_FEATURES])
    return deployed_projection(wide)


@query("cln_column_pruning", f"SELECT label_id, {ts_text('datetime')} AS datetime FROM {{labels_grid}}")
def _(t):
    return t.labels_grid.drop("grid_id", "date", "value", "location")


@query("cln_mismatches", """
       SELECT count(*) FILTER (WHERE v <> m) AS n_mismatch FROM (
         SELECT value AS v, max(value) OVER (PARTITION BY grid_id, date) AS m FROM {labels_grid})""")
def _(t):
    top = max_by_key(t.labels_grid, ["grid_id", "date"], ["value"]).withColumnRenamed("value", "highest")
    return clean.mismatches(t.labels_grid.join(top, ["grid_id", "date"]), "value", "highest")


@query("cln_fill_constant", "SELECT index, coalesce(Optical_Depth_047, 0) AS depth FROM {aod_cells}")
def _(t):
    return t.aod_cells.select("index", F.col("Optical_Depth_047").alias("depth")).fillna(0.0)


@query("cln_fill_mean", """
       SELECT index, coalesce(Optical_Depth_047, (SELECT avg(Optical_Depth_047) FROM {aod_cells})) AS depth FROM {aod_cells}""")
def _(t):
    return clean.fill_with_mean(t.aod_cells.select("index", F.col("Optical_Depth_047").alias("depth")), ["depth"])
