"""Reading, flattening and cataloguing."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid.functions.features import epoch_ms
from airgrid.operators.clean import casts
from airgrid.sources.readers import directory_files, directory_table, flatten_labels, granule_catalog, parquet
from airgrid.session import shared_folder
from airgrid.schemas import AOD_BY_DATE, AOD_BY_LABEL, AOD_BY_LOCATION
from airgrid.sources.readers import csv, labels_csv, versioned_table
from airgrid.sources.writers import as_view, write_csv, write_parquet
from bindings.registry import query, ts_text

_ORDERS = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampNTZType()), T.StructField("o_orderpriority", T.StringType()),
])


@query("src_directory_table",
       "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
       + ts_text("o_orderdate") + " AS o_orderdate FROM {orders}")
def _(t):
    table, _ = directory_table(t.spark, t.folder, _ORDERS, drop=("o_orderpriority",))
    return table


@query("src_quarantined_files")
def _(t):
    _, left_out = directory_table(t.spark, t.folder, _ORDERS)
    return left_out.select(F.element_at(F.split("path", "/"), -1).alias("file"), "columns")


@query("src_file_inventory")
def _(t):
    return directory_files(t.spark, t.folder, _ORDERS).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "length", "readable", "fits")


@query("src_parquet_scan", """
       SELECT l_suppkey, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS partkeys FROM {lineitem}
       WHERE l_quantity > 25 GROUP BY l_suppkey""")
def _(t):
    return parquet(t.spark, f"{t.folder}/lineitem.parquet").where("l_quantity > 25").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("partkeys"))


@query("src_explicit_schema", """
       SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderstatus = 'F'""")
def _(t):
    wanted = T.StructType([f for f in _ORDERS.fields if f.name in ("o_orderkey", "o_orderstatus")])
    return parquet(t.spark, f"{t.folder}/orders.parquet", wanted).where("o_orderstatus = 'F'")


@query("src_flatten_labels", f"""
       SELECT location, value, latitude, longitude, {ts_text('datetime_utc')} AS datetime_utc,
              {ts_text("datetime_utc + INTERVAL '5' HOUR")} AS datetime_local FROM {{labels_station}}""")
def _(t):
    nested = t.labels_station.select(
        "location", "value", F.lit("µg/m³").alias("unit"), F.struct("latitude", "longitude").alias("coordinates"),
        F.struct(F.col("datetime_utc").alias("utc"),
                 (F.col("datetime_utc") + F.expr("INTERVAL 5 HOUR")).alias("local")).alias("date"))
    return flatten_labels(nested)


@query("src_json_props", """
       SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM {events}""")
def _(t):
    parsed = t.events.select("event_id", F.from_json("props", "k long").alias("p"))
    return parsed.select("event_id", "p.k")


@query("src_granule_catalog", """
       SELECT granule_id, us_url FROM {sat_metadata}
       WHERE product = 'misr' AND split = 'train' AND contains(us_url, '.hdf')""")
def _(t):
    return granule_catalog(t.sat_metadata, "misr", ".hdf", "train").select("granule_id", "us_url")


@query("src_epoch_millis", f"""
       SELECT event_id, {ts_text('epoch_ms(time)')} AS read_at FROM {{aod_ee}}""")
def _(t):
    return t.aod_ee.select("event_id", epoch_ms("time").alias("read_at"))


@query("src_casts", """
       SELECT p_partkey, TRY_CAST(split_part(p_brand, '#', 2) AS INT) AS brand, TRY_CAST(p_type AS DOUBLE) AS kind FROM {part}""")
def _(t):
    return casts(t.part.select("p_partkey", F.split("p_brand", "#")[1].alias("brand"), F.col("p_type").alias("kind")),
                 {"brand": "int", "kind": "double"})


@query("snk_temp_view", """
       SELECT grid_id, max(AOD_Uncertainty) AS high FROM {aod_cells} GROUP BY grid_id""")
def _(t):
    as_view(t.aod_cells, "aod")
    return t.spark.sql("SELECT grid_id, max(AOD_Uncertainty) AS high FROM aod GROUP BY grid_id")


def _fresh(t, name):
    return f"{shared_folder(t.spark)}/airgrid-{name}-{uuid.uuid4().hex}"


@query("src_labels_csv", f"""
       SELECT {ts_text('datetime')} AS datetime, grid_id, value FROM {{labels_grid}}""")
def _(t):
    path = _fresh(t, "labels")
    t.labels_grid.select(F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("datetime"), "grid_id", "value") \
        .write.option("sep", "|").option("header", True).csv(path)
    return labels_csv(t.spark, path, "datetime string, grid_id string, value double")


@query("snk_partitioned_parquet", """
       SELECT grid_id, location, strftime(datetime, '%Y-%m') AS month, value FROM {labels_grid}""")
def _(t):
    path = _fresh(t, "labels")
    months = t.labels_grid.select("grid_id", "location", F.date_format("datetime", "yyyy-MM").alias("month"), "value")
    write_parquet(months, path, partition_by=("location", "month"))
    return parquet(t.spark, path, months.schema).select(months.columns)


_VERSIONS = {"by_date": AOD_BY_DATE, "by_label": AOD_BY_LABEL, "by_location": AOD_BY_LOCATION}


def _cells_in_versions(t):
    """The aerosol cells written in three known schemas, a third each, beside a file of another schema."""
    path = _fresh(t, "versions")
    day, hour = F.col("utc_date").cast("string"), F.date_format("aod_reading_end", "yyyy-MM-dd HH:mm:ss")
    tails = {"by_date": {"utc_date": day}, "by_label": {"aod_reading_end": hour, "pm25_reading_date": day}, "by_location": {"aod_reading_end": hour, "location": F.lit("Delhi")}}
    for k, (name, tail) in enumerate(tails.items()):
        part = t.aod_cells.where(F.col("index") % 3 == k).withColumns(tail)
        kinds = {f.name: f.dataType for f in _VERSIONS[name].fields}
        part.select([F.col(c).cast(kinds[c]) for c in kinds]).write.parquet(f"{path}/{name}")
    t.aod_cells.select(F.col("index").cast("string"), "lon").write.parquet(f"{path}/other")
    return path


@query("src_schema_versions", """
       SELECT index, AOD_Uncertainty, AOD_QA, grid_id, CASE WHEN index % 3 = 0 THEN CAST(utc_date AS VARCHAR) END AS utc_date,
              CASE WHEN index % 3 > 0 THEN strftime(aod_reading_end, '%Y-%m-%d %H:%M:%S') END AS aod_reading_end,
              CASE WHEN index % 3 = 1 THEN CAST(utc_date AS VARCHAR) END AS pm25_reading_date, CASE WHEN index % 3 = 2 THEN 'Delhi' END AS location,
              CASE index % 3 WHEN 0 THEN 'by_date' WHEN 1 THEN 'by_label' ELSE 'by_location' END AS version FROM {aod_cells}""")
def _(t):
    table, _ = versioned_table(t.spark, _cells_in_versions(t), _VERSIONS)
    return table.select("index", F.col("AOD_Uncertainty").cast("double").alias("AOD_Uncertainty"), "AOD_QA", "grid_id", "utc_date", "aod_reading_end",
                        "pm25_reading_date", "location", "version")


@query("snk_csv", "SELECT label_id, value FROM {labels_grid}")
def _(t):
    path = _fresh(t, "export")
    write_csv(t.labels_grid.select("label_id", "value"), path)
    return csv(t.spark, path, "label_id long, value double")
