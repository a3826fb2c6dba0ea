"""Readers and writers on real files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid import schemas
from airgrid.session import settle
from airgrid.sources import readers, writers

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def test_directory_keeps_fitting_files_and_lists_the_rest(spark, table, tmp_path):
    writers.write_parquet(table([(1, "x"), (2, "y")], "a long, b string"), f"{tmp_path}/one")
    writers.write_parquet(table([("z", 3)], "b string, a long"), f"{tmp_path}/turned")
    writers.write_parquet(table([(4, "w", 0)], "a long, b string, c int"), f"{tmp_path}/wider")
    writers.write_parquet(table([("5", "v")], "a string, b string"), f"{tmp_path}/other_type")
    (tmp_path / "broken.parquet").write_bytes(b"not a parquet file")
    got, left_out = readers.directory_table(spark, str(tmp_path), SCHEMA)
    assert {tuple(r) for r in got.collect()} == {(1, "x"), (2, "y"), (3, "z")}
    listed = {r["path"].split(str(tmp_path))[1].split("/")[1]: r["columns"] for r in left_out.where("length > 0").collect()}
    assert set(listed) >= {"wider", "other_type", "broken.parquet"}
    assert listed["broken.parquet"] is None
    assert listed["wider"] == "a bigint, b string, c int"


def test_directory_without_fitting_files(spark, tmp_path):
    (tmp_path / "broken.parquet").write_bytes(b"x")
    got, left_out = readers.directory_table(spark, str(tmp_path), SCHEMA, drop=("b",))
    assert got.columns == ["a"] and got.count() == 0 and left_out.count() == 1


def test_labels_csv(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("datetime|grid_id|value\n2020-01-01T00:00:00Z|G1|4.5\n")
    row = readers.labels_csv(spark, str(tmp_path), "datetime string, grid_id string, value double").first()
    assert tuple(row) == ("2020-01-01T00:00:00Z", "G1", 4.5)


def test_csv_round_trip_in_one_file(spark, table, tmp_path):
    df = spark.range(100).select(F.col("id"), (F.col("id") * 2).alias("twice")).repartition(4)
    writers.write_csv(df, f"{tmp_path}/out", single_file=True)
    assert len(list((tmp_path / "out").glob("part-*.csv"))) == 1
    assert readers.csv(spark, f"{tmp_path}/out", "id long, twice long").agg(F.sum("twice")).first()[0] == 9900


def test_parquet_modes_and_partitions(spark, table, tmp_path):
    df = table([("G1", "2020-01", 1.0), ("G2", "2020-02", 2.0)], "grid_id string, month string, v double")
    writers.write_parquet(df, f"{tmp_path}/p", partition_by=("grid_id", "month"))
    assert (tmp_path / "p" / "grid_id=G1" / "month=2020-01").is_dir()
    with pytest.raises(Exception):
        writers.write_parquet(df, f"{tmp_path}/p")
    writers.write_parquet(df.limit(1), f"{tmp_path}/p", overwrite=True)
    assert readers.parquet(spark, f"{tmp_path}/p").count() == 1


def test_nested_labels_become_flat(table):
    df = table([("x", "µg/m³", (1.0, 2.0), ("2020-01-01T00:00:00Z", "2020-01-01T05:30:00"), 9.0)],
               "location string, unit string, coordinates struct<latitude: double, longitude: double>, "
               "date struct<utc: string, local: string>, value double")
    flat = readers.flatten_labels(df)
    assert flat.columns == ["location", "value", "latitude", "longitude", "datetime_utc", "datetime_local"]


def test_catalog(table):
    df = table([("misr", "train", "a.nc"), ("misr", "test", "b.nc"), ("maiac", "train", "c.hdf"), ("maiac", "train", "d.tif")],
               "product string, split string, us_url string")
    assert [r.us_url for r in readers.granule_catalog(df, "maiac", ".hdf", "train").collect()] == ["c.hdf"]


def test_view(spark, table):
    writers.as_view(table([(1,)], "a int"), "seen")
    assert spark.sql("SELECT a FROM seen").first()[0] == 1


def test_settled_table_lies_in_the_shared_folder(spark, table):
    df = table([(1, dt.date(2020, 1, 1)), (2, dt.date(2020, 1, 2))], "a int, d date")
    kept = settle(df, ("a",))
    assert kept.columns == ["a", "d"] and kept.count() == 2
    assert kept.inputFiles()[0].split(":")[1].lstrip("/").startswith(spark.conf.get("spark.checkpoint.dir").lstrip("/"))


def test_schemas_name_the_tables():
    assert len(schemas.GFS) == 40 and len(schemas.MISR) == 21
    assert len(schemas.AOD_BY_DATE) == 12 and len(schemas.AOD_BY_LABEL) == len(schemas.AOD_BY_LOCATION) == 13


def test_versions_of_a_schema(spark, tmp_path):
    """Three versions, odd names, a misfit that clashes in a type, one that does not, and bytes that are no parquet."""
    from airgrid.sources.readers import one_layout, versioned_table

    folder = tmp_path / "a b{1}%20"
    versions = {"old": T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.FloatType())]),
                "new": T.StructType([T.StructField("v", T.DoubleType()), T.StructField("id", T.LongType()), T.StructField("note", T.StringType())]),
                "bare": T.StructType([T.StructField("id", T.LongType())])}
    layout = one_layout(versions)
    assert [(f.name, f.dataType.simpleString()) for f in layout.fields] == [("id", "bigint"), ("v", "double"), ("note", "string")]
    for k, (name, schema) in enumerate(versions.items()):
        rows = [(10 * k + i, 0.5, f"n{i}") for i in range(3)]
        spark.createDataFrame(rows, "id long, v double, note string").select([F.col(f.name).cast(f.dataType) for f in schema.fields]).write.parquet(str(folder / f"{name} x%=y"))
    spark.createDataFrame([("x", 1)], "id string, z int").write.parquet(str(folder / "clash"))
    spark.createDataFrame([(1, 1)], "id int, z int").write.parquet(str(folder / "misfit"))
    (folder / "broken.parquet").write_bytes(b"no parquet")
    table, left_out = versioned_table(spark, str(folder).replace("{", "\\{").replace("}", "\\}"), versions)
    want = [(10 * k + i, None if name == "bare" else 0.5, f"n{i}" if name == "new" else None, name) for k, name in enumerate(versions) for i in range(3)]
    assert sorted(map(tuple, table.select("id", "v", "note", "version").collect())) == want
    assert sorted((r.readable, r.columns) for r in left_out.where("length > 0").collect())[0] == (False, None)
    assert {r.columns for r in left_out.collect()} == {None, "id string, z int", "id int, z int"}
    with pytest.raises(ValueError, match="no type holds"):
        one_layout({"a": T.StructType([T.StructField("id", T.StringType())]), "b": T.StructType([T.StructField("id", T.LongType())])})
