"""Files with odd names, gaps, empty input and unseen places."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid.learning import models as M
from airgrid.learning.prepare import feature_pipeline
from airgrid.operators.aggregates import band_min_max_median, correlations
from airgrid.operators.clean import slot_columns
from airgrid.operators.ordering import exact_percentiles, percent_rank
from airgrid.operators.raster import elevation_summary
from airgrid.operators.windows import nearest_rank
from airgrid.plans.grid_jobs import distinct_cells
from airgrid.plans.station_jobs import SERIES_KEYS, station_series
from airgrid.sources import readers as R

SCHEMA = T.StructType([T.StructField("a", T.LongType())])


@pytest.mark.parametrize("name", ["plain", "my dir", "a%20b", "x[1]", "é"])
def test_directories_with_odd_names(spark, tmp_path, name):
    spark.range(5).toDF("a").write.parquet(str(tmp_path / "made"))
    spark.range(3).toDF("other").write.parquet(str(tmp_path / "made2"))
    folder = tmp_path / name
    folder.mkdir()
    for i, source in enumerate(("made", "made2")):
        for j, file in enumerate(sorted((tmp_path / source).glob("*.parquet"))):
            (folder / f"{i} {j}.parquet").write_bytes(file.read_bytes())
    (folder / "broken.parquet").write_bytes(b"no parquet")
    pattern = str(folder).replace("[", "\\[").replace("]", "\\]")
    table, left_out = R.directory_table(spark, pattern, SCHEMA)
    assert table.count() == 5
    kinds = {(r.readable, r.columns) for r in left_out.collect()}
    assert (False, None) in kinds and (True, "other bigint") in kinds


def test_stores_that_only_spark_reaches(spark, tmp_path, monkeypatch):
    spark.range(5).toDF("a").write.parquet(str(tmp_path / "made"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(str(tmp_path / "made"))
    found = files.mapInPandas(R._footers_of_contents, "path string, length long, columns string").collect()
    assert {r.columns for r in found} == {"a bigint"}
    with pytest.raises((OSError, ValueError)):
        R._open_store("nosuchstore://host/x.parquet")


def test_files_without_parquet_are_told_from_files_that_do_not_fit(spark, tmp_path):
    (tmp_path / "x.parquet").write_bytes(b"no parquet")
    table, left_out = R.directory_table(spark, str(tmp_path), SCHEMA)
    assert table.count() == 0 and [(r.readable, r.columns) for r in left_out.collect()] == [(False, None)]


@pytest.mark.parametrize("rows", [[], [("k", None)], [("k", 3.0)], [("k", float("inf")), ("k", None)], [("k", 2.0), ("k", 2.0)]])
def test_exact_statistics_of_nothing_and_little(table, rows):
    df = table(rows, "k string, v double")
    values = sorted(v for _, v in rows if v is not None)
    found = exact_percentiles(df, ["k"], "v", {"p50": 0.5}).collect()
    assert [r.p50 for r in found] == ([values[len(values) // 2]] if values else [])
    medians = band_min_max_median(df, ["k"], ["v"], exact=True).collect()
    assert [r.median_v for r in medians] == ([values[0] if values else None] if rows else [])
    assert percent_rank(df, "v").count() == len(rows)
    assert nearest_rank(df.withColumn("t", F.lit(1)), ["k", "t"], "v").count() == len(rows)
    raster = df.withColumnRenamed("v", "elevation")
    assert elevation_summary(raster, ["k"], "elevation").count() == (1 if rows else 0)


def test_rank_correlation_uses_the_rows_of_its_pair(spark, table):
    rng = random.Random(1)
    rows = [(float(i + rng.randint(-9, 9)), float(i), float(i) if i < 5 else None) for i in range(60)]
    df = table(rows, "a double, b double, c double")
    alone = correlations(df, ["a", "b"], "spearman").first().r
    assert {(r.var1, r.var2): r.r for r in correlations(df, ["a", "b", "c"], "spearman").collect()}[("a", "b")] == pytest.approx(alone)
    import pandas as pd

    frame = pd.DataFrame(rows, columns=["a", "b", "c"]).rank()
    assert alone == pytest.approx(frame["a"].corr(frame["b"]))
    assert correlations(df.limit(0), ["a", "b"], "spearman").first().r is None


def test_unseen_locations_keep_their_rows(table):
    from bindings.learning import _one_feature

    train = table([(i, "x", float(i), 2.0 * i) for i in range(6)], "label_id int, location string, x1 double, value double")
    test = table([(10, "x", 4.0, 0.0), (11, "y", 4.0, 0.0), (12, None, 1.0, 0.0)], "label_id int, location string, x1 double, value double")
    found = {r.label_id: r.prediction for r in M.fit_per_location(train, test, _one_feature()).collect()}
    assert found == {10: pytest.approx(8.0), 11: None, 12: None}
    assert {r.prediction for r in M.fit_per_location(train.limit(0), test, _one_feature()).collect()} == {None}


@pytest.mark.parametrize("learner", ["linear", "gradient_boosted"])
def test_gaps_in_a_feature_do_not_hide_it(spark, table, learner):
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        x = rng.uniform(0, 10)
        rows.append((i, f"2020-{1 + i % 12:02d}-{1 + i % 28:02d}", None if i % 50 == 0 else x, None, float("nan") if i % 70 == 0 else x / 2, 10 * x if i % 4 else None, 10 * x))
    df = table(rows, "id int, d string, x double, empty double, y double, target double, truth double").withColumn("d", F.to_date("d"))
    found = M.impute_column(df.drop("truth"), "target", ["id"], "d", learner=learner)
    both = found.join(df, "id")
    assert both.count() == 300
    assert both.agg(F.corr("target_imputed", "truth")).first()[0] > 0.95


def test_the_filled_pipeline_has_no_missing_number(table):
    df = table([(1.0, None, "u"), (None, 2.0, None), (3.0, 5.0, "v")], "a double, b double, t string")
    from pyspark.ml.functions import vector_to_array

    model = feature_pipeline(["a", "b"], ["t"], impute=True).fit(df)
    values = model.transform(df).select(F.explode(vector_to_array("features"))).collect()
    assert all(v[0] == v[0] for v in values)


def test_slots_are_matched_at_the_end(table):
    assert slot_columns(table([(1, 2, 3)], "t00 int, x2000y int, u06 int"), "00") == ["t00"]


def test_cells_count_once_and_are_averaged(table):
    rows = [(1, "g", 0.0, 0.0, 1, 4.0, 6.0, 1.0, 1.0, 8), (2, "g", 0.0, 0.0, 1, 4.0, 6.0, 1.0, 1.0, 8), (3, "g", 0.0, 0.0, 1, 8.0, None, 1.0, 3.0, 11)]
    df = table(rows, "index int, grid_id string, lon double, lat double, t int, Optical_Depth_047 double, Optical_Depth_055 double, AOD_Uncertainty double, Column_WV double, AOD_QA int")
    (row,) = distinct_cells(df, ["t"]).collect()
    assert (row.Optical_Depth_047, row.Optical_Depth_055, row.Column_WV, row.AOD_QA) == (6.0, 6.0, 2.0, 9)


def test_stations_at_one_place_have_their_own_lags(spark, table):
    rows = [(f"s{k}", "pm25", "IN", "Delhi", 1.0, 2.0, d, 10.0 * k + d) for k in (1, 2) for d in range(1, 6)]
    df = table(rows, "location string, parameter string, country string, city string, latitude double, longitude double, day int, value double")
    df = df.withColumn("datetime_utc", F.make_timestamp(F.lit(2020), F.lit(1), F.col("day"), F.lit(0), F.lit(0), F.lit(0))).withColumn("unit", F.lit("x")).drop("day")
    found = station_series(df)
    lag = next(c for c in found.columns if "lag1" in c.lower())
    per_station = {(r.location, str(r.date_utc)): r[lag] for r in found.collect()}
    assert len(per_station) == 10 and SERIES_KEYS == ["city", "latitude", "longitude"]


def test_no_file_of_a_search_or_chain_stays(spark, tmp_path, table):
    from airgrid.learning import scores as S
    from airgrid.learning import validate as V
    from bindings.learning import _folded
    from bindings.registry import Tables

    folded = _folded(Tables(spark, "/root/testdata/sf0.001"))
    folder = spark.conf.get("spark.checkpoint.dir")
    import os

    before = set(os.listdir(folder))
    line = M.regressor("linear", "value")
    V.time_cross_validate(folded, line, V.grid({line.regParam: [0.0]}), S.evaluator("value"))
    S.compare_models(folded, {"line": (line, V.grid({line.regParam: [0.0]}))}, "value")
    assert set(os.listdir(folder)) == before
    df = table([(i, float(i), None if i % 3 == 0 else 2.0 * i, None if i % 4 == 0 else 3.0 * i) for i in range(200)], "id int, a double, b double, c double")
    df = df.withColumn("d", F.date_add(F.lit("2020-01-01"), F.col("id")))
    out = M.impute_chain(df, ["b", "c"], ["id"], "d", learner="linear")
    assert out.where("b is null or c is null").count() == 0
    assert len(set(os.listdir(folder)) - before) <= 1 + 2 * 2  # the last round, and the ranks of each fold split
