"""Granule windows and the incremental sink: same rows as a plain scan, rerun without doubling."""

import math
import random

import pytest
from pyspark.sql import functions as F

from airgrid.operators import granules as W
from airgrid.operators.raster import with_cell_coordinates
from airgrid.plans.grid_jobs import granule_cells, granule_partitions, granule_readings
from airgrid.sources.writers import overwrite_partitions, write_changed_partitions, write_parquet

RADIUS = 6371007.181


def corners(lon, lat, size=40_000.0):
    x, y = math.radians(lon) * RADIUS * math.cos(math.radians(lat)), math.radians(lat) * RADIUS
    return x - size, y + size, x + size, y - size


PLACES = [(77.0, 28.0), (-118.2, 34.0), (121.5, 25.0), (0.0, 0.0), (10.0, -33.0), (179.0, 66.0), (-60.0, 0.1)]


@pytest.fixture(scope="module")
def scenes(spark):
    rng = random.Random(3)
    rows = []
    for g, (lon, lat) in enumerate(PLACES):
        x0, y0, x1, y1 = corners(lon, lat)
        for row in range(30):
            for col in range(40):
                rows.append((g, rng.randint(0, 2), row, col, 30, 40, float(rng.randint(0, 50)), float(rng.randint(0, 9)), rng.randint(0, 65535), x0, y0, x1, y1))
    schema = "granule_id long, layer int, row int, col int, n_rows int, n_cols int, raw double, raw_b double, AOD_QA int, x0 double, y0 double, x1 double, y1 double"
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="module")
def boxes(spark):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        lon, lat = PLACES[k % len(PLACES)]
        a, b = lon + rng.uniform(-0.6, 0.6), lat + rng.uniform(-0.6, 0.6)
        rows.append((f"G{k}", a, a + rng.choice([0.0, 0.05, 0.3, 2.0]), b, b + rng.choice([0.0, 0.05, 0.3, 2.0])))
    rows += [("world", -180.0, 180.0, -90.0, 90.0), ("none", 50.0, 51.0, 50.0, 51.0), ("null", None, None, None, None), ("back", 78.0, 76.0, 27.0, 29.0)]
    return spark.createDataFrame(rows, "grid_id string, min_lon double, max_lon double, min_lat double, max_lat double").cache()


def plain(scenes, boxes):
    placed = with_cell_coordinates(scenes)
    return placed.join(boxes, W.in_box()).select("grid_id", "granule_id", "layer", "row", "col").collect()


@pytest.mark.parametrize("tile", [0.25, 1.0, 7.0])
def test_windows_hold_every_cell_of_a_box(scenes, boxes, tile):
    windows = W.granule_windows(scenes, boxes, ["granule_id"], tile)
    assert windows.count() == windows.select("grid_id", "granule_id").distinct().count()
    found = with_cell_coordinates(W.cells_in_windows(scenes, windows, ["granule_id"])).where(W.in_box())
    assert sorted(map(tuple, found.select("grid_id", "granule_id", "layer", "row", "col").collect())) == sorted(map(tuple, plain(scenes, boxes)))


def test_windows_are_narrow(scenes, boxes):
    """A row wider than the latitudes of the box on either side; a column wider than its longitudes on any of these rows."""
    seen = 0
    for r in W.granule_windows(scenes, boxes, ["granule_id"]).collect():
        lats = [(r.y0 + k * (r.y1 - r.y0) / 30) / RADIUS for k in range(30)]
        rows = [k for k, x in enumerate(lats) if r.min_lat <= math.degrees(x) <= r.max_lat]
        if not rows:
            assert r.row_high - r.row_low <= 1
            continue
        assert min(rows) - r.row_low <= 1 and r.row_high - max(rows) <= 1
        places = [(math.radians(lon) * RADIUS * math.cos(lats[k]) - r.x0) / 2000 for k in range(r.row_low, r.row_high + 1) for lon in (r.min_lon, r.max_lon)]
        assert max(0, math.floor(min(places))) - r.col_low <= 1 and r.col_high - min(39, math.ceil(max(places))) <= 1
        seen += 1
    assert seen > 10


def test_arrays_give_the_cells_of_their_windows_alone(scenes, boxes):
    cells = scenes.where("layer >= 0").select("granule_id", *W.GEOMETRY, "row", "col", "raw", "raw_b")
    rows = cells.groupBy("granule_id", *W.GEOMETRY, "row").agg(F.array_sort(F.collect_list(F.struct("col", "raw", "raw_b"))).alias("c"))
    arrays = rows.groupBy("granule_id", *W.GEOMETRY).agg(F.array_sort(F.collect_list(F.struct("row", "c"))).alias("r")).select(
        "granule_id", *W.GEOMETRY, F.transform("r", lambda x: x["c"]["raw"]).alias("raw"), F.transform("r", lambda x: x["c"]["raw_b"]).alias("raw_b"))
    windows = W.granule_windows(scenes, boxes, ["granule_id"])
    flat = W.flatten_windows(arrays, windows, ["raw", "raw_b"], ["granule_id"])
    want = W.cells_in_windows(cells, windows, ["granule_id"])
    names = ["grid_id", "granule_id", "row", "col", "raw", "raw_b"]
    assert sorted(map(tuple, flat.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))


def test_cells_are_pruned_before_they_are_placed(scenes, spark):
    grids = spark.createDataFrame([("A", "POLYGON ((76.9 27.9, 76.9 28.0, 77.0 28.0, 77.0 27.9, 76.9 27.9))")], "grid_id string, wkt string")
    one = F.lit(1.0)
    out = granule_cells(scenes, grids, ["raw"], F.lit(13.0), F.lit(0.0), F.lit(99.0), one, F.lit(0.0))
    lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    # the plan prints from the result down: trigonometry of cells stands above the join by ranges of rows and columns
    placed = next(i for i, x in enumerate(lines) if "COS(" in x.upper() and "AS lon" in x)
    ranged = next(i for i, x in enumerate(lines) if x.lstrip(" +-:").startswith("Join") and "row_low" in x and "col_high" in x)
    assert placed < ranged
    assert 0 < out.count() < scenes.count() / 20


def test_a_granule_without_extent(spark, boxes):
    flat = spark.createDataFrame([(1, 0, 0, c, 1, 3, 0.0, 0.0, 0.0, 0.0) for c in range(3)], "granule_id long, layer int, row int, col int, n_rows int, n_cols int, "
                                 "x0 double, y0 double, x1 double, y1 double")
    box = spark.createDataFrame([("A", -1.0, 1.0, -1.0, 1.0)], boxes.schema)
    windows = W.granule_windows(flat, box, ["granule_id"])
    assert W.cells_in_windows(flat, windows, ["granule_id"]).count() == 3


def rows_of(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("g", "m", "k", "v").collect()), key=str)


def test_only_changed_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "out with space")
    made = []

    def rows(todo):
        made.append(sorted(map(tuple, todo.select("g", "m").distinct().collect()), key=str))
        return todo.where("k <> 99").selectExpr("g", "m", "k", "k * 10 as v", "explode(array(1, 2)) as copy")

    def run(work):
        before = len(made)
        change = write_changed_partitions(spark.createDataFrame(work, "g string, m string, k long"), rows, path, ("g", "m"))
        return {(r.g, r.m): r.change for r in change.collect()}, made[before:]

    def want(work):
        return sorted(((g, m, k, 10 * k) for g, m, k in set(work) if k != 99 for _ in range(2)), key=str)

    first = [("a b", "2020-01", 1), ("a b", "2020-01", 2), ("c%/=", "2020-02", 3), (None, "2020-01", 4), ("a b", "2020-01", 1)]
    assert run(first)[0] == {("a b", "2020-01"): "new", ("c%/=", "2020-02"): "new", (None, "2020-01"): "new"}
    assert rows_of(spark, path) == want(first)
    assert run(first) == ({}, [])
    more = first + [("a b", "2020-01", 7), ("d", "2020-03", 8)]
    change, todo = run(more)
    assert change == {("a b", "2020-01"): "written", ("d", "2020-03"): "new"} and todo == [[("a b", "2020-01"), ("d", "2020-03")]]
    assert rows_of(spark, path) == want(more)
    # work that is gone, and work that makes no row any more
    less = [w for w in more if w[0] != "c%/=" and w[1] != "2020-03"] + [("d", "2020-03", 99)]
    change, _ = run(less)
    assert change == {("c%/=", "2020-02"): "deleted", ("d", "2020-03"): "written"}
    assert rows_of(spark, path) == want(less)
    assert run(less) == ({}, [])


def test_a_run_that_failed_is_done_again(spark, tmp_path):
    path = str(tmp_path / "out")
    work = spark.createDataFrame([("a", "x1", 1), ("b", "x1", 2)], "g string, m string, k long")
    rows = lambda todo: todo.selectExpr("g", "m", "k", "k as v")
    write_changed_partitions(work, rows, path, ("g", "m"))
    more = work.union(spark.createDataFrame([("a", "x1", 3), ("c", "x1", 4)], work.schema))

    def fails(todo):
        # files of the new partition are there, then the run ends without a manifest
        overwrite_partitions(rows(todo), path, ("g", "m"))
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        write_changed_partitions(more, fails, path, ("g", "m"))
    write_changed_partitions(more, rows, path, ("g", "m"))
    assert rows_of(spark, path) == [("a", "x1", 1, 1), ("a", "x1", 3, 3), ("b", "x1", 2, 2), ("c", "x1", 4, 4)]


def test_partitions_are_few_files(spark, tmp_path):
    rows = spark.range(0, 3000, 1, 16).selectExpr("id % 3 as k", "id as v")
    write_parquet(rows, str(tmp_path / "p"), partition_by=("k",))
    assert all(len(list(d.glob("*.parquet"))) == 1 for d in (tmp_path / "p").glob("k=*"))


def test_the_whole_chain_twice(spark, scenes, tmp_path):
    grids = spark.createDataFrame([("A", "POLYGON ((76.9 27.9, 76.9 28.0, 77.0 28.0, 77.0 27.9, 76.9 27.9))"), ("B", "POLYGON ((121.4 24.9, 121.4 25.1, 121.6 25.1, 121.4 24.9))")],
                                  "grid_id string, wkt string")
    labels = spark.sql("SELECT * FROM VALUES (1L, 'A', 'dl', timestamp'2020-07-02 06:00:00'), (2L, 'A', 'dl', timestamp'2020-07-03 06:00:00'), "
                       "(3L, 'B', 'tpe', timestamp'2020-08-01 00:00:00') AS t(label_id, grid_id, loc, datetime)")
    catalog = spark.sql("SELECT * FROM VALUES (0L, 'maiac', 'dl', 'train', timestamp'2020-07-01 12:00:00', 'x.hdf'), (2L, 'maiac', 'tpe', 'train', timestamp'2020-07-31 01:00:00', 'y.hdf'), "
                        "(0L, 'maiac', 'dl', 'test', timestamp'2020-07-01 13:00:00', 'x.hdf'), (0L, 'misr', 'dl', 'train', timestamp'2020-07-01 13:00:00', 'x.nc'), "
                        "(0L, 'maiac', 'dl', 'train', timestamp'2020-07-02 06:00:01', 'z.hdf') AS t(granule_id, product, loc, split, time_end, us_url)")
    path = str(tmp_path / "cells")

    def run(known):
        readings = granule_readings(labels, known, ["loc"], "maiac", ".hdf")
        return granule_partitions(readings, scenes, grids, path, ["raw"], F.lit(13.0), F.lit(0.0), F.lit(99.0), F.lit(1.0), F.lit(0.0)).collect()

    assert sorted((r.grid_id, r.month, r.change) for r in run(catalog.where("time_end < '2020-07-02' or loc = 'tpe'"))) == [("A", "2020-07", "new"), ("B", "2020-08", "new")]
    once = spark.read.parquet(path).count()
    assert [(r.grid_id, r.month, r.change) for r in run(catalog)] == [("A", "2020-07", "written")]
    out = spark.read.parquet(path)
    inside = {r.label_id: r["count"] for r in out.groupBy("label_id").count().collect()}
    cells = with_cell_coordinates(scenes)
    of_a = cells.where("granule_id = 0 and lon between 76.9 and 77.0 and lat between 27.9 and 28.0").count()
    of_b = cells.where("granule_id = 2 and lon between 121.4 and 121.6 and lat between 24.9 and 25.1").count()
    assert inside == {1: of_a, 2: of_a, 3: of_b} and once == of_a + of_b
    assert run(catalog) == [] and spark.read.parquet(path).count() == 2 * of_a + of_b


def test_partitions_that_share_folders(spark, tmp_path):
    path, made = tmp_path / "out", []

    def rows(todo):
        made.append(sorted(map(tuple, todo.select("g", "m").distinct().collect()), key=str))
        return todo.where("k < 900").selectExpr("g", "m", "k", "k * 10 as v")

    def run(work, make=rows):
        df = spark.createDataFrame(work, "g string, m string, k long")
        return {(r.g, r.m): r.change for r in write_changed_partitions(df, make, str(path), ("g", "m"), shared=("g",)).collect()}

    def want(work):
        return sorted(((g, m, k, 10 * k) for g, m, k in work if k < 900), key=str)

    first = [(f"g{i}", f"x{m}", 10 * i + m) for i in range(60) for m in range(2)] + [(None, "x0", 700)]
    assert set(run(first).values()) == {"new"} and rows_of(spark, str(path)) == want(first)
    # far fewer folders than partitions
    assert len(list(path.glob("share=*/m=*"))) <= 32
    assert run(first) == {} and len(made) == 1
    untouched = {f: f.stat().st_mtime_ns for f in path.glob("share=*/m=x1/*.parquet")}
    # more work, work that is gone, and work that makes no row any more; other partitions of their folders are copied
    more = [w for w in first if w[:2] != ("g4", "x0")] + [("g3", "x0", 800), ("new", "x0", 801)]
    more = [(g, m, 900) if (g, m) == ("g5", "x0") else (g, m, k) for g, m, k in more]
    assert run(more) == {("g3", "x0"): "written", ("new", "x0"): "new", ("g4", "x0"): "deleted", ("g5", "x0"): "written"}
    assert made[-1] == [("g3", "x0"), ("g5", "x0"), ("new", "x0")] and rows_of(spark, str(path)) == want(more)
    assert {f: f.stat().st_mtime_ns for f in path.glob("share=*/m=x1/*.parquet")} == untouched

    def fails(todo):
        raise RuntimeError("lost")

    last = more + [("g3", "x0", 802)]
    with pytest.raises(RuntimeError, match="lost"):
        run(last, fails)
    # all partitions of the folder are made again
    assert ("g3", "x0") in run(last) and rows_of(spark, str(path)) == want(last)
    # hardly anything left but work without rows
    bare = [(g, m, 900) for g, m, _ in last[:40]] + [("left", "x0", 1)]
    run(bare)
    assert rows_of(spark, str(path)) == want(bare) and run(bare) == {}
