"""Cells of granules are placed once for all grids, and windows are made for pairs that met alone."""

import pytest
from pyspark.sql import functions as F

from airgrid.functions.geo import polygon_bounds
from airgrid.operators import granules as W
from airgrid.operators.raster import with_cell_coordinates
from airgrid.plans.grid_jobs import granule_cells

RING = "POLYGON (({0} {0}, {0} {1}, {1} {1}, {1} {0}, {0} {0}))"
#: Grids that lie on top of one another, one twice, one without a name, one aside, one that holds a single corner.
GRIDS = [("A", RING.format(-1, 2)), ("A", RING.format(-1, 2)), ("B", RING.format(0.1, 0.5)), ("B", RING.format(0.2, 0.4)), (None, RING.format(0.1, 0.5)), ("C", RING.format(5, 6)),
         ("D", RING.format(-0.05, 0.0)), ("E", None)]


@pytest.fixture(scope="module")
def cells(spark):
    """Two granules of 70 x 4 cells (three blocks of rows) in one place, with a row twice and others outside or without a place."""
    rows = spark.sql("SELECT id div 560 AS granule_id, id % 2 AS layer, cast(id div 2 % 70 AS int) AS row, cast(id div 140 % 4 AS int) AS col, 70 AS n_rows, 4 AS n_cols, "
                     "cast(id AS double) AS raw, 0 AS AOD_QA, -2000.0D AS x0, 68000.0D AS y0, 60000.0D AS x1, -2000.0D AS y1 FROM range(1120)")
    odd = rows.where("raw = 3").select("granule_id", "layer", F.explode(F.expr("array(-1, 70, NULL)")).alias("row"), *rows.columns[3:])
    return rows.unionByName(rows.where("raw = 8")).unionByName(odd)


@pytest.fixture(scope="module")
def grids(spark):
    return spark.createDataFrame(GRIDS, "grid_id string, wkt string")


def found(cells, grids, **more):
    return granule_cells(cells, grids, ["raw"], *[F.lit(x) for x in (-1.0, 0.0, 9999.0, 1.0, 0.0)], **more)


def key(row):
    return tuple(map(str, row))


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_cells_of_boxes_are_those_of_a_plain_test(spark, cells, grids, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        names = ["grid_id", "granule_id", "layer", "lon", "lat", "raw"]
        boxes = grids.select("grid_id", *polygon_bounds(F.col("wkt")))
        placed = with_cell_coordinates(cells.where("row between 0 and n_rows - 1"))
        want = sorted(map(key, placed.join(boxes, W.in_box()).select(names).collect()))
        assert sorted(map(key, found(cells, grids).select(names).collect())) == want and len(want) > 1500
        short = [F.round(c, 6) + F.lit(0.0) for c in ("lon", "lat")]
        want = sorted(map(key, placed.join(boxes, W.in_box()).select(*names[:3], *short, "raw").collect()))
        out = found(cells, grids, digits=6)
        assert out.columns == names and sorted(map(key, out.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rounded_places_of_averaged_cells(cells, grids):
    exact = found(cells, grids, average=True)
    want = exact.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("lon", "lat")})
    out = found(cells, grids, average=True, digits=6)
    assert out.columns == want.columns and sorted(map(key, out.collect())) == sorted(map(key, want.collect()))


def test_cells_are_placed_once_for_all_grids(cells, grids):
    """Trigonometry and rounding stand below the join with the boxes, above that with the ranges of a block."""
    plan = found(cells, grids, digits=6)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [i for i, x in enumerate(plan) if x.lstrip(" +-:").startswith("Join")]
    boxed = next(i for i in joins if "min_lon" in plan[i] and "max_lat" in plan[i])
    ranged = next(i for i in joins if "row_low" in plan[i])
    placed = [i for i, x in enumerate(plan) if "AS lon#" in x or "AS _lon#" in x]
    assert placed and boxed < min(x for x in placed if "COS(" in plan[x]) < ranged
    assert all("round(" not in x for x in plan[:boxed + 1])
    # no window is made in a test whether a granule and a box meet, and no cell is placed before it met a range
    assert all("COS(" not in plan[i] for i in joins)


def test_shuffled_cells_meet_both_joins_in_one_exchange(spark, cells, grids):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = found(cells, grids)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    boxed = next(i for i, x in enumerate(plan) if "SortMergeJoin" in x)
    ranged = next(i for i, x in enumerate(plan) if "SortMergeJoin" in x and "row_low" in x)
    assert boxed < ranged and all("Exchange" not in x for x in plan[boxed:ranged])
