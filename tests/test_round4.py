"""Faults that only larger tables show."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from airgrid.functions import geo
from airgrid.operators import ordering as O
from airgrid.operators import sketches as S
from airgrid.operators.joins import interval_means
from airgrid.plans.grid_jobs import granule_cells


@pytest.mark.parametrize("texts", [[], [None], ["a", "b"], [f"{i % 50}_{i % 7}" for i in range(350)], [f"t{i:05}" for i in range(3000)]])
def test_few_texts_of_many_rows_have_places(spark, texts):
    """The sample that cuts texts into bands is one of distinct texts; it used to be empty where many rows hold few."""
    rows = max(1, 30_000 // max(len(texts), 1))
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(rows))))
    found = {r.t: (r.n, r.rows_before, r.values_before, r.rows_total) for r in O.value_positions(df, [], "t").collect()}
    order = sorted(set(texts), key=lambda t: (t is not None, t))
    assert found == {t: (rows, i * rows, i, len(order) * rows) for i, t in enumerate(order)}
    bands = {r.t: r._band for r in O.with_band(df, "t").select("t", O._BAND).distinct().collect()}
    assert [bands[t] for t in order] == sorted(bands.values())
    if len(order) > 100:
        assert len(set(bands.values())) > 32


def test_windows_of_sketches_copy_an_asked_day_twice(spark):
    days = spark.sql("SELECT id % 3 AS k, date_add(date'2020-01-01', cast(id div 3 AS int)) AS day, cast(id AS double) AS x FROM range(600)")
    sketches = S.quantile_sketches(days, ["k", "day"], ["x"])
    found = S.window_quantiles(sketches, days.select("k", F.col("day").alias("asked")), ["k"], "day", "asked", ["x"], {"median": 0.5}, back=62, ahead=2)
    rows = {(r.k, r.asked): (r.min_x, r.max_x, r.n_x) for r in found.collect()}
    plain = [(i % 3, i // 3, float(i)) for i in range(600)]
    start = dt.date(2020, 1, 1)
    want = {(k, start + dt.timedelta(d)): (min(v), max(v), len(v)) for k, d, _ in plain for v in ([x for a, b, x in plain if a == k and d - 62 <= b <= d + 2],)}
    assert rows == want
    # no day of a window is made on its own, and nothing is sent to all tasks
    plan = found._jdf.queryExecution().toString()
    assert "sequence(_from" not in plan and "BroadcastHashJoin" not in plan


def test_a_ring_is_read_once(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 0 2, 2 2, 2 0, 0 0))",), ("POINT (3 4)",), ("POLYGON ((1 1, 2 2, 1 1))",), ("nothing",), (None,)], "wkt string")
    out = df.select(geo.polygon_centroid(F.col("wkt")).alias("c"))
    assert [r.c and tuple(r.c) for r in out.collect()] == [(1.0, 1.0), None, (1.5, 1.5), None, None]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_overpasses_merge_before_boxes(spark):
    """A cell that several boxes hold is averaged once; a grid of two boxes has it once."""
    cells = spark.sql("SELECT 1L AS granule_id, id % 2 AS layer, cast(id div 2 % 4 AS int) AS row, cast(id div 8 AS int) AS col, 4 AS n_rows, 4 AS n_cols, cast(id AS double) AS raw, "
                      "0 AS AOD_QA, 0.0D AS x0, 40000.0D AS y0, 40000.0D AS x1, 0.0D AS y1 FROM range(32)")
    ring = "POLYGON (({0} {0}, {0} {1}, {1} {1}, {1} {0}, {0} {0}))"
    grids = spark.createDataFrame([("A", ring.format(-1, 1)), ("B", ring.format(0, 0.2)), ("B", ring.format(0.1, 0.4)), ("C", ring.format(5, 6)), (None, ring.format(-1, 1))], "grid_id string, wkt string")
    args = [F.lit(-1.0), F.lit(0.0), F.lit(99.0), F.lit(1.0), F.lit(0.0)]
    out = granule_cells(cells, grids, ["raw"], *args, average=True)
    single = granule_cells(cells, grids, ["raw"], *args).groupBy("grid_id", "granule_id", "lon", "lat").agg(F.avg("raw").alias("raw"))
    names = ["grid_id", "granule_id", "lon", "lat", "raw"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, out.select(names).collect()), key=key) == sorted(map(tuple, single.select(names).collect()), key=key)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    averaged = next(i for i, x in enumerate(plan.split("\n")) if "avg(" in x and "Aggregate" in x)
    assert "row_low" in "".join(plan.split("\n")[:averaged])


def test_an_interval_reads_its_rows_three_times_at_most(spark):
    """Times, seconds and days are summed from the rows themselves, not each from the sums of the other."""
    left = spark.sql("SELECT id % 3 AS k, timestamp'2020-01-01 12:00:00' + make_interval(0, 0, 0, cast(id AS int)) AS t FROM range(30)")
    right = spark.sql("SELECT id % 3 AS k, timestamp'2020-01-01 00:00:00.5' + make_interval(0, 0, 0, 0, cast(id AS int)) AS at, cast(if(id % 7 = 0, NULL, id) AS double) AS v FROM range(900)")
    out = interval_means(left, right, ["k"], "t", "at", ["v"], back=6, ahead=1)
    given = right.collect()
    for r in out.collect():
        near = [g.v for g in given if g.k == r.k and g.v is not None and r.t - dt.timedelta(6) <= g["at"] <= r.t + dt.timedelta(1)]
        assert r.avg_v == (sum(near) / len(near) if near else None)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    rows = [x for x in plan.split("\n") if "Aggregate" in x and "sum(v" in x]
    assert len(rows) == 3 and not any("sum(_s_v" in x and "_second" in x.split("[")[1] for x in plan.split("\n") if "Aggregate [" in x)
