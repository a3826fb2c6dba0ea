"""Forecasts and readings are shuffled as narrow rows, once before they meet the labels' days and once behind."""

import math
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from airgrid.constants import GFS_VARIABLES, SLOTS
from airgrid.plans import grid_jobs as G
from bindings.registry import Tables

BANDS = G.SUMMARY_BANDS
CLEAR, CLOUD = 0b0010000000000000, 0
RING = "POLYGON (({0} 0, {0} 2, {1} 2, {1} 0, {0} 0))"
#: Centres at (1, 1) and (3, 1), twice; one grid without a shape. Grid D has no shape at all, E no forecast.
GRIDS = [("A", RING.format(0, 2)), ("B", RING.format(2, 4)), ("B", RING.format(2, 4)), ("C", None), ("E", RING.format(0, 2))]
DAYS = [date(2020, 1, d) for d in (1, 2, 3)]
#: grid, day, latitude, longitude: nearest on one day only, mirrored points, points twice, without a full place, without a grid or a day
POINTS = [("A", 0, 1.0, 1.5), ("A", 0, 1.0, 1.25), ("A", 1, 1.0, 1.5), ("A", 1, 1.0, 0.5), ("A", 2, 1.0, 1.0), ("A", 2, 1.0, 1.0),
          ("B", 0, 1.0, 3.5), ("B", 0, 1.0, 2.5), ("B", 1, None, 3.0), ("B", 1, 1.0, 3.0), ("B", 2, 1.5, -0.0), ("B", 2, 1.5, 0.0),
          ("C", 0, 1.0, 1.0), ("C", 1, 2.0, 2.0), ("D", 1, 1.0, 1.0), ("D", 2, None, None), (None, 0, 1.0, 1.0), ("A", None, 1.0, 1.0)]
TIMES = [datetime(2020, 1, d, h, 30 * (h % 2)) for d in (1, 2, 3, 4) for h in (0, 5, 6, 17, 23)] + [datetime(2019, 12, 31, 13)]


@pytest.fixture(scope="module")
def forecasts(spark):
    rows = [(g, None if d is None else DAYS[d], y, x, *[None if (i + j) % 5 == 0 else float((i * 7 + j * 3) % 41) for j in range(len(G.SLOT_COLUMNS))])
            for i, (g, d, y, x) in enumerate(POINTS)]
    return spark.createDataFrame(rows, "grid_id string, date date, latitude double, longitude double, " + ", ".join(f"{c} double" for c in G.SLOT_COLUMNS))


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, g, t) for i, (g, t) in enumerate((g, t) for g in "ABCDE" for t in TIMES)] + [(0, "A", TIMES[0]), (7, "A", TIMES[7]), (900, "A", TIMES[7]), (901, None, TIMES[0]), (902, "A", None)]
    return spark.createDataFrame(rows, "label_id int, grid_id string, datetime timestamp")


@pytest.fixture(scope="module")
def grids(spark):
    return spark.createDataFrame(GRIDS, "grid_id string, wkt string")


@pytest.fixture(scope="module")
def elevation(spark):
    return spark.createDataFrame([("A", 1.0), ("B", 2.0)], "grid_id string, min_elevation double")


def slots_of(grid, time, forecasts):
    """Slots at each nearest point, by hand."""
    centre = {"A": (1.0, 1.0), "B": (3.0, 1.0), "E": (1.0, 1.0)}.get(grid)
    rows = [] if time is None else [r for r in forecasts if r.grid_id is not None and r.grid_id == grid and r.date in (time.date(), time.date() + timedelta(1))]

    def distance(y, x):
        return -1.0 if None in (y, x, centre) else round(math.hypot(centre[0] - x, centre[1] - y), 9)

    points = {(r.latitude, r.longitude) for r in rows}
    near = min((distance(*p) for p in points), default=None)
    out = []
    for p in [p for p in points if distance(*p) == near] or [(None, None)]:
        at = [r for r in rows if None not in p and (r.latitude, r.longitude) == p]
        out.append(tuple(max((r[v + s] for r in at if r[v + s] is not None and (r.date == time.date() and time.hour < int(s) or r.date > time.date() and time.hour >= int(s))), default=None)
                         for s in SLOTS for v in GFS_VARIABLES))
    return out


def by_hand(rows, forecasts):
    return Counter((*r, *s) for r in rows for s in slots_of(r[-2], r[-1], forecasts))


def test_nearest_forecasts_are_those_by_hand(labels, forecasts, grids):
    found = G.nearest_forecasts(labels, forecasts, grids)
    assert found.columns == [*labels.columns, *G.SLOT_COLUMNS]
    want = by_hand({tuple(r) for r in labels.collect()}, forecasts.collect())
    assert Counter(map(tuple, found.collect())) == want and len(want) > 100


def cells_of(spark, extra):
    """Cells of three places: repeated, cloudy, without a grid or a time; `extra` gives a time's column and its values."""
    rows = [(i, g, x, 1.0, *[float((i * 3 + k) % 11) if (i + k) % 6 else None for k in range(len(BANDS))], CLEAR if i % 3 else CLOUD, t)
            for i, (g, x, t) in enumerate((g, x, t) for g in ("A", "B", "E", None) for x in (1.0, 1.5, 3.25) for t in extra)]
    rows += [(i + 5000, *r) for i, *r in rows[::4]] + [(i + 9000, g, x, y, *[1.0] * len(BANDS), CLEAR, t) for i, g, x, y, *_, t in rows[::5]]
    return spark.createDataFrame(rows, "index int, grid_id string, lon double, lat double, " + ", ".join(f"{b} double" for b in BANDS) + ", AOD_QA int, t timestamp")


def test_submission_rows_are_those_by_hand(spark, labels, forecasts, grids, elevation):
    times = [datetime(2019, 12, 30, 23, 59), *[datetime(2020, 1, d, h) for d in (1, 2, 3, 5) for h in (0, 7)], None]
    cells = cells_of(spark, times).withColumnRenamed("t", "aod_reading_end")
    found = G.submission_table(labels, forecasts, cells, elevation, grids)
    assert found.columns[:3] == ["grid_id", "datetime", f"min_{BANDS[0]}"] and found.columns[-1] == "min_elevation"
    asked = {(r.grid_id, r.datetime) for r in labels.collect()}
    forecast_rows = found.select("grid_id", "datetime", *G.SLOT_COLUMNS).collect()
    assert Counter(map(tuple, forecast_rows)) == by_hand(asked, forecasts.collect())
    once, want = {tuple(r)[1:] for r in cells.collect()}, {}
    for g, t in asked:
        if g is None or t is None:
            continue
        low, high = (datetime(t.year, t.month, t.day) + timedelta(k) for k in (-1, 1))
        places = {}
        for r in once:
            if r[0] == g and r[-1] is not None and low <= r[-1] <= high:
                places.setdefault(r[1:3], []).append(r)
        # the uncertainty is not masked by clouds
        column = 3 + BANDS.index("AOD_Uncertainty")
        means = [[r[column] for r in p if r[column] is not None] for p in places.values()]
        means = [sum(m) / len(m) for m in means if m]
        want[g, t] = (min(means), max(means)) if means else (None, None)
    for r in found.collect():
        got = r.min_AOD_Uncertainty, r.max_AOD_Uncertainty
        assert got == (pytest.approx(want[r.grid_id, r.datetime]) if (r.grid_id, r.datetime) in want and want[r.grid_id, r.datetime][0] is not None else (None, None))
    assert sum(v[0] is not None for v in want.values()) > 20


def test_label_rows_of_cells_keep_repeats(spark, labels, forecasts, grids, elevation):
    cells = cells_of(spark, TIMES[3:9]).withColumnRenamed("t", "datetime")
    out = G.cell_table(labels, forecasts, cells, elevation, grids.distinct(), nearest=1).select("label_id", "grid_id", "datetime", *G.SLOT_COLUMNS)
    # one cell (or none) a label, as one is nearest; a label that comes twice stays twice
    want = Counter((*r, *s) for r in map(tuple, labels.collect()) for s in slots_of(r[-2], r[-1], forecasts.collect()))
    assert Counter(map(tuple, out.collect())) == want and want[0, "A", TIMES[0], *slots_of("A", TIMES[0], forecasts.collect())[0]] == 2
    table = G.date_validated_table(labels, forecasts, cells, elevation, grids).select("label_id", "grid_id", "datetime", *G.SLOT_COLUMNS)
    # where labels were made distinct before, they still are
    assert Counter(map(tuple, table.collect())) == by_hand({tuple(r) for r in labels.collect()}, forecasts.collect())


def exchanges(df, column):
    """Exchanges that give rows with `column`."""
    found, todo = 0, [df._jdf.queryExecution().executedPlan().initialPlan()]
    while todo:
        node = todo.pop()
        names = {node.output().apply(i).name() for i in range(node.output().size())}
        found += node.nodeName() == "Exchange" and column in names
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.fixture
def wide(spark):
    """Tables of a size that Spark does not send to all tasks, beside small grids and elevations."""
    slots = ", ".join(f"double(id % 7) AS {c}" for c in G.SLOT_COLUMNS)
    bands = ", ".join(f"double(id % 5) AS {b}" for b in BANDS)
    key = "cast(id % 50 AS string) AS grid_id"
    tables = {
        "labels": f"SELECT id AS label_id, {key}, timestamp'2020-01-01 05:00:00' + (id % 90) * INTERVAL '1' DAY AS datetime FROM range(4000)",
        "forecasts": f"SELECT {key}, date_add(date'2020-01-01', int(id % 90)) AS date, double(id % 2) AS latitude, 1.0D AS longitude, {slots} FROM range(4000)",
        "readings": f"SELECT id AS index, {key}, double(id % 3) AS lon, 1.0D AS lat, {bands}, 8192 AS AOD_QA, timestamp'2020-01-01 09:00:00' + (id % 90) * INTERVAL '1' DAY AS t FROM range(4000)",
        "elevation": "SELECT * FROM VALUES ('1', 2.0D) AS t(grid_id, min_elevation)",
        "grids": "SELECT * FROM VALUES ('1', 'POLYGON ((0 0, 0 1, 1 1, 1 0, 0 0))') AS t(grid_id, wkt)"}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")
    yield {name: spark.sql(text) for name, text in tables.items()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_submission_shuffles_readings_twice_and_forecasts_once(spark, wide):
    spark.sparkContext.setJobGroup("round8", "built")
    try:
        out = G.submission_table(wide["labels"], wide["forecasts"], wide["readings"].withColumnRenamed("t", "aod_reading_end"), wide["elevation"], wide["grids"])
        # readings were counted to build the query
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("round8")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # before 3 times, without the counting, and 3 times; summaries once
    assert exchanges(out, "Column_WV") == 2
    assert exchanges(out, "t_surface00") == 1 and exchanges(out, "slots") == 1
    assert exchanges(out, f"max_{BANDS[0]}") == 0


def test_validated_shuffles_forecasts_once(wide):
    cells = wide["readings"].withColumnRenamed("t", "datetime")
    out = G.date_validated_table(wide["labels"], wide["forecasts"], cells, wide["elevation"], wide["grids"])
    # before 3 times, and the labels 6 times
    assert exchanges(out, "t_surface00") == 1 and exchanges(out, "slots") == 1 and exchanges(out, "Column_WV") == 1
    assert exchanges(out, "label_id") == 1


def test_cell_table_shuffles_forecasts_once(wide):
    cells = wide["readings"].withColumnRenamed("t", "datetime")
    out = G.cell_table(wide["labels"], wide["forecasts"], cells, wide["elevation"], wide["grids"])
    # before 3 times
    assert exchanges(out, "t_surface00") == 1 and exchanges(out, "slots") == 1 and exchanges(out, "Column_WV") == 1
    assert exchanges(out, "label_id") == 1 and exchanges(out, "distance") == 1


def test_dealt_forecasts_are_the_same_rows_and_sums_are_not_shuffled(spark, tmp_path):
    rows = spark.sql("""SELECT if(id % 19 = 0, NULL, id % 40) AS l_orderkey, if(id % 23 = 0, NULL, id % 31) AS l_partkey, if(id % 17 = 0, NULL, id % 5) AS l_suppkey,
                               if(id % 13 = 0, NULL, int(id % 4)) AS l_linenumber,
                               if(id % 29 = 0, NULL, timestamp_ntz'2020-01-01 00:00:00' + (id % 6) * INTERVAL '1' DAY) AS l_shipdate FROM range(600)""")
    rows.unionAll(rows.where("l_partkey = 3")).write.parquet(f"{tmp_path}/lineitem.parquet")
    t = Tables(spark, str(tmp_path))
    dealt = t.dealt("gfs")
    assert dealt.schema == t.gfs.schema and Counter(map(str, dealt.collect())) == Counter(map(str, t.gfs.collect())) and dealt.count() > 50
    assert exchanges(dealt, "l_linenumber") == 1
    # the sums are in place for whoever joins by grid and day
    days = spark.sql("SELECT concat('G', string(id % 5)) AS grid_id, date_add(date'2020-01-01', int(id % 6)) AS date FROM range(20)").distinct()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(dealt.join(days, ["grid_id", "date"]), "t_surface00") == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
