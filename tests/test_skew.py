"""Hot keys, days and tiles: joins equal a plain scan, and no bucket holds more than its bound."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from airgrid.operators import joins as J
from airgrid.operators.tiles import LEAF, adaptive_tiles

START = dt.datetime(2020, 3, 1)


def times(rng, n, hot):
    """(key, time, id): a third of the rows on one day of one key, NULL keys and times, repeated rows."""
    rows = []
    for i in range(n):
        if i % 3 == 0:
            key, at = hot, START + dt.timedelta(hours=rng.randint(0, 23))
        else:
            key, at = rng.choice(["a", "b", None, "c"]), START + dt.timedelta(hours=rng.randint(-80, 80))
        rows.append((key, None if rng.random() < 0.05 else at, i // 2))
    return rows


def plain(left, right, back, ahead, mode, how):
    out = []
    for k, t, i in left:
        found = False
        if k is not None and t is not None:
            if mode == "calendar":
                day = dt.datetime(t.year, t.month, t.day)
                low, high = (day - dt.timedelta(days=back) if back else t), (day + dt.timedelta(days=ahead) if ahead else t)
            else:
                low, high = t - dt.timedelta(days=back), t + dt.timedelta(days=ahead)
            for rk, rt, j in right:
                if rk == k and rt is not None and low <= rt <= high:
                    out.append((k, t, i, rt, j))
                    found = True
        if not found and how == "left":
            out.append((k, t, i, None, None))
    return Counter(out)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("mode, back, ahead", [("exact", 1, 0), ("calendar", 1, 0), ("calendar", 1, 1), ("exact", 0, 1), ("exact", 0, 0)])
@pytest.mark.parametrize("sizes", [(300, 40), (40, 300), (150, 150)])
def test_heavy_days(spark, sizes, mode, back, ahead, how):
    rng = random.Random(sum(sizes) + back)
    left, right = times(rng, sizes[0], "hot"), times(rng, sizes[1], "hot")
    a = spark.createDataFrame(left, "key string, t timestamp, i long").repartition(3)
    b = spark.createDataFrame(right, "key string, r timestamp, j long").repartition(3)
    got = J.interval_join(a, b, ["key"], "t", "r", back, ahead, mode, how, heavy=8)
    assert Counter(map(tuple, got.select("key", "t", "i", "r", "j").collect())) == plain(left, right, back, ahead, mode, how)
    assert got.columns == J.interval_join(a, b, ["key"], "t", "r", back, ahead, mode, how, heavy=None).columns


def test_blocks_of_a_hot_day_are_bounded(spark):
    rng = random.Random(1)
    left = spark.createDataFrame(times(rng, 3000, "hot"), "key string, t timestamp, i long").repartition(4)
    right = spark.createDataFrame(times(rng, 3000, "hot"), "key string, r timestamp, j long").repartition(4)
    other = J._hide(right, ["key"]).withColumn("_day", J._covering_days(F.col("r"), 1, 0))
    days = J._heavy_days(left, other, ["key"], "t", 100)
    assert days.where("key = 'hot'").count() >= 1
    a, b = J._dealt(left, other, ["key"], "t", days)
    for side, key in ((a, "key"), (b, "_r_key")):
        blocks = side.groupBy(key, "_day", "_i", "_j").count()
        assert blocks.agg(F.max("count")).first()[0] <= 200
        assert blocks.where(f"{key} = 'hot'").count() > 10


def cities(n, seed):
    """Points of three cities, a third of them at one place; some elsewhere, some without coordinates."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lat, lon = rng.choice([(28.6, 77.2), (34.05, -118.2), (25.03, 121.5)])
        if i % 3 == 0:
            lat, lon = 28.61, 77.21
        elif i % 50 == 1:
            lat, lon = rng.uniform(-90, 90), rng.uniform(-180, 180)
        elif i % 50 == 2:
            lat = None
        else:
            lat, lon = lat + rng.gauss(0, 0.2), lon + rng.gauss(0, 0.2)
        rows.append((i, lat, lon))
    return rows


@pytest.mark.parametrize("most", [None, 5, 60])
def test_cells_in_boxes_of_hot_tiles(spark, most):
    rng = random.Random(7)
    cells = cities(900, 2)
    boxes = []
    for k in range(40):
        _, lat, lon = cells[rng.choice([0, 4, 5, 7, 8, 10, 13])]
        boxes.append((f"b{k}", lon - rng.random(), lon + rng.random(), lat - rng.random(), lat + rng.random()))
    boxes += [("point", 77.21, 77.21, 28.61, 28.61), ("world", -180.0, 180.0, -90.0, 90.0), ("back", 1.0, 0.0, 0.0, 1.0), ("null", None, 1.0, 0.0, 1.0)]
    want = Counter((i, b) for i, y, x in cells if y is not None for b, w, e, s, n in boxes if w is not None and w <= x <= e and s <= y <= n)
    got = J.cells_in_boxes(spark.createDataFrame(cells, "i long, lat double, lon double").repartition(3),
                           spark.createDataFrame(boxes, "b string, min_lon double, max_lon double, min_lat double, max_lat double"), most=most)
    assert Counter((r.i, r.b) for r in got.collect()) == want
    assert got.columns == ["i", "lat", "lon", "b"]


@pytest.mark.parametrize("most", [None, 5, 60])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_box_join_of_hot_tiles(spark, how, most):
    left, right = cities(400, 3), cities(300, 4)
    rounded = [[(i, None if y is None else round(y, 2), round(x, 2)) for i, y, x in side] for side in (left, right)]
    want = Counter()
    for i, y, x in rounded[0]:
        hits = [j for j, v, u in rounded[1] if None not in (y, v) and v + 0.375 >= y and v - 0.375 <= y and u + 0.375 >= x and u - 0.375 <= x]
        want.update([(i, j) for j in hits] or ([(i, None)] if how == "left" else []))
    a = spark.createDataFrame(left, "i long, latitude double, longitude double")
    b = spark.createDataFrame(right, "j long, latitude double, longitude double")
    got = J.box_join(a, b, 0.375, how=how, most=most)
    assert Counter((r.i, r.j) for r in got.collect()) == want


def test_three_cities_spread_over_all_cores(spark):
    df = spark.createDataFrame(cities(6000, 5), "i long, lat double, lon double").where("lat between 20 and 40").repartition(4)
    tiles = adaptive_tiles(1.0, [(df, F.col("lat"), F.col("lon"))], 100)
    sizes = [r["count"] for r in tiles.of_points(df, F.col("lat"), F.col("lon")).groupBy(*LEAF).count().collect()]
    whole = df.groupBy(F.floor("lat"), F.floor("lon")).count().agg(F.max("count")).first()[0]
    assert whole > 2000 and max(sizes) <= 250 and sum(sizes) == df.count() and sum(s > 10 for s in sizes) >= spark.sparkContext.defaultParallelism
