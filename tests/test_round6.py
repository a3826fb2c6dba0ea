"""Lists, deployed features and rank correlations with fewer and narrower shuffles."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from airgrid.operators import aggregates as A
from airgrid.operators import windows as V
from airgrid.plans import station_jobs as J
from airgrid.constants import DEPTH_BANDS, GFS_VARIABLES, SLOTS


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line for line in plan.split("\n"))


def test_short_lists_are_shuffled_once(spark):
    rows = [("a", 1, 1), ("a", 1, 1), ("a", None, 2), ("b", 3, 3), (None, 4, 4)]
    df = spark.createDataFrame(rows, "k string, lon int, lat int")
    out = A.coordinate_lists(df, ["k"])
    assert exchanges(out) == 1
    got = {r["k"]: (r["part"], len(r["lon_lat_list"])) for r in out.collect()}
    assert got == {"a": (0, 3), "b": (0, 1), None: (0, 1)}
    # a key above the chunk beside short ones
    mixed = sorted((str(r["k"]), r["part"], len(r["lon_lat_list"])) for r in A.coordinate_lists(df, ["k"], chunk=2).collect())
    assert mixed == [("None", 0, 1), ("a", 0, 2), ("a", 1, 1), ("b", 0, 1)]


@pytest.mark.parametrize("own", [(), ("v",)])
def test_short_trailing_means_of_dates(spark, own):
    rng = random.Random(3)
    start = datetime.date(1969, 11, 1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *[start + datetime.timedelta(d) for d in range(150)]]) if i % 20 == 0 else start + datetime.timedelta(rng.randrange(150)),
             rng.choice([None, 1.0, 2.0, 8.0])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, d date, v double").repartition(3)
    out = V.trailing_means(df, ["k"], "d", ["v"], [1, 3], label_columns=own)
    assert exchanges(out) == 1
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        for days in (1, 3):
            near = [] if r["d"] is None else [v for k, d, v in rows if k == r["k"] and d is not None and v is not None
                                              and 0 <= (r["d"] - d).days <= days and not (own and d == r["d"])]
            want = sum(near) / len(near) if near else None
            assert r[f"trailing{days}d_v"] == (pytest.approx(want) if near else None)


def test_deployed_table_aggregates_asked_days_alone(spark):
    day = datetime.date(2020, 1, 1)
    labels = spark.createDataFrame([("a", day, 1.0), (None, day, 2.0)], "grid_id string, date date, value double")
    raw = spark.createDataFrame([("a", day, 3.0), ("a", day, 5.0), ("b", day, 9.0)], "grid_id string, date date, v double")
    slots = [v + s for s in SLOTS for v in GFS_VARIABLES]
    gfs = raw.groupBy("grid_id", "date", "v").agg(*[F.max("v").alias(c) for c in slots])
    cells = raw.select("grid_id", "date", *[F.col("v").alias(b) for b in DEPTH_BANDS])
    angles = raw.select("grid_id", "date", F.col("v").alias("Aerosol_Optical_Depth"), F.col("v").alias("Angstrom_Exponent_550_860nm"))
    elevation = spark.createDataFrame([("a", 1.0, 2.0, 3.0)], "grid_id string, min_elevation double, max_elevation double, avg_elevation double")
    out = J.deployed_table(labels, cells, angles, gfs, elevation)
    # labels go below the aggregation that makes the forecasts
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("LeftSemi") == 3
    widest = [line for line in text.split("\n") if "Aggregate" in line and "t_surface00" in line][-1]
    assert text.index(widest) < text.rindex("LeftSemi")
    got = sorted(((r["value"], r["t_surface"] if "t_surface" in out.columns else None) for r in out.collect()))
    assert [v for v, _ in got] == [1.0, 2.0]
    assert "t_surface" not in out.columns or got == [(1.0, 4.0), (2.0, 0.0)]


def test_rank_correlations_with_gaps(spark):
    rng = random.Random(4)
    rows = [tuple(rng.choice([None, float("nan"), 1.0, 2.0, 5.0, -3.0, rng.uniform(-9, 9)]) for _ in range(3)) for _ in range(300)]

    def ranks(values):
        return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]

    out = A.correlations(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"], "spearman")
    # each column is placed once
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window ") <= 6
    got = {(r["var1"], r["var2"]): r["r"] for r in out.collect()}
    for i, j in ((0, 1), (0, 2), (1, 2)):
        pair = [(r[i], r[j]) for r in rows if None not in (r[i], r[j]) and r[i] == r[i] and r[j] == r[j]]
        x, y = ranks([p[0] for p in pair]), ranks([p[1] for p in pair])
        mx, my = sum(x) / len(x), sum(y) / len(y)
        want = sum((p - mx) * (q - my) for p, q in zip(x, y)) / (sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y)) ** 0.5
        assert got["abc"[i], "abc"[j]] == pytest.approx(want)
