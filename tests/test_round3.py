"""Sums instead of passes, lazy bands, blocked lags, merged sketches, a kept lookup table, halving."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from airgrid.learning import models as M
from airgrid.learning import normal as N
from airgrid.learning import validate as V
from airgrid.learning.scores import evaluator
from airgrid.operators import ordering as O
from airgrid.operators.lookup import LatestValues
from airgrid.operators.sketches import ERROR, merge_sketches, quantile, quantile_sketches, window_quantiles
from airgrid.operators.windows import autocorrelation
from airgrid.session import settle


def lines(n, seed=0, folds=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.gauss(100, 5), rng.gauss(0, 1)
        rows.append((i, i % folds, None if i % 11 == 0 else a, b, None if i % 7 == 0 else 3 * a - 2 * b + 50 + rng.gauss(0, 0.1), "p" + str(i % 5)))
    return rows


SCHEMA = "id long, fold int, a double, b double, y double, place string"


def test_sums_give_the_fit_of_a_library(spark):
    rows = [r for r in lines(500) if None not in r]
    df = spark.createDataFrame(rows, SCHEMA)
    m = N.square(np.array(N.moments(df, ["a", "b"], "y", shift={"a": 100.0}).first()[0]))
    fit = N.solve(m)
    x = np.array([[1.0, r[2] - 100.0, r[3]] for r in rows])
    want, *_ = np.linalg.lstsq(x, np.array([r[4] for r in rows]), rcond=None)
    assert np.allclose(fit, want, atol=1e-8)
    error = np.array([r[4] for r in rows]) - x @ want
    assert math.isclose(N.r2(m, fit), 1 - (error**2).sum() / ((np.array([r[4] for r in rows]) - np.mean([r[4] for r in rows])) ** 2).sum(), abs_tol=1e-9)


def test_dependent_and_constant_features_do_no_harm(spark):
    rows = [(i, i % 4, float(i), 2.0 * i, 5.0 * i + 1, "x") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("c", F.lit(7.0)).withColumn("empty", F.lit(None).cast("double")).withColumn("nan", F.lit(float("nan")))
    fit = N.fit_by_folds(df, ["a", "b", "c", "empty", "nan"], "y", "fold")
    assert fit.features == ["a", "b", "c"] and fit.penalty == 0.0
    got = df.select("y", fit.expression().alias("p")).collect()
    assert all(abs(r.y - r.p) < 1e-6 for r in got)


def test_folds_choose_the_penalty(spark):
    """Few noisy rows and many features: a penalty scores better, as training and scoring each fold says."""
    rng = np.random.default_rng(3)
    names = [f"x{i}" for i in range(12)]
    x = rng.normal(size=(120, 12))
    y = x[:, 0] + rng.normal(size=120) * 3
    rows = [(int(i // 15), *map(float, x[i]), float(y[i])) for i in range(120)]
    df = spark.createDataFrame(rows, "fold int, " + ", ".join(f"{n} double" for n in names) + ", y double")
    penalties = (0.0, 0.5, 3.0)
    fit = N.fit_by_folds(df, names, "y", "fold", penalties)
    for p in penalties:
        parts = []
        for f in range(0, 8, 2):
            a, b = slice(15 * f, 15 * f + 15), slice(15 * f + 15, 15 * f + 30)
            xa, ya = x[a] - x[a].mean(0), y[a] - y[a].mean()
            g = xa.T @ xa
            w = np.linalg.solve(g + p * np.diag(np.diag(g)), xa.T @ ya)
            e = y[b] - (y[a].mean() + (x[b] - x[a].mean(0)) @ w)
            parts.append(1 - (e**2).sum() / ((y[b] - y[b].mean()) ** 2).sum())
        assert math.isclose(fit.scores[p], float(np.mean(parts)), rel_tol=1e-6)
    assert fit.penalty == max(penalties, key=fit.scores.get) > 0


def test_a_search_reads_the_rows_twice(spark):
    df = spark.createDataFrame(lines(200), SCHEMA).cache()
    df.count()
    tracker = spark.sparkContext.statusTracker()

    def jobs(run):
        spark.sparkContext.setJobGroup(f"g{random.random()}", "count")
        group = spark.sparkContext.getLocalProperty("spark.jobGroup.id")
        run()
        return len(tracker.getJobIdsForGroup(group))

    few = jobs(lambda: N.fit_by_folds(df, ["a", "b"], "y", "fold", (0.0,)))
    many = jobs(lambda: N.fit_by_folds(df, ["a", "b"], "y", "fold", tuple(i / 10 for i in range(40))))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert few == many


def test_ten_thousand_places_in_one_aggregation(spark):
    rows = spark.range(60_000).selectExpr("id", "concat('p', id % 10000) AS place", "cast(id div 10000 AS double) AS a")
    rows = rows.withColumn("y", F.col("a") * (F.col("id") % 10_000) + 1)
    spark.sparkContext.setJobGroup("places", "places")
    fits = N.fit_by_group(rows, ["a"], "y", ["place"])
    out = N.predict_by_group(rows, fits, ["a"], ["place"])
    wrong = out.where(F.abs(F.col("prediction") - F.col("y")) > 1e-6).count()
    started = len(spark.sparkContext.statusTracker().getJobIdsForGroup("places"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert wrong == 0 and started < 20
    assert fits.count() == 10_000


def test_places_without_a_fit(spark):
    train = spark.createDataFrame([(1, 0, 1.0, 0.0, 2.0, "one"), (2, 0, 1.0, 0.0, 4.0, None), (3, 0, 2.0, 0.0, 6.0, None), (4, 0, None, 0.0, 6.0, "gap")], SCHEMA)
    test = spark.createDataFrame([(1, 0, 9.0, 0.0, None, "one"), (2, 0, 3.0, 0.0, None, None), (3, 0, 3.0, 0.0, None, "gap"), (4, 0, None, 0.0, None, "one"), (5, 0, 1.0, 0.0, None, "new")], SCHEMA)
    out = N.predict_by_group(test, N.fit_by_group(train, ["a"], "y", ["place"]), ["a"], ["place"])
    got = {r.id: r.prediction for r in out.collect()}
    assert got[1] == pytest.approx(2.0) and got[2] == pytest.approx(8.0)
    assert got[3] is None and got[4] is None and got[5] is None and len(got) == 5


@pytest.mark.parametrize("learner, search", [("linear", {"penalties": (0.0, 0.1)}), ("decision_tree", {"choices": {"maxDepth": [2, 6]}}), ("decision_tree", {})])
def test_a_chain_fills_gaps_in_place(spark, learner, search):
    rows = [(i, f"2020-{1 + i // 28 % 12:02}-{1 + i % 28:02}", float(i % 13), None if i % 6 == 0 else 2.0 * (i % 13) + 1, None if i % 5 == 0 else 3.0 * (i % 13)) for i in range(336)]
    df = spark.createDataFrame(rows, "id long, d string, a double, min_Column_WV double, c double").withColumn("d", F.to_date("d"))
    out = M.impute_chain(df, ["min_Column_WV", "c"], ["id"], "d", learner=learner, **search)
    assert out.columns == df.columns
    got = {r.id: r for r in out.collect()}
    for i, _, a, b, c in rows:
        assert got[i].min_Column_WV == (b if b is not None else pytest.approx(2 * a + 1, abs=3.0 if learner != "linear" else 1.0))
        assert got[i].c == (c if c is not None else pytest.approx(3 * a, abs=4.0 if learner != "linear" else 1.0))


def test_no_value_at_all_is_said(spark):
    df = spark.createDataFrame(lines(20), SCHEMA).withColumn("y", F.lit(None).cast("double"))
    with pytest.raises(ValueError, match="no row has a value of y"):
        N.fit_by_folds(df, ["a"], "y", "fold")


NUMBERS = [0.0, -0.0, 1.5, 1.5, -3.0, 1e300, -1e300, 5e-324, float("inf"), float("-inf"), float("nan"), None, 0.1, 0.1000001] + [0.4 + i / 1e6 for i in range(400)] + [float(i) for i in range(-200, 200)]
TEXTS = [None, "", "h", "http://a", "https://www.example.org/"] + [f"https://www.example.org/{i:04}/é" for i in range(300)] + ["https://www.example.org/0007/é"] * 50


def in_order(values):
    return sorted(values, key=lambda x: (x is not None, isinstance(x, float) and math.isnan(x), 0 if x is None or isinstance(x, float) and math.isnan(x) else x)
                  if not isinstance(x, str) else (True, False, x.encode()))


@pytest.mark.parametrize("values, kind", [(NUMBERS, "double"), (TEXTS, "string"), ([3, 1, None, 2**60, 2**60 + 1, -(2**60)] * 3, "long")])
def test_bands_keep_the_order_and_spread(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(3)
    got = {repr(r.v): (r.rows_before, r.n) for r in O.value_positions(df, [], "v").collect()}
    order = in_order(values)
    same = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))
    for r in O.value_positions(df, [], "v").collect():
        first = next(i for i, x in enumerate(order) if same(x, r.v))
        assert (r.rows_before, r.n) == (first, sum(same(x, r.v) for x in order)), r
    assert got
    if kind != "long":
        sizes = [r["count"] for r in O.with_band(df, "v").groupBy(O._BAND).count().collect()]
        assert max(sizes) < len(values) / 4


def test_texts_behind_a_common_start_spread(spark):
    df = spark.range(5000).selectExpr("concat('https://www.example.org/stations/', lpad(id, 6, '0')) AS v")
    sizes = [r["count"] for r in O.with_band(df, "v").groupBy(O._BAND).count().collect()]
    assert len(sizes) > 20 and max(sizes) < 1000


def test_building_a_rank_starts_no_job(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "rand(1) AS v", "cast(id AS string) AS t")
    spark.sparkContext.setJobGroup("build", "build")
    O.value_positions(df, ["k"], "v")
    O.exact_percentiles(df, ["k"], "v", {"m": 0.5})
    O.dense_rank(df, ["k"], "t")
    started = spark.sparkContext.statusTracker().getJobIdsForGroup("build")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not list(started)


@pytest.mark.parametrize("lags, chunk", [(0, 7), (5, 7), (30, 7), (30, 64), (2500, 512)])
def test_lags_of_chunks(spark, lags, chunk):
    rng = random.Random(2)
    series = {"a": [rng.random() for _ in range(3000 if lags > 100 else 90)], "b": [rng.random() for _ in range(12)], None: [1.0, 2.0, 4.0], "flat": [3.0] * 9, "one": [1.0]}
    rows = [(k, i * 3, None if v is None else v) for k, x in series.items() for i, v in enumerate(x)] + [("a", -1, None)]
    df = spark.createDataFrame(rows, "k string, t long, v double").repartition(5)
    for one_per_day in (True, False):
        got = {(r.k, r.lag): r.acf for r in autocorrelation(df, ["k"], "t", "v", lags, one_per_day, chunk).collect()}
        want = {}
        for k, x in series.items():
            d = np.array(x) - np.mean(x)
            for lag in range(min(lags + 1, len(x))):
                want[k, lag] = float((d[lag:] * d[:len(d) - lag]).sum() / (d * d).sum()) if (d * d).sum() > 0 else None
        assert got.keys() == want.keys()
        assert all(got[k] is None if w is None else abs(got[k] - w) < 1e-9 for k, w in want.items())


def test_merged_sketches_keep_their_error(spark):
    """Skewed values and days of very different size; a window's sketch is merged from those of its days."""
    df = spark.range(200_000).selectExpr("id", "concat('g', id % 2) AS g", "date_add(date'2020-01-01', cast(pmod(hash(id), 7) * pmod(hash(id), 7) / 6 AS int)) AS d",
                                         "pow(rand(3), 6) * 1000 AS v", "cast(null AS double) AS w").cache()
    days = settle(quantile_sketches(df, ["g", "d"], ["v", "w"]))
    shares = {"low": 0.1, "median": 0.5, "high": 0.99}
    found = window_quantiles(days, days.select("g", F.col("d").alias("asked")), ["g"], "d", "asked", ["v", "w"], shares, back=3, ahead=1).collect()
    assert found
    rows = df.select("g", "d", "v").toPandas()
    import datetime as dt

    for r in found:
        inside = rows[(rows.g == r.g) & (rows.d >= r.asked - dt.timedelta(3)) & (rows.d <= r.asked + dt.timedelta(1))].v
        assert (r.n_v, r.min_v, r.max_v, r.n_w, r.median_w) == (len(inside), inside.min(), inside.max(), 0, None)
        for name, share in shares.items():
            assert abs((inside <= r[f"{name}_v"]).mean() - share) <= ERROR
    whole = merge_sketches(days, ["g"], ["v"]).select("g", quantile("v", 0.5).alias("m")).collect()
    assert all(abs((rows[rows.g == r.g].v <= r.m).mean() - 0.5) <= ERROR for r in whole)


def test_daily_updates_equal_a_rebuild(spark):
    rng = random.Random(6)
    rows = [(f"2020-01-{1 + i % 9:02}", 10 + rng.randint(0, 30) / 100 + rng.random() / 1000, -5 - rng.randint(0, 3) / 100, rng.randint(0, 99)) for i in range(900)]
    rows += [(None, 10.0, -5.0, 1), ("2020-01-05", None, -5.0, 1), ("2020-01-05", 10.0, -5.0, None)]
    df = spark.createDataFrame(rows, "date string, latitude double, longitude double, value long")
    daily, whole = (LatestValues(spark, n, buckets=4) for n in ("daily", "whole"))
    whole.advance(df, "date")
    daily.advance(df.where("date < '2020-01-08' or date is null"), "date")
    for day in ("2020-01-08", "2020-01-09"):
        daily.advance(df.where(F.col("date") == day), "date")
    daily.advance(df.where("date = '2020-01-02'"), "date")
    names = ["place_y", "place_x", "date", "value"]
    assert sorted(map(tuple, daily.kept().select(names).collect())) == sorted(map(tuple, whole.kept().select(names).collect()))
    asked = spark.createDataFrame([(10.0, -5.0), (10.004, -5.004), (99.0, 9.0), (None, 1.0)], "latitude double, longitude double")
    found = daily.answers(asked)
    got = [r.answer for r in found.collect()]
    assert len(got) == 4 and sum("no" in a.lower() or not a.isdigit() for a in got) == 2


def test_the_kept_table_is_not_shuffled(spark):
    df = spark.range(5000).selectExpr("date'2020-01-01' AS date", "id % 70 AS latitude", "id % 90 AS longitude", "id AS value")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = LatestValues(spark, "still", buckets=4)
        table.advance(df, "date")
        asked = table.answers(df.select("latitude", "longitude"))
        update = table.merged(df.withColumn("date", F.date_add("date", 1)), "date", "value")
        for out in (asked, update):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan
            scan = next(i for i, x in enumerate(plan.split("\n")) if "Bucketed: true" in x)
            above = plan.split("\n")[:scan]
            depth = len(plan.split("\n")[scan]) - len(plan.split("\n")[scan].lstrip(" :+-"))
            # the chain of operators from the scan up to the join holds no exchange
            for line in reversed(above):
                own = len(line) - len(line.lstrip(" :+-"))
                if own < depth:
                    depth = own
                    if "Join" in line:
                        break
                    assert "Exchange" not in line
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_halving_finds_the_setting(spark):
    rng = random.Random(1)
    rows = [(i, float(i % 64), float((i % 64) // 8) + rng.gauss(0, 0.05)) for i in range(3000)]
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame(rows, "id long, x double, y double"))
    train, valid = settle(df.where("id % 5 > 0")), settle(df.where("id % 5 = 0"))
    tree = M.regressor("decision_tree", "y", maxBins=128)
    maps = V.grid({tree.maxDepth: [1, 2, 3, 4, 5], tree.minInstancesPerNode: [1, 400]})
    found, seen = V.halving_search(train, valid, tree, maps, evaluator("y"), ["id"], factor=3, least=0.1)
    assert Counter(r for r, *_ in seen) == {0: 10, 1: 4, 2: 2} and [s for _, s, *_ in seen][-1] == 1.0
    assert found.params[tree.maxDepth] >= 3 and found.params[tree.minInstancesPerNode] == 1 and found.score > 0.98
    small, large = (df.where(V.hash_share(["id"], s)) for s in (0.1, 0.3))
    assert small.join(large, "id", "left_anti").count() == 0 and abs(small.count() / 3000 - 0.1) < 0.03
