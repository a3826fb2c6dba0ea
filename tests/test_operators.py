"""Operators against brute force, with one key holding a third of the rows and more."""

import datetime as dt
import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airgrid.constants import SLOTS
from airgrid.operators import aggregates as A
from airgrid.operators import clean as C
from airgrid.operators import joins as J
from airgrid.operators import ordering as O
from airgrid.operators import raster as R
from airgrid.operators import splits as S
from airgrid.operators import windows as W

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
START = dt.datetime(2020, 1, 1)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def hot(rng, n, keys=5):
    """Keys of n rows; the first key takes more than a third."""
    return ["hot" if rng.random() < 0.4 else f"k{rng.randrange(keys)}" for _ in range(n)]


def times(rng, n, days=6, step=600):
    return [START + dt.timedelta(seconds=rng.randrange(days * 86400 // step) * step) for _ in range(n)]


# --- ordering ---------------------------------------------------------------------------------


@FEW
@given(st.lists(st.integers(0, 400), min_size=1, max_size=120))
def test_percent_rank_equals_window(spark, days):
    rows = [(i, dt.date(2019, 1, 1) + dt.timedelta(days=d)) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "id int, date date")
    ours = dict(rows_of(O.percent_rank(df, "date").select("id", "rank")))
    theirs = dict(rows_of(df.select("id", F.percent_rank().over(Window.orderBy("date")))))
    assert ours == theirs


def test_percent_rank_worked_case(table):
    df = table([("a",), ("a",), ("b",), ("c",)], "d string")
    assert sorted(r[0] for r in rows_of(O.percent_rank(df, "d").select("rank"))) == [0, 0, 2 / 3, 1]


def test_ranks_with_nulls_and_hot_key(spark):
    rng = random.Random(1)
    rows = [(i, k, rng.choice([None, *range(30)])) for i, k in enumerate(hot(rng, 400))]
    df = spark.createDataFrame(rows, "id int, k string, v int")
    window = Window.partitionBy("k").orderBy("v")
    expected = dict((r[0], (r[1], r[2])) for r in rows_of(df.select("id", F.dense_rank().over(window), F.percent_rank().over(window))))
    ours = O.percent_rank(O.dense_rank(df, ["k"], "v", "dense"), "v", "share", ["k"])
    assert dict((r[0], (r[1], r[2])) for r in rows_of(ours.select("id", "dense", "share"))) == expected


def test_row_positions_by_bands(spark):
    rng = random.Random(2)
    keys = hot(rng, 500)
    rows = [(i, k, t) for i, (k, t) in enumerate(zip(keys, times(rng, 500, days=200)))]
    rows = list({(k, t): (i, k, t) for i, k, t in rows}.values())
    df = spark.createDataFrame(rows, "id int, k string, t timestamp")
    ours = dict(rows_of(O.row_positions(df, ["k"], "t").select("id", "position")))
    series = defaultdict(list)
    for i, k, t in sorted(rows, key=lambda r: r[2]):
        series[k].append(i)
    assert ours == {i: p for ids in series.values() for p, i in enumerate(ids)}


def test_exact_percentiles(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, *[x / 4 for x in range(40)]])) for k in hot(rng, 300)]
    df = spark.createDataFrame(rows, "k string, v double")
    ours = {r[0]: r[1:] for r in rows_of(O.exact_percentiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}))}
    theirs = {r[0]: tuple(r[1]) for r in rows_of(df.groupBy("k").agg(F.percentile("v", [0.25, 0.5, 0.9])))}
    assert ours.keys() == theirs.keys()
    for k in ours:
        assert ours[k] == pytest.approx(theirs[k])


# --- joins ------------------------------------------------------------------------------------


def two_series(spark, rng, n_left=40, n_right=120):
    left = [(i, k, t) for i, (k, t) in enumerate(zip(hot(rng, n_left, 3), times(rng, n_left)))]
    left.append((n_left, None, START))
    left.append((n_left + 1, "hot", None))
    right = [(1000 + i, k, t, float(rng.randrange(50))) for i, (k, t) in enumerate(zip(hot(rng, n_right, 3), times(rng, n_right)))]
    # edges of the windows of the first label
    _, k, t = left[0]
    day = dt.datetime(t.year, t.month, t.day)
    for j, edge in enumerate((t, t - dt.timedelta(days=1), day - dt.timedelta(days=1), day + dt.timedelta(days=1), t + dt.timedelta(days=1),
                              t - dt.timedelta(days=1, seconds=1), day - dt.timedelta(days=1, seconds=1))):
        right.append((2000 + j, k, edge, 1.0))
    return left, right


def bounds(t, back, ahead, mode):
    if mode == "exact":
        return t - dt.timedelta(days=back), t + dt.timedelta(days=ahead)
    day = dt.datetime(t.year, t.month, t.day)
    return (day - dt.timedelta(days=back) if back else t), (day + dt.timedelta(days=ahead) if ahead else t)


INTERVALS = [(1, 0, "calendar"), (1, 0, "exact"), (0, 1, "exact"), (1, 1, "calendar"), (3, 2, "exact")]


@pytest.mark.parametrize("back, ahead, mode", INTERVALS)
def test_interval_join_equals_nested_loop(spark, back, ahead, mode):
    left, right = two_series(spark, random.Random(back * 10 + ahead))
    expected = Counter()
    for i, k, t in left:
        found = []
        if t is not None:
            low, high = bounds(t, back, ahead, mode)
            found = [j for j, rk, rt, _ in right if rk == k and low <= rt <= high]
        expected.update([(i, j) for j in found] or [(i, None)])
    ours = J.interval_join(spark.createDataFrame(left, "i int, k string, t timestamp"),
                           spark.createDataFrame(right, "j int, k string, r timestamp, v double"), ["k"], "t", "r", back, ahead, mode)
    assert Counter(rows_of(ours.select("i", "j"))) == expected


@pytest.mark.parametrize("back, ahead, mode", INTERVALS)
def test_interval_means_equal_joined_means(spark, back, ahead, mode):
    left, right = two_series(spark, random.Random(50 + back * 10 + ahead))
    a = spark.createDataFrame(left, "i int, k string, t timestamp")
    b = spark.createDataFrame(right, "j int, k string, r timestamp, v double")
    means = dict(rows_of(J.interval_means(a, b, ["k"], "t", "r", ["v"], back, ahead, mode).select("i", "avg_v")))
    joined = J.interval_join(a, b, ["k"], "t", "r", back, ahead, mode).groupBy("i").agg(F.avg("v"))
    assert means == dict(rows_of(joined))


def test_interval_means_need_a_day(spark, table):
    df = table([("a", START, 1.0)], "k string, t timestamp, v double")
    with pytest.raises(ValueError):
        J.interval_means(df, df, ["k"], "t", "t", ["v"], 0, 0)


@pytest.mark.parametrize("how", ["left", "inner", "full"])
def test_day_pairs_equal_or_join(spark, how):
    rng = random.Random(4)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(12))
    left = spark.createDataFrame([(i, k, day()) for i, k in enumerate(hot(rng, 30, 3))], "i int, k string, d date")
    right = spark.createDataFrame([(j, k, day()) for j, k in enumerate(hot(rng, 30, 4))], "j int, k string, f date")
    other = right.withColumnRenamed("k", "k2")
    condition = (F.col("k") == F.col("k2")) & ((F.col("f") == F.col("d")) | (F.col("f") == F.date_add("d", 1)))
    expected = left.join(other, condition, how).select("i", F.coalesce("k", "k2"), "j", "f")
    ours = J.day_pair_join(left, right, ["k"], "d", "f", how).select("i", "k", "j", "f")
    assert Counter(rows_of(ours)) == Counter(rows_of(expected))


def test_forecasts_follow_the_label(spark, table):
    labels = table([(1, "g", dt.datetime(2020, 1, 1, 10)), (2, "g", dt.datetime(2020, 1, 5, 0)), (3, "h", START)], "id int, g string, t timestamp")
    columns = ", ".join(f"x{s} double" for s in SLOTS)
    forecasts = table([("g", dt.date(2020, 1, 1), 1.0, 2.0, 3.0, 4.0), ("g", dt.date(2020, 1, 2), 5.0, 6.0, 7.0, 8.0),
                       ("g", dt.date(2020, 1, 5), 9.0, 10.0, 11.0, 12.0)], f"g string, date date, {columns}")
    out = J.forecast_for_labels(labels, forecasts, ["g"], "t", "date", ["x"]).orderBy("id").select(*[f"x{s}" for s in SLOTS])
    assert rows_of(out) == [(5.0, 6.0, 3.0, 4.0), (None, 10.0, 11.0, 12.0), (None,) * 4]


@pytest.mark.parametrize("radius", [0.1, 0.5, 12.5])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_box_join_equals_nested_loop(spark, radius, how):
    rng = random.Random(int(radius * 10))
    spot = lambda: (round(rng.uniform(-3, 3), 3), round(rng.uniform(-3, 3), 1))
    left = [(i, *spot()) for i in range(40)] + [(40 + i, 1.25, -0.5) for i in range(20)] + [(99, None, 1.0)]
    right = [(j, *spot()) for j in range(60)]
    a, b = (spark.createDataFrame(r, f"{n} int, latitude double, longitude double") for r, n in ((left, "i"), (right, "j")))
    condition = " AND ".join(f"round({c}2, 2) + {radius} >= round({c}, 2) AND round({c}2, 2) - {radius} <= round({c}, 2)"
                             for c in ("latitude", "longitude"))
    expected = a.join(b.withColumnsRenamed({"latitude": "latitude2", "longitude": "longitude2"}), F.expr(condition), how)
    ours = J.box_join(a, b, radius, how=how)
    assert Counter(rows_of(ours.select("i", "j"))) == Counter(rows_of(expected.select("i", "j")))


def test_cells_in_boxes_include_ends(table):
    cells = table([(1, 0.0, 0.0), (2, 1.0, 1.0), (3, 1.5, 0.5), (4, 2.5, 2.5), (5, -0.1, 0.5)], "c int, lon double, lat double")
    boxes = table([("a", 0.0, 1.0, 0.0, 1.0), ("b", 1.0, 3.0, 0.5, 2.5)], "g string, min_lon double, max_lon double, min_lat double, max_lat double")
    assert set(rows_of(J.cells_in_boxes(cells, boxes).select("c", "g"))) == {(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "b")}


def test_lookup_answers(table):
    series = table([(28.61, 77.2, dt.date(2020, 1, 1), 5.0), (28.612, 77.2, dt.date(2020, 1, 3), 7.0), (28.61, 77.2, dt.date(2020, 1, 2), 6.0)],
                   "latitude double, longitude double, d date, value double")
    asked = table([(28.611, 77.199), (1.0, 1.0)], "latitude double, longitude double")
    found = dict((r[0], r[2]) for r in rows_of(J.latest_value_lookup(asked, series, "d")))
    assert found[28.611] == "7.0"
    assert "don't have data" in found[1.0]


def test_full_join_keeps_either_key(table):
    a, b = table([("x", 1)], "k string, a int"), table([("y", 2)], "k string, b int")
    assert set(rows_of(J.equi_join(a, b, ["k"], "full"))) == {("x", 1, None), ("y", None, 2)}


# --- windows ----------------------------------------------------------------------------------


def test_lags_of_short_series(table):
    df = table([("s", dt.date(2020, 1, d), v) for d, v in ((1, 5.0), (2, 8.0), (3, 6.0))], "k string, d date, value double")
    out = W.day_difference_lags(df, ["k"], "d").orderBy("d")
    assert rows_of(out.select("value_lag1day", "difflag", "difflag_lag1day")) == [(None, None, None), (5.0, -3.0, None), (8.0, 2.0, -3.0)]


@pytest.mark.parametrize("chunk", [5, 64])
def test_chunked_lags_equal_window(spark, chunk):
    rng = random.Random(chunk)
    rows = [(i, k, float(rng.randrange(100))) for i, k in enumerate(hot(rng, 300))]
    df = spark.createDataFrame(rows, "id int, k string, v double")
    lags = {f"l{n}": ("v", n) for n in (1, 5, 17)}
    window = Window.partitionBy("k").orderBy("id")
    expected = {r[0]: r[1:] for r in rows_of(df.select("id", *[F.lag(c, n).over(window) for c, n in lags.values()]))}
    ours = {r[0]: r[1:] for r in rows_of(W.lag_rows(df, ["k"], "id", lags, chunk=chunk).select("id", *lags))}
    assert ours == expected


def test_day_lag_differs_from_row_lag_when_a_day_is_missing(table):
    df = table([("s", dt.date(2020, 1, 1), 1.0), ("s", dt.date(2020, 1, 3), 3.0)], "k string, d date, v double")
    by_day = W.lag_days(df, ["k"], "d", "v", {"lag1": 1}).orderBy("d")
    by_row = W.lag_rows(df, ["k"], "d", {"lag1": ("v", 1)}, one_per_day=True).orderBy("d")
    assert [r[-1] for r in rows_of(by_day)] == [None, None]
    assert [r[-1] for r in rows_of(by_row)] == [None, 1.0]


@pytest.mark.parametrize("as_date", [True, False])
def test_trailing_means_equal_range_window(spark, as_date):
    rng = random.Random(7)
    n, days = 250, [1, 2, 7]
    when = [t.date() if as_date else t for t in times(rng, n, days=25, step=3600)]
    rows = [(i, k, t, rng.choice([None, *map(float, range(20))]), float(rng.randrange(9))) for i, (k, t) in enumerate(zip(hot(rng, n), when))]
    df = spark.createDataFrame(rows, f"id int, k string, t {'date' if as_date else 'timestamp'}, v double, value double")
    seconds = F.unix_seconds(F.col("t").cast("timestamp"))

    def over(d, end):
        return Window.partitionBy("k").orderBy(seconds).rangeBetween(-d * 86400, end)

    expected = {r[0]: r[1:] for r in rows_of(df.select(
        "id", *[F.avg(c).over(over(d, -1 if c == "value" else 0)) for d in days for c in ("v", "value")]))}
    ours = W.trailing_means(df, ["k"], "t", ["v", "value"], days, label_columns=("value",))
    got = {r[0]: r[1:] for r in rows_of(ours.select("id", *[f"trailing{d}d_{c}" for d in days for c in ("v", "value")]))}
    assert got.keys() == expected.keys()
    for i in got:
        assert got[i] == pytest.approx(expected[i])


def test_calendar_means_equal_windows(spark):
    rng = random.Random(8)
    rows = [(i, k, dt.date(2019, 1, 1) + dt.timedelta(days=rng.randrange(700)), rng.choice([None, 1.0, 2.0, 5.0])) for i, k in enumerate(hot(rng, 200))]
    df = spark.createDataFrame(rows, "id int, k string, d date, v double")
    expected = {r[0]: r[1:] for r in rows_of(df.select("id", *[
        F.avg("v").over(Window.partitionBy("k", part("d"))) for part in W.CALENDAR.values()]))}
    ours = W.calendar_means(df, "k", "d", ["v"]).select("id", *[f"avg_{n}_v" for n in W.CALENDAR])
    assert {r[0]: r[1:] for r in rows_of(ours)} == expected


def test_nearest_keeps_ties(table):
    df = table([("g", i, d) for i, d in enumerate((0.3, 0.00009, 0.01, 0.01, 0.2))], "g string, i int, d double")
    near = W.nearest_rank(df, ["g"], "d", 2)
    assert set(rows_of(near.select("i", "distance_rank"))) == {(1, 1), (2, 2), (3, 2)}


def test_autocorrelation_by_station(spark):
    rng = random.Random(9)
    series = {k: [rng.gauss(0, 1) for _ in range(n)] for k, n in (("hot", 60), ("a", 20), ("one", 1))}
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=i), x) for k, xs in series.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "k string, d date, x double")
    ours = {(r[0], r[1]): r[2] for r in rows_of(W.autocorrelation(df, ["k"], "d", "x", 25, batch=10))}
    for k, xs in series.items():
        mean = math.fsum(xs) / len(xs)
        whole = math.fsum((x - mean) ** 2 for x in xs)
        for lag in range(min(26, len(xs))):
            pairs = math.fsum((xs[i] - mean) * (xs[i - lag] - mean) for i in range(lag, len(xs)))
            assert ours.pop((k, lag)) == (pytest.approx(pairs / whole) if whole else None)
    assert not ours


def test_last_days(table):
    df = table([(dt.date(2020, 1, d), "x") for d in (1, 10, 11, 30)], "d date, p string")
    assert [r[0].day for r in rows_of(W.last_days(df, "d", 20, "2020-01-30"))] == [30, 11, 10]


# --- aggregates -------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [1, 7, 10_000])
def test_coordinate_lists_are_whole(spark, chunk):
    rng = random.Random(10)
    rows = [(k, rng.randrange(6), rng.randrange(4)) for k in hot(rng, 200, 3)] + [("hot", 1, 1)] * 50
    out = rows_of(A.coordinate_lists(spark.createDataFrame(rows, "k string, lon int, lat int"), ["k"], chunk=chunk))
    expected = defaultdict(list)
    for k, x, y in rows:
        expected[k].append(f"{x}_{y}")
    got = defaultdict(list)
    for k, part, pairs in sorted(out, key=lambda r: (r[0], r[1])):
        assert len(pairs) <= chunk
        got[k] += pairs
    assert got == {k: sorted(v) for k, v in expected.items()}


@pytest.mark.parametrize("cells", [1, 19, 20, 21])
def test_expand_predictions_pads_and_cuts(table, cells):
    df = table([("g", i, float(i)) for i in range(1, cells + 1)], "g string, rank int, pred double")
    row = rows_of(A.expand_predictions(df, ["g"], ["rank"]))[0]
    assert row[1:] == tuple(float(i) if i <= cells else 0.0 for i in range(1, 21))


def test_medians_agree_and_skip_nulls(spark):
    rng = random.Random(11)
    rows = [(k, rng.choice([None, *map(float, range(9))])) for k in hot(rng, 150)] + [("empty", None)] * 3
    df = spark.createDataFrame(rows, "k string, b double")
    exact = A.band_min_max_median(df, ["k"], ["b"], exact=True)
    assert sorted(rows_of(exact), key=str) == sorted(rows_of(A.band_min_max_median(df, ["k"], ["b"])), key=str)


def test_station_days_drop_unknown_city(table):
    df = table([("x", None, START, 1.0), ("x", "dl", START, 2.0), ("x", "dl", START + dt.timedelta(hours=3), 4.0)],
               "location string, city string, datetime_utc timestamp, value double")
    assert rows_of(A.station_days(df, ["location", "city"]).select("city", "datetime_utc", "value")) == [
        ("dl", START + dt.timedelta(hours=3), 3.0)]


def test_mean_by_skips_nan_only_when_asked(table):
    df = table([("a", float("nan")), ("a", 2.0)], "k string, v double")
    assert rows_of(A.mean_by(df, ["k"], skip_nan=True)) == [("a", 2.0)]
    assert math.isnan(rows_of(A.mean_by(df, ["k"]))[0][1])


# --- cleaning, rasters, splits ----------------------------------------------------------------


def test_label_range(table):
    df = table([(-1.0,), (0.0,), (600.0,), (600.5,), (3.0,)], "value double")
    assert sorted(r[0] for r in rows_of(C.valid_labels(df))) == [3.0, 600.0]
    assert rows_of(C.out_of_range(df, ["value"])) == [(1, 1)]


def test_missing_spellings(table):
    inf = float("inf")
    df = table([(1, -inf, 1.0), (2, float("nan"), 2.0), (3, inf, 3.0), (4, None, 4.0)], "i int, a double, b float")
    assert [r[1] is None for r in rows_of(C.nonfinite_to_null(df).orderBy("i"))] == [True] * 4
    assert [r[1] is None for r in rows_of(C.sentinel_to_null(df).orderBy("i"))] == [True, False, False, True]
    assert dict(rows_of(C.null_profile(df))) == {"i": 0, "a": 2, "b": 0}
    assert dict(rows_of(C.sentinel_profile(df))) == {"a": 1, "b": 0}
    with pytest.raises(ValueError):
        C.assert_finite(df)


def test_names_and_features(table):
    df = table([(1.0, "x", [1.0], 2)], "`avg(max(t_surface00))` double, s string, l array<double>, n int")
    assert C.strip_aggregate_names(df).columns == ["t_surface00", "s", "l", "n"]
    assert C.feature_columns(df, label="n") == (["avg(max(t_surface00))", "s"], ["avg(max(t_surface00))"], ["s"])
    assert C.rename_slot(df, ["avg(max(t_surfaceXX))"], "00").columns[0] == "avg(max(t_surface))"
    assert rows_of(C.casts(table([("1", "x")], "a string, b string"), {"a": "int", "b": "int"})) == [(1, None)]


def test_fill_and_range_masks(table):
    raw = [(r,) for r in (-28672.0, -101.0, -100.0, 5000.0, 5001.0, None)]
    df = table(raw, "raw double")
    ranged = rows_of(df.select(R.range_to_null(F.col("raw"), -28672.0, -100.0, 5000.0, 0.5, 0.0)))
    assert [r[0] for r in ranged] == [None, None, -50.0, 2500.0, None, None]
    filled = rows_of(df.select(R.fill_to_null(F.col("raw"), -28672.0, 0.5, 1.0)))
    assert [r[0] for r in filled] == [None, -51.0, -50.5, 2499.5, 2500.0, None]


def test_cell_missing_in_all_layers_stays_missing(table):
    df = table([(1, float("nan")), (1, None), (2, 1.0), (2, float("nan"))], "c int, b double")
    assert dict(rows_of(R.mean_of_layers(df, ["c"], ["b"]))) == {1: None, 2: 1.0}


def test_coarsen_trims_last_row_and_column(table):
    df = table([("r", i, j, float(i * 11 + j)) for i in range(11) for j in range(11)], "k string, row int, col int, e double")
    out = {r[1:3]: r[3] for r in rows_of(R.coarsen(df, ["k"], "e"))}
    assert out == {(a, b): (5 * a + 2) * 11 + 5 * b + 2 for a in (0, 1) for b in (0, 1)}


def test_first_slot_decides(table):
    df = table([("a", "t", "00", 1.0), ("a", "t", "06", 2.0), ("b", "t", "06", 3.0)], "k string, var string, slot string, value double")
    assert len(rows_of(R.variables_to_columns(df, ["k"], ["t"], ["00", "06"]))) == 2
    assert rows_of(R.variables_to_columns(df, ["k"], ["t"], ["00", "06"], from_first_slot=True)) == [("a", 1.0, 2.0)]


def test_cut_points(table):
    ranks = table([(0.12,), (0.1199,), (0.95,), (0.085,), (0.095,), (0.10,), (1.0,)], "r double")
    folds = rows_of(ranks.select(S.six_folds(F.col("r")), S.interleaved_split(F.col("r"))))
    assert [f[0] for f in folds[:3]] == [1, 0, 11]
    assert [f[1] for f in folds[3:]] == ["valid", "test", "train", "test"]


def test_no_day_is_in_two_sets(spark):
    rng = random.Random(12)
    df = spark.createDataFrame([(i, dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(300))) for i in range(2000)], "i int, d date")
    sets = df.select("d", S.random_split(F.col("d")).alias("s")).distinct()
    assert sets.count() == sets.select("d").distinct().count()
    shares = dict(rows_of(df.groupBy(S.random_split(F.col("i")).alias("s")).agg(F.count("*") / 2000)))
    assert shares["train"] == pytest.approx(0.8, abs=0.04)
    assert df.select(S.random_split(F.col("i"), 1).alias("s")).groupBy("s").count().count() == 3


def test_interval_means_within_one_second(spark):
    """Readings microseconds apart, on either side of an interval's ends."""
    at = dt.datetime(2020, 1, 2, 12, 0, 0, 500_000)
    offsets = (-1, 0, 1, 400_000, -400_000)
    readings = [("a", at + dt.timedelta(days=d, microseconds=o), float(2 ** i)) for i, (d, o) in
                enumerate((d, o) for d in (-1, 0) for o in offsets)]
    left = spark.createDataFrame([(1, "a", at)], "i int, k string, t timestamp")
    right = spark.createDataFrame(readings, "k string, r timestamp, v double")
    inside = [v for _, r, v in readings if at - dt.timedelta(days=1) <= r <= at]
    got = J.interval_means(left, right, ["k"], "t", "r", ["v"], back=1).first()["avg_v"]
    assert got == sum(inside) / len(inside)


def test_positions_keep_null_keys(spark):
    rows = [(i, None if i % 3 else "a", i % 4) for i in range(24)]
    df = spark.createDataFrame(rows, "id int, k string, v int")
    window = Window.partitionBy("k").orderBy("v")
    expected = dict(rows_of(df.select("id", F.percent_rank().over(window))))
    assert dict(rows_of(O.percent_rank(df, "v", keys=["k"]).select("id", "rank"))) == expected
