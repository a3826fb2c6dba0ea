"""Column functions against small worked cases."""

import math

import pytest
from pyspark.sql import functions as F

from airgrid.constants import SLOTS
from airgrid.functions import features as X
from airgrid.functions import geo
from airgrid.functions.quality import binary_to_int, quality_fields, quality_keep, quality_text


def one(table, rows, schema, *columns):
    return [tuple(r) for r in table(rows, schema).select(*columns).collect()]


def test_quality_text(table):
    words = [(9,), (0,), (65535,), (None,), (1 << 15,)]
    found = one(table, words, "q int", quality_text(F.col("q")), quality_text(F.col("q"), zero_as_null=True),
                binary_to_int(quality_text(F.col("q"))))
    assert found[0] == ("0000000000001001", "0000000000001001", 9)
    assert found[1] == ("0" * 16, None, 0)
    assert found[2] == ("1" * 16, "1" * 16, 65535)
    assert found[3] == (None, None, None)
    assert found[4][2] == 1 << 15


def test_quality_fields_both_readings(table):
    word = int("0110100000000000", 2)
    text = one(table, [(word,)], "q int", *quality_fields(F.col("q"), as_text=True))[0]
    assert text[:2] == ("011", "01")
    literal = one(table, [(word,)], "q int", *quality_fields(F.col("q"), one_based=True, as_text=True))[0]
    assert literal[:2] == ("011", "10")


@pytest.mark.parametrize("one_based", [False, True])
def test_quality_numbers_match_texts(table, one_based):
    words = [(w,) for w in (0, 1, 8, 9, 1 << 15, 65535, 26880, 12345)]
    numbers = one(table, words, "q int", *quality_fields(F.col("q"), one_based=one_based))
    texts = one(table, words, "q int", *quality_fields(F.col("q"), one_based=one_based, as_text=True))
    assert numbers == [tuple(int(x, 2) for x in row) for row in texts]


def test_quality_keep(table):
    words = [(int(w, 2),) for w in ("0010000000000000", "0110000000000000", "0000001100000000")]
    assert [r[0] for r in one(table, words, "q int", quality_keep(F.col("q")))] == [True, False, True]


def test_scaled_aod(table):
    found = one(table, [(0.1,), (0.0,), (None,)], "x double", X.scaled_aod(F.col("x")))
    assert found[0][0] == pytest.approx(11.8092)
    assert [r[0] for r in found[1:]] == [None, None]


def test_slot_means(table):
    schema = ", ".join(f"t{s} double" for s in SLOTS)
    found = one(table, [(2.0, None, 4.0, 0.0)], schema, X.slot_mean("t"), X.slot_mean("t", "skip_null"), X.slot_mean("t", "strict"))
    assert found == [(1.5, 2.0, None)]
    with pytest.raises(ValueError):
        X.slot_mean("t", "other")


def test_slot_selection(table):
    schema = "hour int, next boolean, " + ", ".join(f"t{s} double" for s in SLOTS)
    label, forecast = F.lit("2020-01-01").cast("date"), F.when(F.col("next"), F.lit("2020-01-02")).otherwise(F.lit("2020-01-01")).cast("date")
    rows = [(10, False, 1.0, 2.0, 3.0, 4.0), (10, True, 5.0, 6.0, 7.0, 8.0), (0, False, 1.0, 2.0, 3.0, 4.0), (23, False, 1.0, 2.0, 3.0, 4.0)]
    found = one(table, rows, schema, *X.selected_slots(label, F.col("hour"), forecast, ["t"]))
    assert found == [(None, None, 3.0, 4.0), (5.0, 6.0, None, None), (None, 2.0, 3.0, 4.0), (None,) * 4]


def test_wind_and_changes(table):
    assert one(table, [(3.0, 4.0)], "u double, v double", X.wind_speed(F.col("u"), F.col("v"))) == [(5.0,)]
    assert one(table, [(1.0, 4.0)], "t00 double, t18 double", *X.intraday_changes(["t"])) == [(3.0,)]


def test_aqi_class(table):
    values = [(30.0,), (30.1,), (250.0,), (250.1,), (None,), (float("nan"),)]
    assert [r[0] for r in one(table, values, "v double", X.aqi_class(F.col("v")))] == [
        "Good", "Satisfactory", "Very Poor", "Severe", None, None]


def test_calendar_parts(table):
    found = one(table, [("2021-01-03",)], "d string", *X.calendar_parts(F.to_date("d")))
    assert found == [(3, 1, 3, 53, 1, 2021)]


POLYGONS = [
    ("POLYGON ((2 0, 2 1, 0 1, 0 0, 2 0))", (0, 2, 0, 1), (1, 0.5)),
    ("POLYGON ((0 0, 0 1, 2 1, 2 0, 0 0))", (0, 2, 0, 1), (1, 0.5)),
    ("POLYGON ((-118.5 9.5, -118.25 10.5, -118.0 9.5, -118.5 9.5))", (-118.5, -118.0, 9.5, 10.5), (-118.25, 9.5 + 1 / 3)),
    ("POLYGON ((1 1, 2 2, 3 3, 1 1))", (1, 3, 1, 3), (2, 2)),
]


@pytest.mark.parametrize("wkt, bounds, centre", POLYGONS)
def test_polygons(table, wkt, bounds, centre):
    found = one(table, [(wkt,)], "w string", *geo.polygon_bounds(F.col("w")), geo.polygon_centroid(F.col("w")))[0]
    assert found[:4] == pytest.approx(bounds)
    assert tuple(found[4]) == pytest.approx(centre)


def test_polygon_margins(table):
    found = one(table, [(POLYGONS[0][0],)], "w string", *geo.polygon_bounds(F.col("w"), 0.15, 180.0))[0]
    assert found == pytest.approx((179.85, 182.15, -0.15, 1.15))


def test_longitudes(table):
    found = one(table, [(190.0,), (-190.0,), (10.0,)], "x double", geo.unshift_longitude(F.col("x")), geo.wrap_longitude(F.col("x")))
    assert [r[1] for r in found] == [-170.0, 170.0, 10.0]
    assert found[0][0] == 10.0


def test_rounded_key_takes_decimal_halves_up(table):
    assert [r[0] for r in one(table, [(2.675,), (2.674,), (-1.005,)], "x double", geo.rounded_key(F.col("x")))] == [2.68, 2.67, -1.01]


def test_codes(table):
    found = one(table, [("Delhi",), ("LOS ANGELES",), ("臺北市",), ("Paris",), (None,)], "c string",
                geo.city_code(F.col("c")), geo.location_code(F.col("c")))
    assert found == [("dl", "dl"), ("la", None), ("tpe", None), ("Paris", None), (None, None)]


def test_cell_coordinates_invert_the_projection(table):
    radius, rows = 6371007.181, []
    for lat, lon in ((28.5, 77.2), (-33.0, 18.4), (0.0, -118.0)):
        y = math.radians(lat) * radius
        x = math.radians(lon) * radius * math.cos(math.radians(lat))
        rows.append((0, 0, 4, 8, x, y, x + 100.0, y - 100.0, lat, lon))
    found = one(table, rows, "r int, c int, nr int, nc int, x0 double, y0 double, x1 double, y1 double, lat double, lon double",
                *geo.cell_lon_lat(*[F.col(n) for n in ("r", "c", "nr", "nc", "x0", "y0", "x1", "y1")]), "lon", "lat")
    for lon, lat, lon0, lat0 in found:
        assert (lon, lat) == pytest.approx((lon0, lat0))


def test_cells_use_columns_for_x(table):
    found = one(table, [(1, 7, 2, 8, 0.0, 0.0, 800.0, 20.0)], "r int, c int, nr int, nc int, x0 double, y0 double, x1 double, y1 double",
                *geo.cell_lon_lat(*[F.col(n) for n in ("r", "c", "nr", "nc", "x0", "y0", "x1", "y1")]))[0]
    assert found == pytest.approx((math.degrees(700 / 6371007.181), math.degrees(10 / 6371007.181)))


def test_corner_text(table):
    text = "GROUP=X UpperLeftPointMtrs=(-11119505.196667,4447802.078667) LowerRightMtrs=(-10007554.677000,3335851.559000) END"
    found = one(table, [(text,), ("no corners",)], "m string", *geo.corner_points(F.col("m")))
    assert found[0] == (-11119505.196667, 4447802.078667, -10007554.677, 3335851.559)
    assert found[1] == (None,) * 4
