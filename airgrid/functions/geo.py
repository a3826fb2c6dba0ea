"""Polygon text, distances and coordinate keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airgrid.constants import (
    CITY_CODES, LOCATION_CODES, LOWER_RIGHT_PATTERN, SPHERE_RADIUS_M, UPPER_LEFT_PATTERN,
)

_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
_VERTEX = rf"{_NUMBER}\s+{_NUMBER}"


def wkt_vertices(wkt) -> Column:
    """Polygon text as array of (lon, lat)."""
    pairs = F.regexp_extract_all(wkt, F.lit(_VERTEX), F.lit(0))

    def vertex(text):
        parts = F.split(text, r"\s+")
        return F.struct(parts[0].cast("double").alias("lon"), parts[1].cast("double").alias("lat"))

    return F.transform(pairs, vertex)


def polygon_bounds(wkt, buffer: float = 0.0, lon_shift: float = 0.0) -> list[Column]:
    """min_lon, max_lon, min_lat, max_lat of a polygon, grown by `buffer`, shifted in longitude."""
    ring = wkt_vertices(wkt)
    lons, lats = ring["lon"], ring["lat"]
    return [
        (F.array_min(lons) - buffer + lon_shift).alias("min_lon"),
        (F.array_max(lons) + buffer + lon_shift).alias("max_lon"),
        (F.array_min(lats) - buffer).alias("min_lat"),
        (F.array_max(lats) + buffer).alias("max_lat"),
    ]


def polygon_centroid(wkt) -> Column:
    """Area-weighted centroid (lon, lat); a polygon without area gives the mean of its vertices."""
    # the ring is bound once for a row; as an expression it would be read from the text again for every vertex
    return F.transform(F.array(wkt_vertices(wkt)), _ring_centroid)[0]


def _ring_centroid(ring: Column) -> Column:
    start = ring[0]
    count = F.size(ring)

    # relative to the first vertex, so that large coordinates do not cancel
    edges = F.zip_with(
        F.slice(ring, F.lit(1), count - 1),
        F.slice(ring, F.lit(2), count - 1),
        lambda a, b: F.struct(
            ((a["lon"] - start["lon"]) * (b["lat"] - start["lat"])
             - (b["lon"] - start["lon"]) * (a["lat"] - start["lat"])).alias("cross"),
            (a["lon"] + b["lon"] - 2 * start["lon"]).alias("dx"),
            (a["lat"] + b["lat"] - 2 * start["lat"]).alias("dy"),
        ),
    )
    total = F.aggregate(
        edges,
        F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
        lambda acc, e: F.struct(
            (acc["w"] + e["cross"]).alias("w"),
            (acc["x"] + e["cross"] * e["dx"]).alias("x"),
            (acc["y"] + e["cross"] * e["dy"]).alias("y"),
        ),
    )

    def mean_of(field):
        return F.aggregate(F.slice(ring, F.lit(1), count - 1), F.lit(0.0),
                           lambda acc, v: acc + v[field]) / (count - 1)

    def pick(weighted, field):
        return F.when(weighted["w"] != 0,
                      start[field] + weighted["x" if field == "lon" else "y"] / (3 * weighted["w"])) \
            .otherwise(mean_of(field))

    return F.when(count > 1, F.struct(pick(total, "lon").alias("lon"), pick(total, "lat").alias("lat")))


def point(lon: str, lat: str) -> Column:
    return F.struct(F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"))


def point_text(lon, lat) -> Column:
    return F.concat(F.lit("POINT ("), F.col(lon).cast("string"), F.lit(" "),
                    F.col(lat).cast("string"), F.lit(")"))


def planar_distance(lon1, lat1, lon2, lat2) -> Column:
    """Distance in degrees."""
    return F.hypot(lon1.cast("double") - lon2.cast("double"), lat1.cast("double") - lat2.cast("double"))


def unshift_longitude(lon) -> Column:
    """0..360 minus 180, the inverse of the bounds shift."""
    return lon - 180


def wrap_longitude(lon) -> Column:
    """Any longitude to [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360)) - 180


def location_code(location) -> Column:
    """Code of a location name; unknown names give NULL."""
    code = F.lit(None).cast("string")
    for name, value in LOCATION_CODES.items():
        code = F.when(location == name, value).otherwise(code)
    return code


def city_code(city) -> Column:
    """Code of a city spelling; other spellings stay."""
    code = city
    for name, value in CITY_CODES.items():
        code = F.when(city == name, value).otherwise(code)
    return code


def coordinate_key(lon: str, lat: str) -> Column:
    return F.concat_ws("_", lon, lat)


def rounded_key(column, digits: int = 2) -> Column:
    """Match key of a coordinate: the value at `digits` decimals."""
    return F.round(column.cast("double"), digits)


def corner_points(metadata) -> list[Column]:
    """x0, y0, x1, y1 in metres, from granule metadata text."""

    def number(pattern, group):
        return F.regexp_extract(metadata, pattern, group).try_cast("double")

    return [
        number(UPPER_LEFT_PATTERN, 1).alias("x0"),
        number(UPPER_LEFT_PATTERN, 2).alias("y0"),
        number(LOWER_RIGHT_PATTERN, 1).alias("x1"),
        number(LOWER_RIGHT_PATTERN, 2).alias("y1"),
    ]


def cell_lon_lat(row, col, n_rows, n_cols, x0, y0, x1, y1) -> list[Column]:
    """Cell corner in degrees from sinusoidal metres; the far edge is excluded."""
    x = x0 + col * (x1 - x0) / n_cols
    y = y0 + row * (y1 - y0) / n_rows
    phi = y / F.lit(SPHERE_RADIUS_M)
    lon = F.degrees(x / (F.lit(SPHERE_RADIUS_M) * F.cos(phi)))
    return [lon.alias("lon"), F.degrees(phi).alias("lat")]
