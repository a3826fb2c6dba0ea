"""Windows of satellite granules: which rows and columns of a sinusoidal grid a box of degrees can hold.

A granule has its corners x0, y0, x1, y1 in metres and n_rows x n_cols cells. The inverse of the projection turns a box
into a range of rows and of columns, so that only cells of those ranges are read, scaled and placed. Ranges are wide by
up to one cell; the exact test on degrees follows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.constants import SPHERE_RADIUS_M

GEOMETRY = ["n_rows", "n_cols", "x0", "y0", "x1", "y1"]
BOX = ["min_lon", "max_lon", "min_lat", "max_lat"]
WINDOW = ["row_low", "row_high", "col_low", "col_high"]
#: Degrees by which bounds may be off in their last digits.
SLACK = 1e-6
#: Rows of a granule whose cells meet windows in one task.
BLOCK = 32


def _cosines(low: Column, high: Column) -> tuple[Column, Column]:
    """Least and greatest cosine between two latitudes (radians)."""
    ends = F.cos(low), F.cos(high)
    return F.least(*ends), F.when((low <= 0) & (high >= 0), 1.0).otherwise(F.greatest(*ends))


def granule_bounds(x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    """min_lon, max_lon, min_lat, max_lat that hold all cells of a granule; longitudes stop at one turn either way."""
    radius = F.lit(SPHERE_RADIUS_M)
    low, high = F.least(y0, y1) / radius, F.greatest(y0, y1) / radius
    least, most = _cosines(low, high)
    west, east = F.least(x0, x1) / radius, F.greatest(x0, x1) / radius
    # towards a pole a metre is ever more degrees
    least = F.greatest(least, F.lit(1e-9))
    return [F.greatest(F.degrees(F.least(west / least, west / most)), F.lit(-360.0)).alias("min_lon"),
            F.least(F.degrees(F.greatest(east / least, east / most)), F.lit(360.0)).alias("max_lon"),
            F.degrees(low).alias("min_lat"), F.degrees(high).alias("max_lat")]


def lean_columns() -> list[Column]:
    """Least and greatest cosine of the latitudes that a granule and a box share: how far the granule's columns lean there."""
    y0, y1 = F.col("y0").cast("double"), F.col("y1").cast("double")
    radius = F.lit(SPHERE_RADIUS_M)
    least, most = _cosines(F.greatest(F.radians("min_lat"), F.least(y0, y1) / radius), F.least(F.radians("max_lat"), F.greatest(y0, y1) / radius))
    return [least.alias("_least"), most.alias("_most")]


def window_columns() -> list[Column]:
    """Ranges of rows and columns from columns named as GEOMETRY, BOX and `lean_columns`, ends included.

    A granule without extent in a direction leaves that direction open.
    """
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))
    radius, least, most = F.lit(SPHERE_RADIUS_M), F.col("_least"), F.col("_most")
    low, high = F.radians("min_lat"), F.radians("max_lat")
    west, east = F.radians("min_lon"), F.radians("max_lon")

    def between(a: Column, b: Column, start: Column, end: Column, n: str, names: tuple[str, str]) -> list[Column]:
        step = F.nullif(end - start, F.lit(0.0)) / F.col(n)
        first, last = (a - start) / step, (b - start) / step
        top = F.col(n).cast("long") - 1
        # far outside the granule a place may exceed whole numbers, so it is held near it first
        place = lambda p: F.least(F.greatest(p, F.lit(-1.0)), F.col(n).cast("double"))
        return [F.when(step.isNull(), F.lit(0)).otherwise(F.greatest(F.floor(place(F.least(first, last))), F.lit(0))).cast("long").alias(names[0]),
                F.when(step.isNull(), top).otherwise(F.least(F.ceil(place(F.greatest(first, last))), top)).cast("long").alias(names[1])]

    rows = between(low * radius, high * radius, y0, y1, "n_rows", ("row_low", "row_high"))
    columns = between(radius * F.least(west * least, west * most), radius * F.greatest(east * least, east * most), x0, x1, "n_cols", ("col_low", "col_high"))
    return [*rows, *columns]


def with_windows(pairs: DataFrame) -> DataFrame:
    """Rows that bear a granule's GEOMETRY and a BOX, with their WINDOW; rows whose window is empty fall away."""
    # out of a generator, so that Spark makes a window once, after granules and boxes met, and not in the test whether they meet
    made = pairs.select("*", *lean_columns()).select("*", F.inline(F.array(F.struct(*window_columns())))).drop("_least", "_most")
    return made.where("row_low <= row_high AND col_low <= col_high")


def granule_windows(granules: DataFrame, boxes: DataFrame, keys: list[str], tile: float = 1.0) -> DataFrame:
    """(keys, GEOMETRY, box columns, WINDOW) of each granule and box that can meet.

    `granules` may have a row per cell. Granules and boxes first meet in tiles of degrees, so that neither side is
    compared with all of the other; a pair that shares several tiles is kept in the one where its overlap begins. Only
    pairs whose degrees overlap get a window.
    """

    def tiles(names: tuple[str, str]) -> Column:
        low, high = (F.floor(F.col(n) / tile).cast("long") for n in names)
        return F.when(F.col(names[0]) <= F.col(names[1]), F.sequence(low, high))

    each = granules.select(*keys, *GEOMETRY).distinct()
    bounds = ["_west", "_east", "_south", "_north"]
    placed = each.select("*", *[c.alias(n) for c, n in zip(granule_bounds(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]), bounds)])
    placed = placed.withColumn("_ty", F.explode(tiles(("_south", "_north")))).withColumn("_tx", F.explode(tiles(("_west", "_east"))))
    area = boxes.withColumn("_ty", F.explode(tiles(("min_lat", "max_lat")))).withColumn("_tx", F.explode(tiles(("min_lon", "max_lon"))))
    first_y = F.floor(F.greatest("_south", "min_lat") / tile)
    first_x = F.floor(F.greatest("_west", "min_lon") / tile)
    met = placed.join(area, ["_ty", "_tx"]).where((F.col("_ty") == first_y) & (F.col("_tx") == first_x))
    apart = [F.col(a) > F.col(b) + SLACK for a, b in (("_south", "max_lat"), ("min_lat", "_north"), ("_west", "max_lon"), ("min_lon", "_east"))]
    return with_windows(met.where(~(apart[0] | apart[1] | apart[2] | apart[3])).drop("_ty", "_tx", *bounds))


def _block_of(row: str) -> Column:
    return F.floor(F.col(row) / BLOCK).cast("long")


def cells_in_boxes(cells: DataFrame, windows: DataFrame, keys: list[str], place: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cells in the box of each window of their granule, with the window's other columns; `place` adds lon and lat.

    Cells and windows meet in blocks of rows of a granule, first with the smallest range that holds all windows of the
    block. `place` and what else it does to a cell runs once, however many boxes hold the cell; both joins have the
    same keys, so cells are shuffled once.
    """
    on = [*keys, *GEOMETRY, "_block"]
    blocked = windows.withColumn("_block", F.explode(F.sequence(_block_of("row_low"), _block_of("row_high"))))
    hulls = blocked.groupBy(*on).agg(*_hull())
    ranged = F.col("row").between(F.col("row_low"), F.col("row_high")) & F.col("col").between(F.col("col_low"), F.col("col_high"))
    near = cells.withColumn("_block", _block_of("row")).join(hulls, on).where(ranged).drop(*WINDOW)
    # a test that is never NULL keeps Spark from placing all cells beforehand to leave out those without a place
    return place(near).join(blocked.drop(*WINDOW), on).where(F.coalesce(in_box(), F.lit(False))).drop("_block")


def cells_in_windows(cells: DataFrame, windows: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Cells (a row each, with row and col) of each window of their granule, with the window's other columns.

    Cells and windows meet in blocks of rows of a granule, so a granule with most cells is dealt to many tasks.
    """
    spans = F.explode(F.sequence(F.floor(F.col("row_low") / block).cast("long"), F.floor(F.col("row_high") / block).cast("long")))
    other = windows.withColumn("_block", spans).withColumnsRenamed({k: f"_w_{k}" for k in [*keys, *GEOMETRY]})
    condition = F.floor(cells["row"] / block).cast("long") == other["_block"]
    for k in [*keys, *GEOMETRY]:
        condition = condition & (cells[k] == other[f"_w_{k}"])
    inside = condition & (cells["row"] >= other["row_low"]) & (cells["row"] <= other["row_high"]) \
        & (cells["col"] >= other["col_low"]) & (cells["col"] <= other["col_high"])
    return cells.join(other, inside).drop("_block", *WINDOW, *[f"_w_{k}" for k in [*keys, *GEOMETRY]])


def _hull() -> list[Column]:
    return [(F.min(c) if c.endswith("low") else F.max(c)).alias(c) for c in WINDOW]


def cells_in_hulls(cells: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells, each once, in the smallest range of rows and columns that holds all windows of their granule."""
    on = [*keys, *GEOMETRY]
    hulls = windows.groupBy(*on).agg(*_hull())
    return cells.join(hulls, on).where(F.col("row").between(F.col("row_low"), F.col("row_high")) & F.col("col").between(F.col("col_low"), F.col("col_high"))).drop(*WINDOW)


def merged_windows(windows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One window a granule and `name`, with all BOX columns of that name in `boxes`, so that a name with several boxes has a cell once."""
    return windows.groupBy(*keys, *GEOMETRY, name).agg(*_hull(), F.collect_set(F.struct(*BOX)).alias("boxes"))


def flatten_windows(granules: DataFrame, windows: DataFrame, bands: list[str], keys: list[str]) -> DataFrame:
    """Cells of each window from granules held as one two-dimensional array per band; no other cell is made.

    Gives keys, the windows' columns, row, col and the bands.
    """
    other = windows.drop(*GEOMETRY)
    names = [c for c in other.columns if c not in (*keys, *WINDOW)]
    met = granules.select(*keys, *GEOMETRY, *bands).join(other, keys)
    cut = lambda a, low, high: F.slice(a, F.col(low) + 1, (F.col(high) - F.col(low) + 1).cast("int"))
    rows = met.select(*keys, *GEOMETRY, *names, *WINDOW, F.posexplode(F.arrays_zip(*[cut(F.col(b), "row_low", "row_high").alias(b) for b in bands])).alias("_row", "_bands"))
    return rows.select(*keys, *GEOMETRY, *names, (F.col("row_low") + F.col("_row")).alias("row"), "col_low", F.posexplode(
        F.arrays_zip(*[cut(F.col(f"_bands.{b}"), "col_low", "col_high").alias(b) for b in bands])).alias("_col", "_cell")).select(
        *keys, *GEOMETRY, *names, "row", (F.col("col_low") + F.col("_col")).alias("col"), "_cell.*")


def in_box(lon: str = "lon", lat: str = "lat") -> Column:
    """The exact test of a placed cell against the BOX columns beside it, ends included."""
    return F.col(lon).between(F.col("min_lon"), F.col("max_lon")) & F.col(lat).between(F.col("min_lat"), F.col("max_lat"))
