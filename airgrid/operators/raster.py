"""Granule and raster operators over tables of decoded cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions.geo import cell_lon_lat, corner_points
from airgrid.functions.quality import quality_keep
from airgrid.operators.joins import cells_in_boxes
from airgrid.operators.ordering import attach, exact_percentiles
from airgrid.operators.tiles import MOST_POINTS, row_block
from airgrid.session import settle

#: Sizes of boxes that have tiles of their own, each a quarter of the one before; smaller boxes share the last.
_SIZES = 8


def with_corners(df: DataFrame, metadata: str = "metadata") -> DataFrame:
    return df.select("*", *corner_points(F.col(metadata)))


def with_cell_coordinates(df: DataFrame, row: str = "row", col: str = "col", n_rows: str = "n_rows",
                          n_cols: str = "n_cols") -> DataFrame:
    """Add lon, lat of each cell from the corner columns x0, y0, x1, y1."""
    return df.select("*", *cell_lon_lat(*[F.col(c) for c in (row, col, n_rows, n_cols, "x0", "y0", "x1", "y1")]))


def flatten_bands(df: DataFrame, bands: list[str], keys: list[str]) -> DataFrame:
    """One row per cell from one two-dimensional array per band."""
    rows = df.select(*keys, F.posexplode(F.arrays_zip(*bands)).alias("row", "_bands"))
    return rows.select(*keys, "row", F.posexplode(F.arrays_zip(*[F.col(f"_bands.{b}").alias(b) for b in bands]))
                       .alias("col", "_cell")).select(*keys, "row", "col", "_cell.*")


def explode_layers(df: DataFrame, layers: str, keys: list[str], alias: str = "band") -> DataFrame:
    """One row per overpass layer, layers kept apart."""
    return df.select(*keys, F.posexplode(layers).alias("layer", alias))


def fill_to_null(raw: Column, fill, scale=1.0, offset=0.0) -> Column:
    """Missing where the raw value is the fill value, else (raw - offset) * scale."""
    return F.when(raw != fill, (raw - offset) * scale)


def range_to_null(raw: Column, fill, low, high, scale=1.0, offset=0.0) -> Column:
    """Same, and missing where the raw value is outside its valid range."""
    return F.when((raw != fill) & raw.between(low, high), (raw - offset) * scale)


def mean_bands(bands: list[str]) -> list[Column]:
    """Mean of each band; missing values, NaN too, do not count."""
    return [F.avg(F.nanvl(F.col(b).cast("double"), F.lit(None).cast("double"))).alias(b) for b in bands]


def mean_of_layers(df: DataFrame, cell: list[str], bands: list[str]) -> DataFrame:
    """Mean over the overpasses of a cell; missing values do not count."""
    return df.groupBy(*cell).agg(*mean_bands(bands))


def keep_good_quality(df: DataFrame, bands: list[str], word: str = "AOD_QA") -> DataFrame:
    """Set the bands to NULL where the quality word does not pass."""
    return df.withColumns({b: F.when(quality_keep(F.col(word)), F.col(b)) for b in bands})


def box_means(cells: DataFrame, boxes: DataFrame, keys: list[str], bands: list[str], lat: str = "lat", lon: str = "lon",
              most: int = MOST_POINTS) -> DataFrame:
    """Mean of all bands over the cells of each box; `keys` name columns of boxes and of cells.

    A box lies in one tile about its own size, that of its south-west corner, and cells are copied to the tiles whose
    boxes can hold them. All pairs of a box then meet in one place, where they are averaged and not shuffled again. Boxes
    of very different size have tiles of their own. A tile with more than `most` cells is dealt by the cells' keys.
    """
    ends = ["min_lon", "max_lon", "min_lat", "max_lat"]
    of_cells = [k for k in keys if k in cells.columns]
    of_boxes = [k for k in keys if k not in of_cells]
    wide, high = F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat")
    area = boxes.select(*of_boxes, *[F.col(c).cast("double").alias(c) for c in ends]).where((wide >= 0) & (high >= 0)).withColumns({"_w": wide, "_h": high})
    largest, = area.agg(F.max(F.greatest("_w", "_h"))).first()
    # sizes by factors of four from the largest; points and the smallest share the last
    side = F.greatest(F.col("_w"), F.col("_h"))
    size = F.when(side > 0, F.least(F.floor(F.log2(F.lit(largest or 1.0) / side) / 2), F.lit(_SIZES))).otherwise(_SIZES).cast("int")
    area = area.withColumn("_size", size)
    sizes = {r["_size"]: (max(r["w"], r["h"], 1e-6), r["w"], r["h"]) for r in area.groupBy("_size").agg(F.max("_w").alias("w"), F.max("_h").alias("h")).collect()}
    if not sizes:
        sizes = {0: (1.0, 0.0, 0.0)}
    tile = F.element_at(F.create_map(*[F.lit(x) for k, (t, _, _) in sizes.items() for x in (k, t)]), F.col("_size"))

    def number(degrees: Column, width) -> Column:
        return F.floor(degrees / width).cast("long")

    area = area.withColumns({"_ty": number(F.col("min_lat"), tile), "_tx": number(F.col("min_lon"), tile)}).drop("_w", "_h")
    y, x = F.col(lat).cast("double"), F.col(lon).cast("double")
    place = ["_size", "_ty", "_tx"]
    # a thousandth more than the largest box of a size, so that no rounding loses a tile; the exact test follows
    reach = [F.struct(F.lit(k).alias("_size"), F.sequence(number(y - h - t * 1e-3, t), number(y + t * 1e-3, t)).alias("ys"),
                      F.sequence(number(x - w - t * 1e-3, t), number(x + t * 1e-3, t)).alias("xs")) for k, (t, w, h) in sizes.items()]
    values = [F.col(b).cast("double").alias(f"_v_{b}") for b in bands]
    # coordinates that are missing or not finite lie in no box
    known = cells.where((F.abs(y) < float("inf")) & (F.abs(x) < float("inf"))).select(*of_cells, y.alias("_y"), x.alias("_x"), *values, F.explode(F.array(*reach)).alias("_at"))
    known = known.select(*of_cells, "_y", "_x", *[f"_v_{b}" for b in bands], F.col("_at._size").alias("_size"), F.explode("_at.ys").alias("_ty"), "_at.xs")
    known = known.withColumn("_tx", F.explode("xs")).drop("xs")
    full = settle(known.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / most).alias("_blocks")).where("_blocks > 1"))
    merged = False
    if not full.isEmpty():
        known, area = (attach(df, full, place).withColumn("_blocks", F.coalesce("_blocks", F.lit(1).cast("long"))) for df in (known, area))
        # by the cells' keys, so that a mean stays in one block; without any it is put together again
        merged = not of_cells
        block = row_block(known, F.col("_blocks")) if merged else F.pmod(F.xxhash64(*of_cells), F.col("_blocks"))
        known = known.withColumn("_block", block).drop("_blocks")
        area = area.withColumn("_block", F.explode(F.expr("sequence(0L, _blocks - 1)"))).drop("_blocks")
        place = [*place, "_block"]
    # dealt by place even where the boxes are sent to all tasks, since pairs outgrow the cells
    known = known.repartition(*place)
    # boxes of one key may lie in several tiles
    homes = area.select(*of_boxes, "_size", "_ty", "_tx").distinct().groupBy(*of_boxes).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    merged = merged or not homes.isEmpty()
    met = known.join(area.withColumnsRenamed({k: f"_b_{k}" for k in of_boxes}), place).where(
        F.col("_x").between(F.col("min_lon"), F.col("max_lon")) & F.col("_y").between(F.col("min_lat"), F.col("max_lat")))
    by = [F.col(f"_b_{k}").alias(k) if k in of_boxes else F.col(k) for k in keys]
    if not merged:
        return met.groupBy(*place, *by).agg(*[F.avg(f"_v_{b}").alias(b) for b in bands]).select(*keys, *bands)
    sums = met.groupBy(*place, *by).agg(*[f(f"_v_{b}").alias(f"{n}_{b}") for b in bands for n, f in (("_s", F.sum), ("_n", F.count))])
    return sums.groupBy(*keys).agg(*[(F.sum(f"_s_{b}") / F.nullif(F.sum(f"_n_{b}"), F.lit(0))).alias(b) for b in bands])


def flatten_variables(df: DataFrame, variables: list[str], keys: list[str], fill: Column,
                      fill_variables: list[str]) -> DataFrame:
    """One row per place of equally long arrays; the fill value is missing in `fill_variables` only."""
    flat = df.select(*keys, fill.alias("_fill"), F.inline(F.arrays_zip(*variables)))
    return flat.select(*keys, *[
        F.when(F.col(v) != F.col("_fill"), F.col(v)).alias(v) if v in fill_variables else F.col(v) for v in variables])


def cube_slice(cube: DataFrame, boxes: DataFrame, start: Column, stop: Column, time: str = "time", **box) -> DataFrame:
    """Cells inside the boxes and the time slice, both ends included."""
    return cells_in_boxes(cube.where((F.col(time) >= start) & (F.col(time) <= stop)), boxes, **box)


def variables_to_columns(cube: DataFrame, keys: list[str], variables: list[str], slots: list[str],
                         variable: str = "var", slot: str = "slot", value: str = "value",
                         from_first_slot: bool = False) -> DataFrame:
    """One column per variable and slot, in one shuffle.

    `from_first_slot` keeps only places that the first slot has, like a left join starting there.
    """
    wide = cube.groupBy(*keys).agg(*[
        F.max(F.when((F.col(variable) == v) & (F.col(slot) == s), F.col(value))).alias(v + s)
        for s in slots for v in variables],
        F.count_if((F.col(slot) == slots[0]) & (F.col(variable) == variables[0])).alias("_first"))
    return (wide.where(F.col("_first") > 0) if from_first_slot else wide).drop("_first")


def join_variables(cube: DataFrame, keys: list[str], variables: list[str], variable: str = "var",
                   value: str = "value") -> DataFrame:
    """Variables side by side for the places that the first variable has."""
    wide = cube.where(F.col(variable).isin(variables)).groupBy(*keys).agg(*[
        F.max(F.when(F.col(variable) == v, F.col(value))).alias(v) for v in variables],
        F.count_if(F.col(variable) == variables[0]).alias("_first"))
    return wide.where(F.col("_first") > 0).drop("_first")


def coarsen(df: DataFrame, keys: list[str], value: str, size: int = 5, row: str = "row", col: str = "col") -> DataFrame:
    """Drop the last row and column of each raster, then average blocks of size x size.

    A part block at the far edge is averaged over the cells it holds.
    """
    edge = df.groupBy(*keys).agg(F.max(row).alias("_last_row"), F.max(col).alias("_last_col"))
    kept = attach(df, edge, keys).where((F.col(row) < F.col("_last_row")) & (F.col(col) < F.col("_last_col")))
    return kept.groupBy(*keys, F.floor(F.col(row) / size).alias("block_row"),
                        F.floor(F.col(col) / size).alias("block_col")).agg(F.avg(value).alias(value))


def elevation_summary(df: DataFrame, keys: list[str], value: str = "elevation", percentiles: bool = True) -> DataFrame:
    """min, max and avg per key, with the exact quartiles and median unless switched off."""
    base = df.groupBy(*keys).agg(
        F.min(value).alias("min_elevation"), F.max(value).alias("max_elevation"), F.avg(value).alias("avg_elevation"))
    if not percentiles:
        return base
    quartiles = {"pertl25_elevation": 0.25, "pertl75_elevation": 0.75, "median_elevation": 0.5}
    return attach(base, exact_percentiles(df, keys, value, quartiles), keys)


def pick_dataset(df: DataFrame, name: str, column: str = "dataset") -> DataFrame:
    return df.where(F.col(column) == name)
