"""Jobs keyed by grid cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.constants import DEPTH_BANDS, GFS_VARIABLES, MISR_VARIABLES, QA_FIELDS, SLOTS, SUMMARY_BANDS
from airgrid.functions.features import selected_slots
from airgrid.functions.geo import planar_distance, polygon_bounds, polygon_centroid
from airgrid.functions.quality import quality_fields
from airgrid.operators.aggregates import (
    band_min_max_mean, band_min_max_median, coordinate_lists, mean_by,
)
from airgrid.operators.clean import mask_bands
from airgrid.operators.granules import GEOMETRY, cells_in_boxes, cells_in_hulls, cells_in_windows, granule_windows, merged_windows, with_windows
from airgrid.operators.joins import dimension_join, equi_join, interval_bounds, interval_join, interval_means
from airgrid.operators.raster import (
    coarsen, elevation_summary, keep_good_quality, mean_bands, range_to_null, with_cell_coordinates,
)
from airgrid.operators.windows import nearest_rank
from airgrid.sources.readers import granule_catalog
from airgrid.sources.writers import write_changed_partitions

SLOT_COLUMNS = [v + s for s in SLOTS for v in GFS_VARIABLES]


def grid_day_table(cells: DataFrame, forecasts: DataFrame, elevation: DataFrame,
                   bands: list[str] = SUMMARY_BANDS, date: str = "utc_date",
                   clear: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Aerosol summary of clear cells with the mean forecast and elevation, per grid and day; and
    the coordinate lists of the cells, as a second table."""
    fields = quality_fields(F.col("AOD_QA"))
    masked = cells.select("*", *fields)
    names = [c for c in masked.columns if c not in cells.columns]
    keep = (F.col("AOD_QA_Cloud_Mask") == 1) if clear is None else clear
    summary = band_min_max_mean(masked, ["grid_id", date], [*bands, *names], keep)
    daily = mean_by(forecasts.withColumnRenamed("date", date), ["grid_id", date], SLOT_COLUMNS)
    joined = equi_join(summary, daily, ["grid_id", date], "inner")
    return dimension_join(joined, elevation, ["grid_id"]), coordinate_lists(cells, ["grid_id", date])


def labelled_grid_days(cells: DataFrame, forecasts: DataFrame, elevation: DataFrame, labels: DataFrame,
                       bands: list[str] = SUMMARY_BANDS, date: str = "utc_date") -> DataFrame:
    """The grid-day table with the coordinate lists of its cells, for the days that have a label.

    A label's row repeats for each `part` of a list above the chunk size; `part` belongs to the key.
    """
    table, lists = grid_day_table(cells, forecasts, elevation, bands, date)
    listed = equi_join(table, lists, ["grid_id", date], "left")
    return equi_join(listed, labels.withColumnRenamed("date", date), ["grid_id", date], "inner")


def centre_distance(lon: str, lat: str) -> Column:
    """Distance of a point to the grid's centroid, at a digit where mirrored points tie."""
    return F.round(planar_distance(F.col("centroid.lon"), F.col("centroid.lat"), F.col(lon), F.col(lat)), 9)


def with_centroid(grids: DataFrame) -> DataFrame:
    return grids.select("grid_id", polygon_centroid(F.col("wkt")).alias("centroid"))


def near_forecasts(labels: DataFrame, forecasts: DataFrame, grids: DataFrame, time: str = "datetime") -> DataFrame:
    """Per grid and time of the labels the forecast `slots` after it of each of its two days, at the points nearest the grid's centre on that day.

    Labels are copied to their two days, where forecasts meet them. Only the nearest points of a day are copied to its
    labels: one that is nearest over both days is among the nearest of each day that has it.
    """
    first = F.to_date(time)
    copies = labels.select("grid_id", time).where(F.col("grid_id").isNotNull() & F.col(time).isNotNull()) \
        .select("*", F.explode(F.array(first, F.date_add(first, 1))).alias("date")).repartition("grid_id", "date").distinct()
    given = forecasts.select("grid_id", "date", "latitude", "longitude", *SLOT_COLUMNS).join(copies, ["grid_id", "date"], "left_semi")
    placed = dimension_join(given, with_centroid(grids), ["grid_id"]).withColumn("distance", centre_distance("longitude", "latitude"))
    near = nearest_rank(placed, ["grid_id", "date"], "distance", 1).drop("centroid", "distance_rank")
    # a point without a full place has no forecast
    slots = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), F.struct(*selected_slots(first, F.hour(time), F.col("date"))))
    return copies.join(near, ["grid_id", "date"]).select("grid_id", time, "latitude", "longitude", "distance", slots.alias("slots"))


def nearest_slots(near: DataFrame, keys: list[str]) -> DataFrame:
    """The slots of both days at the nearest of `near_forecasts`' points, by grid and time (and what follows from them)."""
    ranked = nearest_rank(near, keys, "distance", 1)
    return ranked.groupBy(*keys, "latitude", "longitude").agg(*[F.max(f"slots.{c}").alias(c) for c in SLOT_COLUMNS]).drop("latitude", "longitude")


def nearest_forecasts(labels: DataFrame, forecasts: DataFrame, grids: DataFrame, time: str = "datetime") -> DataFrame:
    """Per label the forecast slots after its start, at the forecast point nearest the grid's centre."""
    keys = ["grid_id", time]
    near = near_forecasts(labels, forecasts, grids, time).repartition(*keys)
    return equi_join(labels.repartition(*keys).distinct(), nearest_slots(near, keys), keys).select(*labels.columns, *SLOT_COLUMNS)


def distinct_cells(cells: DataFrame, keys: list[str], bands: list[str] = SUMMARY_BANDS) -> DataFrame:
    """One row per grid, cell and `keys`: repeated rows count once, the readings left are averaged.

    The quality word is averaged too and cut to a whole number. Cells of a grid and `keys`, which are those of one box,
    come to one task, where what follows per grid and `keys` finds them.
    """
    by = ["grid_id", "lon", "lat", *keys]
    once = cells.drop("index").repartition("grid_id", *keys).distinct()
    return once.groupBy(*by).agg(*[F.avg(b).alias(b) for b in bands], F.avg("AOD_QA").cast("int").alias("AOD_QA"))


def clear_cells(cells: DataFrame, keep: int = 1) -> DataFrame:
    """Quality fields added; optical depths missing where the cloud mask is not `keep`."""
    fields = quality_fields(F.col("AOD_QA"))
    return mask_bands(cells.select("*", *fields), DEPTH_BANDS, F.col("AOD_QA_Cloud_Mask") == keep)


def summarised(cells: DataFrame, keys: list[str], bands: list[str] = SUMMARY_BANDS) -> DataFrame:
    """min_, max_ and median_ of the bands and of the eight quality fields of clear cells."""
    return band_min_max_median(clear_cells(cells), keys, [*bands, *[name for name, _, _ in QA_FIELDS]])


def date_validated_table(labels: DataFrame, forecasts: DataFrame, cells: DataFrame, elevation: DataFrame,
                         grids: DataFrame, bands: list[str] = SUMMARY_BANDS) -> DataFrame:
    """One row per label: aerosol min, max, median, the forecast that follows the label, elevation."""
    ahead = nearest_forecasts(labels, forecasts, grids)
    summary = summarised(distinct_cells(cells, ["datetime"], bands), ["grid_id", "datetime"], bands)
    return dimension_join(equi_join(summary, ahead, ["grid_id", "datetime"], "right"), elevation, ["grid_id"])


def cell_table(labels: DataFrame, forecasts: DataFrame, cells: DataFrame, elevation: DataFrame, grids: DataFrame,
               nearest: int = 20, bands: list[str] = SUMMARY_BANDS) -> DataFrame:
    """One row per label and each of the cells nearest to the grid's centre."""
    placed = dimension_join(clear_cells(distinct_cells(cells, ["datetime"], bands)), with_centroid(grids), ["grid_id"]).withColumn(
        "AOD_distance_to_grid_center", centre_distance("lon", "lat"))
    near = nearest_rank(placed, ["grid_id", "datetime"], "AOD_distance_to_grid_center", nearest, "AOD_distance_rank") \
        .select("grid_id", "datetime", *bands, "AOD_distance_to_grid_center", "AOD_distance_rank")
    ahead = nearest_slots(near_forecasts(labels, forecasts, grids).repartition("grid_id", "datetime"), ["grid_id", "datetime"])
    joined = equi_join(labels, near, ["grid_id", "datetime"], "left")
    return dimension_join(equi_join(joined, ahead, ["grid_id", "datetime"], "left"), elevation, ["grid_id"])


def submission_table(submission: DataFrame, forecasts: DataFrame, readings: DataFrame, elevation: DataFrame,
                     grids: DataFrame, bands: list[str] = SUMMARY_BANDS, reading_time: str = "aod_reading_end") -> DataFrame:
    """The validated table for rows to predict: cells read within a day either way.

    The days around depend on the day asked for alone, so cells are summed up once per grid and day. Days asked for are
    copied to the days around them, readings are not; repeated readings are told once they met. All meet by the day asked for.
    """
    asked, day = submission.select("grid_id", "datetime"), F.to_date("datetime")
    # rows asked for stand with their forecasts, behind them, so that they need no join
    near = near_forecasts(asked, forecasts, grids).withColumn("distance", F.struct(F.lit(False).alias("none"), "distance"))
    none = asked.withColumn("distance", F.struct(F.lit(True).alias("none"), F.lit(None).cast("double").alias("distance")))
    near = near.unionByName(none, allowMissingColumns=True).repartition("grid_id", day).withColumn("label_day", day)
    ahead = nearest_slots(near, ["grid_id", "label_day", "datetime"])
    around = F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.date_add(day, i)))
    days = asked.select(F.col("grid_id").alias("_grid"), day.alias("label_day"), around.alias("_day")).repartition("_grid", "_day").distinct()
    # the day behind ends as it begins
    stamp = F.col(reading_time).cast("timestamp")
    low, high = interval_bounds(F.col("label_day"), 1, 1, "calendar")
    read = readings.drop("index").join(days, (F.col("grid_id") == F.col("_grid")) & (F.to_date(stamp) == F.col("_day")) & stamp.between(low, high))
    once = read.drop("_grid", "_day").repartition("grid_id", "label_day").distinct()
    cells = once.groupBy("grid_id", "lon", "lat", "label_day").agg(*[F.avg(b).alias(b) for b in bands], F.avg("AOD_QA").cast("int").alias("AOD_QA"))
    summary = summarised(cells, ["grid_id", "label_day"], bands)
    names = [c for c in summary.columns if c not in ("grid_id", "label_day")]
    table = equi_join(ahead, summary, ["grid_id", "label_day"]).select("grid_id", "datetime", *names, *SLOT_COLUMNS)
    return dimension_join(table, elevation, ["grid_id"])


def merge_misr(table: DataFrame, misr: DataFrame, keys: list[str], variables: list[str] = MISR_VARIABLES) -> DataFrame:
    """Full join with the mean of the multi-angle cells; both sides' keys survive."""
    return equi_join(table, mean_by(misr, keys, variables), keys, "full")


def composition_features(labels: DataFrame, hourly: DataFrame, values: list[str], mode: str = "calendar") -> DataFrame:
    """Mean of the hourly composition since the day before each label."""
    return interval_means(labels, hourly, ["grid_id"], "datetime", "time", values, back=1, mode=mode)


def elevation_table(raster: DataFrame, keys: list[str], percentiles: bool = True, size: int = 5) -> DataFrame:
    """Elevation statistics of each polygon (or point) over the block-averaged raster."""
    return elevation_summary(coarsen(raster, keys, "elevation", size), keys, "elevation", percentiles)


def granule_cells(granules: DataFrame, grids: DataFrame, bands: list[str], fill: Column, low: Column, high: Column,
                  scale: Column, offset: Column, depth_bands: tuple[str, ...] = (), average: bool = False,
                  tile: float = 1.0, digits: int | None = None) -> DataFrame:
    """Cells of each granule inside each grid's bounds, scaled, checked and placed.

    `granules` is one row per overpass cell with raw bands, AOD_QA, the cell's place and the
    granule's corners. `depth_bands` are blanked where the quality word fails; `average` merges
    the overpasses of a cell. Only rows and columns that a grid's bounds can hold are scaled and placed, once for all grids;
    so are the places rounded to `digits`, which the bounds are not compared with.
    """
    boxes = grids.select("grid_id", *polygon_bounds(F.col("wkt")))
    windows = granule_windows(granules, boxes, ["granule_id"], tile)
    if average:
        # a cell's mean is the same in every box, so overpasses are merged once, before cells meet boxes
        cell = ["granule_id", *GEOMETRY, "row", "col"]
        checked = checked_bands(cells_in_hulls(granules, windows, ["granule_id"]), bands, fill, low, high, scale, offset, depth_bands)
        placed = with_shown_place(with_cell_coordinates(checked.groupBy(*cell).agg(*mean_bands(bands))), digits)
        merged = cells_in_windows(placed, merged_windows(windows, ["granule_id"], "grid_id"), ["granule_id"])
        inside = F.exists("boxes", lambda b: F.col("lon").between(b["min_lon"], b["max_lon"]) & F.col("lat").between(b["min_lat"], b["max_lat"]))
        return merged.where(inside).select("grid_id", "granule_id", *shown_place(digits), *bands)
    found = checked_cells(granules, windows, ["granule_id"], bands, fill, low, high, scale, offset, depth_bands, digits)
    return found.select("grid_id", "granule_id", "layer", *shown_place(digits), *bands)


def with_shown_place(cells: DataFrame, digits: int | None) -> DataFrame:
    """Add lon and lat rounded to `digits`, beside the exact ones; adding zero turns -0.0 into 0.0."""
    return cells if digits is None else cells.withColumns({f"_{c}": F.round(c, digits) + F.lit(0.0) for c in ("lon", "lat")})


def shown_place(digits: int | None) -> list[Column]:
    """lon and lat of `with_shown_place`."""
    return [F.col(c if digits is None else f"_{c}").alias(c) for c in ("lon", "lat")]


def checked_cells(cells: DataFrame, windows: DataFrame, keys: list[str], bands: list[str], fill: Column, low: Column, high: Column,
                  scale: Column, offset: Column, depth_bands: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """Cells in the boxes of their granule's windows, scaled, checked by range and quality word, and placed."""

    def place(near: DataFrame) -> DataFrame:
        return checked_bands(with_shown_place(with_cell_coordinates(near), digits), bands, fill, low, high, scale, offset, depth_bands)

    return cells_in_boxes(cells, windows, keys, place)


def checked_bands(cells: DataFrame, bands: list[str], fill: Column, low: Column, high: Column, scale: Column, offset: Column,
                  depth_bands: tuple[str, ...] = ()) -> DataFrame:
    """Bands scaled and checked by range and quality word."""
    scaled = cells.withColumns({b: range_to_null(F.col(b), fill, low, high, scale, offset) for b in bands})
    return keep_good_quality(scaled, list(depth_bands))


def granule_readings(labels: DataFrame, catalog: DataFrame, on: list[str], product: str, suffix: str, split: str | None = "train",
                     label_time: str = "datetime", reading_time: str = "time_end", back: int = 1, ahead: int = 0) -> DataFrame:
    """Each label with each catalogued granule of a product read within days before (or after) it."""
    wanted = granule_catalog(catalog, product, suffix, split).select(*on, "granule_id", reading_time)
    return interval_join(labels, wanted, on, label_time, reading_time, back=back, ahead=ahead, how="inner")


def granule_partitions(readings: DataFrame, cells: DataFrame, grids: DataFrame, path: str, bands: list[str], fill: Column, low: Column,
                       high: Column, scale: Column, offset: Column, scene: str = "granule_id", reading_time: str = "time_end",
                       label_time: str = "datetime", label: str = "label_id", depth_bands: tuple[str, ...] = ()) -> DataFrame:
    """Cells around each label in files by month and share of the grids; gives the grid-months that were written.

    `readings` are labels with granules (`granule_readings`); `scene` names the column by which a reading finds its
    cells. Only grid-months whose readings differ from those of the last run are computed, each whole, and only folders
    that hold one are written, so a run after a failed one or over more readings never doubles rows, and one without
    news writes nothing. Grids share folders, since a folder for each grid and month is more files than rows are worth.
    """
    work = readings.select("grid_id", F.date_format(label_time, "yyyy-MM").alias("month"), label, F.col(label_time).alias("label_time"),
                           F.col(reading_time).alias("reading_time"), "granule_id", F.col(scene).alias("_scene"))

    def rows(todo: DataFrame) -> DataFrame:
        boxes = grids.select("grid_id", *polygon_bounds(F.col("wkt")))
        asked = todo.select("grid_id", "_scene").distinct()
        views = cells.withColumnRenamed("granule_id", "_scene")
        corners = views.select("_scene", *GEOMETRY).distinct()
        windows = with_windows(asked.join(boxes, "grid_id").join(corners, "_scene"))
        found = checked_cells(views, windows, ["_scene"], bands, fill, low, high, scale, offset, depth_bands)
        found = found.select("grid_id", "_scene", "layer", "lon", "lat", *bands)
        return todo.join(found, ["grid_id", "_scene"]).drop("_scene")

    return write_changed_partitions(work, rows, path, ("grid_id", "month"), shared=("grid_id",))
