"""Joins: equal keys, time intervals, forecast days and boxes.

Interval, day-pair and box conditions are turned into equal keys by copying the right side into
every bucket (day or tile) that can match, so each left row stays one row, outer joins need no
repair, and no task meets a whole key. The full condition is checked again within the bucket.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airgrid.constants import GFS_VARIABLES, NO_DATA_ANSWER, SLOTS
from airgrid.functions.features import selected_slots
from airgrid.functions.geo import rounded_key
from airgrid.operators.ordering import attach
from airgrid.operators.tiles import LEAF, MOST_POINTS, adaptive_tiles, row_block
from airgrid.session import settle

#: Rows of one key and day on a side from which on an interval join deals them into blocks.
HEAVY_ROWS = 1_000_000


def _hide(df: DataFrame, columns) -> DataFrame:
    return df.withColumnsRenamed({c: f"_r_{c}" for c in columns})


def equi_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join on equal keys, keeping one copy of them; a full join keeps the key of either side."""
    return left.join(right, on, how)


def dimension_join(df: DataFrame, dimension: DataFrame, on: list[str]) -> DataFrame:
    """Look up a dimension; Spark broadcasts it when its size is under the session's threshold."""
    return df.join(dimension, on, "left")


def interval_bounds(t: Column, back: int, ahead: int, mode: str) -> tuple[Column, Column]:
    """First and last matching time. `calendar` opens (and closes) the window at midnight."""
    t = t.cast("timestamp")
    if mode == "calendar":
        day = F.to_date(t)
        low = F.date_sub(day, back).cast("timestamp") if back else t
        high = F.date_add(day, ahead).cast("timestamp") if ahead else t
    elif mode == "exact":
        low, high = t - F.expr(f"INTERVAL {back} DAY"), t + F.expr(f"INTERVAL {ahead} DAY")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return low, high


def _covering_days(r: Column, back: int, ahead: int) -> Column:
    """Days of the left times that a right time can match."""
    day = F.to_date(r.cast("timestamp"))
    return F.explode(F.transform(
        F.array(*[F.lit(i) for i in range(-ahead, back + 1)]), lambda i: F.date_add(day, i)))


def interval_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str,
                  back: int = 0, ahead: int = 0, mode: str = "exact", how: str = "left", heavy: int | None = HEAVY_ROWS) -> DataFrame:
    """Join equal `on` keys where the right time lies within days of the left time, ends included.

    Inner and left joins first count the rows of each (key, day). One with more than `heavy` rows on a side is dealt into
    blocks of that side, to which the other side's rows are copied, so no task meets all rows of a hot key's day.
    `heavy` None leaves skew to adaptive execution.
    """
    other = _hide(right, on).withColumn("_day", _covering_days(F.col(right_time), back, ahead))
    hidden = [f"_r_{k}" for k in on]
    between = _between(left_time, right_time, back, ahead, mode)
    if heavy is not None and how in ("left", "inner"):
        days = _heavy_days(left, other, on, left_time, heavy)
        if not days.isEmpty():
            return _split_interval_join(left, right, other, on, left_time, right_time, back, ahead, mode, how, days)
    condition = F.to_date(left[left_time].cast("timestamp")) == other["_day"]
    for key in on:
        condition = condition & (left[key] == other[f"_r_{key}"])
    return left.join(other, condition & between(left, other), how).drop("_day", *hidden)


def _between(left_time: str, right_time: str, back: int, ahead: int, mode: str):
    """The interval's condition on a left and a right table."""

    def condition(left: DataFrame, right: DataFrame) -> Column:
        low, high = interval_bounds(left[left_time], back, ahead, mode)
        stamp = right[right_time].cast("timestamp")
        return (stamp >= low) & (stamp <= high)

    return condition


def _heavy_days(left: DataFrame, other: DataFrame, on: list[str], left_time: str, heavy: int) -> DataFrame:
    """(on, _day, _kl, _kr): blocks of the left and of the right rows of each (key, day) that has too many on a side."""
    # a day has no more rows than its key, and keys are few: only days of keys with too many rows are counted
    one, none = F.count(F.lit(1)), F.lit(0).cast("long")
    hidden = [F.col(f"_r_{k}").alias(k) for k in on]
    full = [df.groupBy(*by).agg(one.alias("_rows")).where(F.col("_rows") > heavy).drop("_rows") for df, by in ((left, on), (other, hidden))]
    keys = settle(full[0].union(full[1]).distinct())
    left = attach(left, keys, on, "left_semi")
    other = attach(other, keys.withColumnsRenamed({k: f"_r_{k}" for k in on}), [f"_r_{k}" for k in on], "left_semi")
    day = F.to_date(F.col(left_time).cast("timestamp")).alias("_day")
    asked = left.groupBy(*on, day).agg(one.alias("_kl"), none.alias("_kr"))
    given = other.groupBy(*[F.col(f"_r_{k}").alias(k) for k in on], "_day").agg(none.alias("_kl"), one.alias("_kr"))
    many = asked.unionByName(given).groupBy(*on, "_day").agg(F.sum("_kl").alias("_kl"), F.sum("_kr").alias("_kr"))
    many = many.where((F.col("_kl") > heavy) | (F.col("_kr") > heavy))
    return settle(many.withColumns({c: F.greatest(F.ceil(F.col(c) / heavy), F.lit(1)).cast("long") for c in ("_kl", "_kr")}))


def _dealt(left: DataFrame, other: DataFrame, on: list[str], left_time: str, days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with their block numbers _i (of left rows) and _j (of right rows); a row is copied to all blocks of the other side."""
    one = F.lit(1).cast("long")
    blocks = {c: F.coalesce(c, one) for c in ("_kl", "_kr")}

    def spread(df, block, copies, side_block, copied_block):
        out = df.withColumn(side_block, row_block(df, blocks[block])).withColumns(blocks)
        return out.withColumn(copied_block, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)))

    marked = attach(left.withColumn("_day", F.to_date(F.col(left_time).cast("timestamp"))), days, [*on, "_day"])
    hidden = [f"_r_{k}" for k in on]
    given = attach(other, days.withColumnsRenamed(dict(zip(on, hidden))), [*hidden, "_day"])
    return spread(marked, "_kl", "_kr", "_i", "_j"), spread(given, "_kr", "_kl", "_j", "_i")


def _split_interval_join(left, right, other, on, left_time, right_time, back, ahead, mode, how, days) -> DataFrame:
    """`interval_join` where some (key, day) are dealt into blocks.

    A left row of an outer join stands in one block unless its day's right rows are dealt. Those rows are joined inner,
    and the ones without any match are told by their times alone and added once.
    """
    hidden = [f"_r_{k}" for k in on]
    between = _between(left_time, right_time, back, ahead, mode)
    asked, given = _dealt(left, other, on, left_time, days)
    extra = [c for c in other.columns if c not in ("_day", *hidden)]

    def met(rows: DataFrame, kind: str) -> DataFrame:
        table = given.withColumnsRenamed({"_day": "_r_day", "_i": "_r_i", "_j": "_r_j"}).drop("_kl", "_kr")
        condition = (rows["_day"] == table["_r_day"]) & (rows["_i"] == table["_r_i"]) & (rows["_j"] == table["_r_j"])
        for key in on:
            condition = condition & (rows[key] == table[f"_r_{key}"])
        return rows.join(table, condition & between(rows, table), kind).select(*[rows[c] for c in left.columns], *[table[c] for c in extra])

    if how == "inner":
        return met(asked, "inner")
    lone, copied = asked.where("_kr = 1"), asked.where("_kr > 1")
    first = copied.where("_j = 0")
    # a NULL key matches nothing
    times = first.select(*on, left_time).dropna(subset=on).distinct()
    seen = right.select(*on, right_time).dropna(subset=on).distinct().withColumn("_one", F.lit(1.0))
    if back + ahead:
        told = interval_means(times, seen, on, left_time, right_time, ["_one"], back, ahead, mode).where("avg__one IS NOT NULL").drop("avg__one")
    else:
        stamps = seen.select(*on, F.col(right_time).cast("timestamp").alias("_at")).distinct()
        told = times.withColumn("_at", F.col(left_time).cast("timestamp")).join(stamps, [*on, "_at"], "left_semi").drop("_at")
    alone = attach(first.select(left.columns), told.withColumn("_met", F.lit(True)), [*on, left_time]).where("_met IS NULL").drop("_met")
    kinds = {c: other.schema[c].dataType for c in extra}
    alone = alone.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()})
    return met(lone, "left").union(met(copied, "inner")).union(alone)


def rounded_interval_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, digits: int = 2,
                          lat: str = "latitude", lon: str = "longitude", **interval) -> DataFrame:
    """Interval join on coordinates equal after rounding."""
    keys = ["_lat_key", "_lon_key"]

    def keyed(df):
        return df.withColumns({keys[0]: rounded_key(F.col(lat), digits), keys[1]: rounded_key(F.col(lon), digits)})

    other = keyed(right).drop(lat, lon)
    return interval_join(keyed(left), other, keys, left_time, right_time, **interval).drop(*keys)


def interval_means(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str,
                   values: list[str], back: int = 1, ahead: int = 0, mode: str = "exact") -> DataFrame:
    """Mean of the right values inside each left row's interval, without emitting the pairs.

    An interval is the tail of its first day, whole days, and the head of its last day. Heads and
    tails are running sums over the seconds of one (key, day); whole days are one summed row each,
    and only the two seconds an interval begins and ends in are looked at row by row.
    """
    if back + ahead < 1:
        raise ValueError("the interval must span at least a day")
    sums, counts = [f"_s_{v}" for v in values], [f"_n_{v}" for v in values]
    measures = [*sums, *counts]

    def totals(df, *keys):
        return df.groupBy(*on, *keys).agg(*[F.sum(m).alias(m) for m in measures])

    at, second = F.col("_at"), F.unix_seconds("_at").alias("_second")
    stamp = F.col(right_time).cast("timestamp")
    read = right.where(F.col(right_time).isNotNull()).select(*dict.fromkeys([*on, *values]), stamp.alias("_at")).select("*", second) \
        .withColumn("_day", F.floor(F.col("_second") / 86400))

    def summed(*keys):
        return read.groupBy(*on, *keys).agg(*[F.sum(F.col(v).cast("double")).alias(s) for v, s in zip(values, sums)],
                                            *[F.count(v).alias(n) for v, n in zip(values, counts)])

    # times, seconds and days are each summed from the rows, in one shuffle; one from the other they would take six
    partial, per_second = summed("_at", "_second"), summed("_second", "_day")

    asked = left.where(F.col(left_time).isNotNull()).select(*on, F.col(left_time).alias("_ask")).distinct()
    low, high = interval_bounds(F.col("_ask"), back, ahead, mode)
    asked = asked.select("*", low.alias("_low"), high.alias("_high"))
    ends = asked.select(*on, "_ask", F.inline(F.array(
        F.struct(F.lit(False).alias("_head"), F.col("_low").alias("_at")),
        F.struct(F.lit(True).alias("_head"), F.col("_high").alias("_at"))))).select("*", second)
    probes = ends.drop("_at").withColumn("_day", F.floor(F.col("_second") / 86400))

    seconds = Window.partitionBy(*on, "_day")
    before = seconds.orderBy("_second").rangeBetween(Window.unboundedPreceding, -1)
    after = seconds.orderBy(F.col("_second").desc()).rangeBetween(Window.unboundedPreceding, -1)
    running = per_second.unionByName(probes, allowMissingColumns=True).select(*on, "_ask", "_head", *[
        F.when(F.col("_head"), F.sum(m).over(before)).otherwise(F.sum(m).over(after)).alias(m) for m in measures])
    parts = running.where(F.col("_head").isNotNull()).select(*on, "_ask", *measures)

    same_second = ends.withColumnRenamed("_at", "_end").join(partial, [*on, "_second"])
    edges = same_second.where(F.when(F.col("_head"), at <= F.col("_end")).otherwise(at >= F.col("_end")))
    parts = parts.unionByName(edges.select(*on, "_ask", *measures))

    if back + ahead > 1:
        daily = summed("_day")
        first, last = (F.floor(F.unix_seconds(c) / 86400) for c in ("_low", "_high"))
        days = F.filter(F.sequence(first, last), lambda d: (d > first) & (d < last))
        whole = asked.select(*on, "_ask", F.explode(days).alias("_day")).join(daily, [*on, "_day"])
        parts = parts.unionByName(whole.select(*on, "_ask", *measures))

    means = totals(parts, "_ask").select(*on, F.col("_ask").alias(left_time), *[
        (F.col(s) / F.nullif(F.col(n), F.lit(0))).alias(f"avg_{v}") for v, s, n in zip(values, sums, counts)])
    return attach(left, means, [*on, left_time])


def day_pair_join(left: DataFrame, right: DataFrame, on: list[str], left_date: str, right_date: str,
                  how: str = "left") -> DataFrame:
    """Join equal keys where the right date is the left date or the day after.

    The right side's `on` keys are dropped; in a full join they fill the left ones.
    """
    other = _hide(right, on)
    copies = other.withColumn("_match", F.explode(F.array(F.col(right_date), F.date_sub(right_date, 1))))
    condition = left[left_date] == copies["_match"]
    for key in on:
        condition = condition & (left[key] == copies[f"_r_{key}"])
    hidden = [f"_r_{k}" for k in on]
    if how in ("left", "inner"):
        return left.join(copies, condition, how).drop("_match", *hidden)
    if how != "full":
        raise ValueError(f"unsupported join {how!r}")
    matched = left.join(copies, condition, "left").drop("_match", *hidden)
    asked = left.select(*on, F.explode(F.array(F.col(left_date), F.date_add(left_date, 1))).alias(right_date)).distinct()
    unmatched = right.join(asked, [*on, right_date], "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True).select(matched.columns)


def forecast_for_labels(labels: DataFrame, forecasts: DataFrame, on: list[str], label_time: str,
                        forecast_date: str, variables=GFS_VARIABLES, slots=SLOTS, keep: tuple[str, ...] = (),
                        how: str = "left") -> DataFrame:
    """Per label (and `keep` columns of the forecast) the first forecast slots after it starts.

    Labels are copied to their two days, not the wider forecasts, where only labels are grouped by.
    """
    dated = labels.withColumn("_label_date", F.to_date(label_time))
    if keep or how != "left":
        paired = day_pair_join(dated, forecasts, on, "_label_date", forecast_date, how)
    else:
        asked = dated.withColumn("_match", F.explode(F.array("_label_date", F.date_add("_label_date", 1))))
        other = _hide(forecasts.select(*on, forecast_date, *[v + s for s in slots for v in variables]), [*on, forecast_date])
        condition = asked["_match"] == other[f"_r_{forecast_date}"]
        for key in on:
            condition = condition & (asked[key] == other[f"_r_{key}"])
        paired = asked.join(other, condition, "left").withColumnRenamed(f"_r_{forecast_date}", forecast_date)
    chosen = paired.select(
        *labels.columns, *keep,
        *selected_slots(F.col("_label_date"), F.hour(label_time), F.col(forecast_date), variables, slots))
    return chosen.groupBy(*labels.columns, *keep).agg(
        *[F.max(v + s).alias(v + s) for s in slots for v in variables])


def box_join(left: DataFrame, right: DataFrame, radius: float, lat: str = "latitude", lon: str = "longitude",
             digits: int = 2, dates: tuple[str, str] | None = None, how: str = "left", most: int | None = MOST_POINTS) -> DataFrame:
    """Join points within `radius` degrees in both directions, on rounded coordinates.

    With `dates` = (left, right) the right date must also be the left date or the day after. The
    right coordinates come back as `right_<name>`. Tiles with more than `most` points are quartered.
    """
    y, x = rounded_key(F.col(lat), digits), rounded_key(F.col(lon), digits)
    # a box spans two tiles in a direction, or three where rounding puts an end on an edge
    tiles = adaptive_tiles(2 * radius * (1 + 1e-9) + 1e-9, [(left, y, x), (right, y, x)], most)
    tagged = tiles.of_points(left.withColumns({"_y": y, "_x": x}), F.col("_y"), F.col("_x"))
    other = right.withColumns({"_ry": y, "_rx": x}).withColumnsRenamed({lat: f"right_{lat}", lon: f"right_{lon}"})
    ry, rx = F.col("_ry"), F.col("_rx")
    other = tiles.of_boxes(other, ry - radius, ry + radius, rx - radius, rx + radius).withColumnsRenamed({c: f"_r{c}" for c in LEAF})
    condition = _same_leaf(tagged, other)
    if dates:
        other = other.withColumn("_match", F.explode(F.array(F.col(dates[1]), F.date_sub(dates[1], 1))))
        condition = condition & (tagged[dates[0]] == other["_match"])
    condition = condition & (other["_ry"] + radius >= tagged["_y"]) & (other["_ry"] - radius <= tagged["_y"]) \
        & (other["_rx"] + radius >= tagged["_x"]) & (other["_rx"] - radius <= tagged["_x"])
    return tagged.join(other, condition, how).drop("_y", "_x", "_ry", "_rx", "_match", *LEAF, *[f"_r{c}" for c in LEAF])


def _same_leaf(points: DataFrame, boxes: DataFrame) -> Column:
    return reduce(and_, [points[c] == boxes[f"_r{c}"] for c in LEAF])


def cells_in_boxes(cells: DataFrame, boxes: DataFrame, lat: str = "lat", lon: str = "lon", tile: float = 1.0,
                   on: list[str] = (), most: int | None = MOST_POINTS) -> DataFrame:
    """Cells inside each box (min_lon, max_lon, min_lat, max_lat; ends included), with the box columns.

    Tiles with more than `most` cells are quartered, and cells of one place dealt into blocks.
    """
    y, x = F.col(lat).cast("double"), F.col(lon).cast("double")
    tiles = adaptive_tiles(tile, [(cells, y, x)], most)
    placed = tiles.of_points(cells, y, x)
    area = tiles.of_boxes(_hide(boxes, on), F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon")) \
        .withColumnsRenamed({c: f"_r{c}" for c in LEAF})
    condition = _same_leaf(placed, area)
    for key in on:
        condition = condition & (placed[key] == area[f"_r_{key}"])
    y, x = placed[lat].cast("double"), placed[lon].cast("double")
    condition = condition & (x >= area["min_lon"]) & (x <= area["max_lon"]) \
        & (y >= area["min_lat"]) & (y <= area["max_lat"])
    return placed.join(area, condition).drop(
        *LEAF, *[f"_r{c}" for c in LEAF], "min_lon", "max_lon", "min_lat", "max_lat", *[f"_r_{k}" for k in on])


def latest_value_lookup(requests: DataFrame, series: DataFrame, date: str, value: str = "value", digits: int = 2,
                        lat: str = "latitude", lon: str = "longitude", answer: str = "answer") -> DataFrame:
    """Value at the latest date for each requested point, or the no-data answer, as text."""

    def keyed(df):
        return df.withColumns({"_y": rounded_key(F.col(lat), digits), "_x": rounded_key(F.col(lon), digits)})

    latest = keyed(series).groupBy("_y", "_x").agg(F.max(F.struct(date, value)).getField(value).alias("_value"))
    return keyed(requests).join(latest, ["_y", "_x"], "left").select(
        *requests.columns, F.coalesce(F.col("_value").cast("string"), F.lit(NO_DATA_ANSWER)).alias(answer))
