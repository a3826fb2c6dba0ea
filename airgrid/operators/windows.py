"""Ranks, lags, trailing windows and calendar means over series."""

from __future__ import annotations

import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from airgrid.operators.ordering import attach, dense_rank, row_positions
from airgrid.session import settle

_DAY = 86400
#: Trailing days up to which dates are windowed with their rows, and days of a chunk of them.
SHORT_DAYS = 3
_CHUNK_DAYS = 32


def nearest_rank(df: DataFrame, keys: list[str], distance: str, k: int | None = None,
                 alias: str = "distance_rank") -> DataFrame:
    """Dense rank by distance within the key; with `k` only the k nearest distances stay.

    With `k` Spark trims every input partition to its k nearest before the shuffle, so a hot key
    arrives small. Without it the ranks are counted band by band.
    """
    if k is None:
        return dense_rank(df, keys, distance, alias)
    window = Window.partitionBy(*keys).orderBy(distance)
    return df.withColumn(alias, F.dense_rank().over(window)).where(F.col(alias) <= k)


def keep_nearest(df: DataFrame, k: int, alias: str = "distance_rank", keep_missing: bool = False) -> DataFrame:
    """Rows up to rank k; `keep_missing` also keeps rows without a rank."""
    near = F.col(alias) <= k
    return df.where(near | F.col(alias).isNull() if keep_missing else near)


def lag_rows(df: DataFrame, keys: list[str], order: str, columns: dict[str, tuple[str, int]],
             one_per_day: bool = False, chunk: int = 4096) -> DataFrame:
    """Add `alias: (column, k)` lags of k rows within the key; `order` must be unique there.

    A daily series is bounded by the calendar, so `one_per_day` sorts each key in one window.
    Otherwise each key is cut into chunks of consecutive rows that carry the rows just before them.
    """
    deepest = max(k for _, k in columns.values())
    if one_per_day:
        window = Window.partitionBy(*keys).orderBy(order)
        return df.select("*", *[F.lag(c, k).over(window).alias(a) for a, (c, k) in columns.items()])
    chunk = max(chunk, deepest)
    placed = row_positions(df, keys, order, "_pos")
    home = F.floor(F.col("_pos") / chunk)
    reach = F.floor((F.col("_pos") + deepest) / chunk)
    copies = placed.withColumn("_home", home).withColumn("_chunk", F.explode(F.sequence(home, reach)))
    window = Window.partitionBy(*keys, "_chunk").orderBy("_pos")
    lagged = copies.select("*", *[F.lag(c, k).over(window).alias(a) for a, (c, k) in columns.items()])
    return lagged.where(F.col("_chunk") == F.col("_home")).drop("_pos", "_home", "_chunk")


def lag_days(df: DataFrame, keys: list[str], date: str, column: str, days: dict[str, int]) -> DataFrame:
    """Value exactly k days earlier (NULL when that day is missing); one row per key and day.

    All lags share one shuffle and sort; a key has at most a row per day of the calendar.
    """
    by_day = Window.partitionBy(*keys).orderBy(F.unix_date(date))
    return df.select("*", *[F.first(column).over(by_day.rangeBetween(-k, -k)).alias(alias) for alias, k in days.items()])


def difference(df: DataFrame, keys: list[str], order: str, column: str, interval: int = 1,
               alias: str = "difference", one_per_day: bool = False) -> DataFrame:
    """Value minus the value `interval` rows earlier; the first rows of a series fall away."""
    lagged = lag_rows(df, keys, order, {"_earlier": (column, interval), "_seen": (order, interval)}, one_per_day)
    return lagged.where(F.col("_seen").isNotNull()) \
        .withColumn(alias, F.col(column) - F.col("_earlier")).drop("_earlier", "_seen")


def day_difference_lags(df: DataFrame, keys: list[str], date: str, column: str = "value",
                        lags: tuple[int, ...] = (1, 7, 30), one_per_day: bool = True) -> DataFrame:
    """Row lags of a value, the previous value minus it, and the same lags of that difference."""
    names = {f"{column}_lag{k}day": (column, k) for k in lags}
    if 1 not in lags:
        names["_lag1"] = (column, 1)
    lagged = lag_rows(df, keys, date, names, one_per_day)
    flagged = lagged.withColumn("difflag", F.col(f"{column}_lag1day" if 1 in lags else "_lag1") - F.col(column))
    return lag_rows(flagged.drop("_lag1"), keys, date, {f"difflag_lag{k}day": ("difflag", k) for k in lags}, one_per_day)


def trailing_means(df: DataFrame, keys: list[str], time: str, columns: list[str], days: list[int],
                   name=lambda column, d: f"trailing{d}d_{column}", label_columns: tuple[str, ...] = (),
                   settled: bool = False) -> DataFrame:
    """Means over the last d days up to and including the row's time, in whole seconds.

    Columns in `label_columns` leave out the row's own second, so that a label cannot leak into
    its own feature. Rows of equal time are summed first and the means are joined back, so no
    task meets all rows of a key. Dates have at most one sum a day and are windowed directly;
    times of day may be dense and take the running sums of `_time_sums`. Dates of short spans
    (`SHORT_DAYS`) are windowed with their rows instead, in chunks of days, and shuffled once.
    """
    if isinstance(df.schema[time].dataType, T.DateType) and max(days) <= SHORT_DAYS and not settled:
        return _short_means(df, keys, time, columns, days, name, label_columns)
    clock = F.unix_seconds(F.col(time).cast("timestamp"))
    sums = df.where(F.col(time).isNotNull()).groupBy(*keys, clock.alias("_t")).agg(
        *[F.sum(F.col(c).cast("double")).alias(f"_s_{c}") for c in columns],
        *[F.count(c).alias(f"_n_{c}") for c in columns],
    )
    split = _date_sums if isinstance(df.schema[time].dataType, T.DateType) else _time_sums
    measures = [(f"_{m}_{c}", c in label_columns) for c in columns for m in ("s", "n")]
    table = split(sums, keys, measures, days).select(*keys, "_t", *[
        (F.col(f"_s_{c}_{d}") / F.nullif(F.col(f"_n_{c}_{d}"), F.lit(0))).alias(name(c, d))
        for d in days for c in columns])
    if settled:
        table = settle(table)
    return attach(df.withColumn("_t", clock), table, [*keys, "_t"]).drop("_t")


def _short_means(df: DataFrame, keys: list[str], date: str, columns: list[str], days: list[int], name, label_columns: tuple[str, ...]) -> DataFrame:
    """`trailing_means` over few days of dates: chunks of days carry the rows of the days just before them."""
    deepest = max(days)
    day = F.unix_date(F.col(date))
    placed = df.withColumn("_t", day).withColumn("_home", F.floor(day / _CHUNK_DAYS))
    copies = placed.withColumn("_chunk", F.explode(F.when(F.col("_t").isNull(), F.array(F.lit(None).cast("long"))).otherwise(
        F.sequence(F.col("_home"), F.floor((F.col("_t") + deepest) / _CHUNK_DAYS)))))
    window = Window.partitionBy(*keys, "_chunk").orderBy("_t")

    def mean(c: str, d: int) -> Column:
        frame = window.rangeBetween(-d, -1 if c in label_columns else 0)
        return F.when(F.col("_t").isNotNull(), F.avg(F.col(c).cast("double")).over(frame)).alias(name(c, d))

    out = copies.select("*", *[mean(c, d) for d in days for c in columns])
    return out.where(F.col("_chunk").eqNullSafe(F.col("_home"))).drop("_t", "_home", "_chunk")


def _date_sums(sums: DataFrame, keys: list[str], measures: list[tuple[str, bool]], days: list[int]) -> DataFrame:
    """Sums over trailing days of a daily series, as `<measure>_<d>`."""

    def window(d, own_left_out):
        return Window.partitionBy(*keys).orderBy("_t").rangeBetween(-d * _DAY, -1 if own_left_out else 0)

    return sums.select(*keys, "_t", *[
        F.sum(m).over(window(d, label)).alias(f"{m}_{d}") for m, label in measures for d in days])


def _time_sums(sums: DataFrame, keys: list[str], measures: list[tuple[str, bool]], days: list[int]) -> DataFrame:
    """The same for any times, as the tail of the first day, whole days, and the head of the last.

    Heads and tails run inside one (key, day); whole days are windows over one row a day.
    """
    names = [m for m, _ in measures]
    dated = sums.withColumn("_day", F.floor(F.col("_t") / _DAY))
    inside = Window.partitionBy(*keys, "_day")

    def until(own_left_out):
        return inside.orderBy("_t").rangeBetween(Window.unboundedPreceding, -1 if own_left_out else 0)

    heads = dated.select(*keys, "_t", "_day", *[F.sum(m).over(until(label)).alias(f"_head{m}") for m, label in measures])

    daily = dated.groupBy(*keys, "_day").agg(*[F.sum(m).alias(m) for m in names])
    whole = Window.partitionBy(*keys).orderBy("_day")
    middles = daily.select(*keys, "_day", *[
        F.sum(m).over(whole.rangeBetween(1 - d, -1)).alias(f"_mid{m}_{d}") for m in names for d in days if d > 1])

    # ask each day d days earlier for its sum from this time of day on
    asked = dated.select(*keys, "_t", F.explode(F.array(*[F.lit(d) for d in days])).alias("_d"))
    probes = asked.select(*keys, (F.col("_t") - F.col("_d") * _DAY).alias("_t"), "_d") \
        .withColumn("_day", F.floor(F.col("_t") / _DAY))
    since = inside.orderBy(F.col("_t").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    answered = dated.unionByName(probes, allowMissingColumns=True).select(
        *keys, "_t", "_d", *[F.sum(m).over(since).alias(m) for m in names])
    tails = answered.where(F.col("_d").isNotNull()).groupBy(*keys, (F.col("_t") + F.col("_d") * _DAY).alias("_t")).agg(
        *[F.max(F.when(F.col("_d") == d, F.col(m))).alias(f"_tail{m}_{d}") for m in names for d in days])

    joined = attach(attach(heads, middles, [*keys, "_day"]), tails, [*keys, "_t"])

    def total(m, d):
        parts = [F.col(f"_head{m}"), F.col(f"_tail{m}_{d}"), *([F.col(f"_mid{m}_{d}")] if d > 1 else [])]
        return sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0)))

    return joined.select(*keys, "_t", *[total(m, d).alias(f"{m}_{d}") for m in names for d in days])


# alias of a calendar mean -> calendar expression
CALENDAR = {
    "weekday": F.dayofweek,
    "daily": F.dayofyear,
    "weekly": F.weekofyear,
    "monthly": F.month,
    "yearly": F.year,
}


def calendar_means(df: DataFrame, key: str, date: str, columns: list[str], settled: bool = True) -> DataFrame:
    """Add each column's mean over the same weekday, day, week, month and year of its key.

    One pass sums all five calendars; their means meet per key and date, and that table, one row
    per day of a key, is joined back once, so no key is sorted or held by one task.
    """
    parts = {name: part(F.col(date)) for name, part in CALENDAR.items()}
    parted = df.select(key, *columns, *[p.alias(f"_{n}") for n, p in parts.items()])
    levels = F.explode(F.array(*[
        F.struct(F.lit(n).alias("level"), F.col(f"_{n}").alias("part")) for n in parts]))
    daily = parted.groupBy(key, *[f"_{n}" for n in parts]).agg(
        *[F.sum(F.col(c).cast("double")).alias(f"_s_{c}") for c in columns],
        *[F.count(c).alias(f"_n_{c}") for c in columns])
    sums = daily.select("*", levels.alias("_level")).groupBy(
        key, F.col("_level.level").alias("_calendar"), F.col("_level.part").alias("_part")).agg(
        *[(F.sum(f"_s_{c}") / F.nullif(F.sum(f"_n_{c}"), F.lit(0))).alias(c) for c in columns])
    if settled:
        sums = settle(sums)
    days = df.select(key, date).distinct()
    for name, part in parts.items():
        means = sums.where(F.col("_calendar") == name).select(
            key, "_part", *[F.col(c).alias(f"avg_{name}_{c}") for c in columns])
        days = attach(days.withColumn("_part", part), means, [key, "_part"]).drop("_part")
    return attach(df, settle(days) if settled else days, [key, date])


def autocorrelation(df: DataFrame, keys: list[str], order: str, column: str, lags: int,
                    one_per_day: bool = False, batch: int = 2048) -> DataFrame:
    """Autocorrelation of each series at lags 0..`lags`; `order` must be unique within a series.

    Series are cut into chunks of `batch` consecutive values. A chunk meets the chunks that the longest lag reaches, in one
    shuffle for all lags, and each pair of chunks adds to its lags by one correlation of two arrays; a long series is
    spread over its chunks and no lagged column is made.
    """
    known = df.where(F.col(column).isNotNull())
    stats = known.groupBy(*keys).agg(F.avg(column).alias("_mean"), F.count(column).alias("_n"))
    centred = attach(known.select(*keys, order, column), stats, keys).select(*keys, order, (F.col(column) - F.col("_mean")).cast("double").alias("_d"))
    if one_per_day:
        placed = centred.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    else:
        placed = row_positions(centred, keys, order, "_pos")
    home = F.floor(F.col("_pos") / batch).cast("long")
    chunks = placed.groupBy(*keys, home.alias("_chunk")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_d"))), lambda x: x["_d"]).alias("_values"))
    # the chunk itself and those before it whose lags it may hold
    back = F.sequence(F.greatest(F.col("_chunk") - (lags + batch - 1) // batch, F.lit(0)), F.col("_chunk"))
    met = chunks.withColumn("_home", F.explode(back)).withColumn("_ahead", F.col("_chunk") - F.col("_home"))
    kinds = {f.name: f.dataType for f in met.select(*keys).schema.fields}

    def products(key: tuple, table: pa.Table) -> pa.Table:
        values = dict(zip(table.column("_ahead").to_pylist(), table.column("_values").to_pylist()))
        total = np.zeros(lags + 1)
        own = np.array(values[0])
        for ahead, other in values.items():
            # entry k of the full correlation is lag k - (len(own) - 1) within the pair
            sums = np.correlate(np.array(other), own, "full")
            lag = ahead * batch + np.arange(len(sums)) - (len(own) - 1)
            fits = (lag >= 0) & (lag <= lags)
            total[lag[fits]] += sums[fits]
        arrays = [pa.array([k.as_py()], k.type) for k in key[:-1]]
        return pa.Table.from_arrays([*arrays, pa.array([total.tolist()])], names=[*kinds, "_sums"])

    schema = ", ".join(f"`{n}` {k.simpleString()}" for n, k in kinds.items())
    parts = met.select(*keys, "_home", "_ahead", "_values").groupBy(*keys, "_home").applyInArrow(products, f"{schema}, _sums array<double>")
    summed = parts.select(*keys, F.posexplode("_sums").alias("lag", "_p")).groupBy(*keys, "lag").agg(F.sum("_p").alias("_p"))
    whole = summed.where("lag = 0").select(*keys, F.col("_p").alias("_all"))
    out = attach(attach(summed, stats, keys), whole, keys)
    # a lag as long as the series has no pairs
    return out.where(F.col("lag") < F.col("_n")).select(*keys, "lag", F.when(F.col("_all") > 0, F.col("_p") / F.col("_all")).alias("acf"))


def last_days(df: DataFrame, date: str, n: int, as_of: datetime.date | str | None = None,
              where=None) -> DataFrame:
    """Rows of the last n days up to the reference date, newest first."""
    today = F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")
    kept = df if where is None else df.where(where)
    return kept.where(F.col(date) >= F.date_sub(today, n)).orderBy(F.col(date).desc())
