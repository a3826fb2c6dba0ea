"""Ranks and positions without sorting a whole key, or the whole table, in one task.

Rows are first counted per distinct value, which shrinks a hot value before the shuffle. The
distinct values of a key are then ordered inside *bands*: coarse, order-preserving groups such as
months. A running count over the bands of a key places each band, so the sort of a hot key is
spread over its bands.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from airgrid.session import settle

_BAND = "_band"
_PLACE = "_place"


def attach(df: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Add the other columns of `table` to the rows with the same `on` values; NULL equals NULL."""
    hidden = {k: f"_on_{k}" for k in on}
    other = table.withColumnsRenamed(hidden)
    condition = reduce(and_, [F.col(k).eqNullSafe(F.col(h)) for k, h in hidden.items()])
    return df.join(other, condition, how).drop(*hidden.values())


def with_band(df: DataFrame, order: str, band: Column | None = None) -> DataFrame:
    """Add an order-preserving coarse group of `order`; no job runs for it before the query does.

    Without a given `band`: months for dates and times, octaves of a number's size, of which large ones are parted into
    steps, and shares of a sample of texts. What bands need to know of all rows is a subquery of one row; they spread
    the work and change no result.
    """
    if band is None:
        kind = df.schema[order].dataType
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            band = F.date_trunc("month", F.col(order))
        elif isinstance(kind, T.StringType):
            return _with_text_band(df, F.col(order))
        elif isinstance(kind, T.NumericType):
            band = _number_band(df, F.col(order).cast("double"))
        else:
            band = F.lit(0)
    return df.withColumn(_BAND, band)


def _bands(df: DataFrame) -> int:
    """Groups that a table is parted into, about: a few for each shuffle partition."""
    return max(64, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _number_band(df: DataFrame, v: Column) -> Column:
    """Quarter octaves of the size, by sign, as a double's leading bits order it; large ones in even steps between their ends."""
    infinite = F.abs(v) == float("inf")
    octave = F.when(v.isNull(), -20_000).when(F.isnan(v), 20_000).when(v == 0, 0).when(infinite, F.signum(v) * 10_000).otherwise(
        F.signum(v) * (F.floor(F.log2(F.when(infinite, 1.0).otherwise(F.abs(v))) * 4) + 5_000)).cast("int")
    sizes = df.groupBy(octave.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).where("abs(b) < 10000")
    known = sizes.agg(F.sum("n").alias("total"), F.min("b").alias("first"), F.max("b").alias("last"),
                      F.map_from_entries(F.collect_list(F.struct("b", F.struct("n", "lo", "hi")))).alias("of"))
    # one entry for each octave between the first and the last, so that a row's is found by its number
    steps = F.expr(f"""transform(sequence(first, last), k -> struct(of[k].lo AS lo, of[k].hi AS hi,
                                                                    cast(ceil(of[k].n * {_bands(df)} / total) AS int) AS steps))""")
    table = known.select(F.when(F.col("first").isNotNull(), F.struct("first", steps.alias("steps"))).alias("table")).scalar()
    place = F.when(F.abs(octave) < 10_000, F.get(table["steps"], octave - table["first"]))
    step = F.floor((v - place["lo"]) / F.nullif(place["hi"] - place["lo"], F.lit(0.0)) * place["steps"])
    return F.struct(octave.alias("octave"), F.least(F.coalesce(step, F.lit(0)).cast("int"), F.coalesce(place["steps"], F.lit(1)) - 1).alias("step"))


def _with_text_band(df: DataFrame, t: Column) -> DataFrame:
    """Add the number of cuts at or before a text; cuts part a bounded sample of the distinct texts, picked by hash, into equal shares."""
    bands = _bands(df)
    # a share of the distinct texts, all of them where they are few: many rows may hold few texts, or none
    n = df.agg(F.greatest(F.approx_count_distinct(t), F.lit(1)).alias("n")).scalar()
    sample = df.where(F.pmod(F.xxhash64(t), n) < 16 * bands).agg(F.sort_array(F.collect_set(t)).alias("texts"))
    cuts = sample.select(F.expr(f"array_distinct(transform(sequence(1, {bands - 1}), i -> get(texts, cast(floor(i * size(texts) / {bands}) AS int))))").alias("cuts"))
    kept = F.coalesce(F.filter("cuts", lambda c: c.isNotNull()), F.array().cast("array<string>"))
    # every step-th cut apart, so that a row is compared with twice the root of their number
    step = int(bands ** 0.5)
    table = cuts.select(kept.alias("cuts")).select(F.struct("cuts", F.filter("cuts", lambda c, i: i % step == step - 1).alias("coarse")).alias("table")).scalar()
    # a subquery may not stand inside a function over arrays
    out = df.withColumn("_cuts", table)
    low = F.size(F.filter("_cuts.coarse", lambda c: c <= t)) * step
    out = out.withColumn("_low", F.when(t.isNull(), -1).otherwise(low))
    inside = F.size(F.filter(F.slice("_cuts.cuts", F.col("_low") + 1, step), lambda c: c <= t))
    return out.withColumn(_BAND, F.when(t.isNull(), -1).otherwise(F.col("_low") + inside)).drop("_cuts", "_low")


def _place(keys: list[str]) -> Column:
    """Key and band as one value that is never NULL, so that a join on it keeps the partitioning."""
    return F.struct(*keys, _BAND)


def value_positions(df: DataFrame, keys: list[str], order: str, band: Column | None = None) -> DataFrame:
    """One row per key and distinct `order` value.

    `n` rows have the value; `rows_before` rows and `values_before` distinct values of the key
    sort before it; `rows_total` rows are in the key. NULL is a value and sorts first.
    """
    placed_rows = with_band(df, order, band).withColumn(_PLACE, _place(keys))
    counted = placed_rows.groupBy(_PLACE, order).agg(F.count(F.lit(1)).alias("n"))
    per_band = counted.groupBy(_PLACE).agg(F.sum("n").alias("_rows"), F.count(F.lit(1)).alias("_values")) \
        .withColumn(_BAND, F.col(f"{_PLACE}.{_BAND}"))
    whole = Window.partitionBy(*[f"{_PLACE}.{k}" for k in keys])
    earlier = whole.orderBy(_BAND).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_band.select(
        _PLACE,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_offset"),
        F.coalesce(F.sum("_values").over(earlier), F.lit(0)).alias("_values_offset"),
        F.sum("_rows").over(whole).alias("rows_total"),
    )
    inside = Window.partitionBy(_PLACE).orderBy(order)
    placed = counted.select(
        _PLACE, order, "n",
        (F.sum("n").over(inside) - F.col("n")).alias("_rows_inside"),
        (F.row_number().over(inside) - 1).alias("_values_inside"),
    )
    return placed.join(offsets, _PLACE).select(
        *[f"{_PLACE}.{k}" for k in keys], order, "n",
        (F.col("_rows_offset") + F.col("_rows_inside")).alias("rows_before"),
        (F.col("_values_offset") + F.col("_values_inside")).alias("values_before"),
        "rows_total",
    )


def value_ranks(df: DataFrame, order: str, partners: list[str]) -> DataFrame:
    """One row per distinct `order` value with its mean rank among the rows that have each partner, as `_rank<order><partner>`.

    Placed as in `value_positions`; values that no row with a partner has get a rank too, which nothing asks for.
    """
    names = [f"_n{i}" for i in range(len(partners))]
    counted = with_band(df, order).groupBy(_BAND, order).agg(*[F.count(p).alias(n) for p, n in zip(partners, names)])
    earlier = Window.orderBy(_BAND).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.groupBy(_BAND).agg(*[F.sum(n).alias(n) for n in names]).select(
        F.struct(_BAND).alias(_PLACE), *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_offset") for n in names])
    inside = Window.partitionBy(_PLACE).orderBy(order)
    placed = counted.withColumn(_PLACE, F.struct(_BAND)).select(_PLACE, order, *names, *[F.sum(n).over(inside).alias(f"{n}_upto") for n in names])
    return placed.join(offsets, _PLACE).select(order, *[
        (F.col(f"{n}_offset") + F.col(f"{n}_upto") - (F.col(n) - 1) / 2).alias(f"_rank{order}{p}") for n, p in zip(names, partners)])


def percent_rank(df: DataFrame, order: str, alias: str = "rank", keys: list[str] | None = None,
                 settled: bool | None = None) -> DataFrame:
    """Share of the other rows (of the key) that sort before each row.

    The ranks of dates are few and are settled by default before they are joined back.
    """
    keys = keys or []
    settled = isinstance(df.schema[order].dataType, T.DateType) if settled is None else settled
    share = F.when(F.col("rows_total") > 1, F.col("rows_before") / (F.col("rows_total") - 1)).otherwise(0.0)
    ranks = value_positions(df, keys, order).select(*keys, order, share.alias(alias))
    return attach(df, settle(ranks) if settled else ranks, [*keys, order])


def dense_rank(df: DataFrame, keys: list[str], order: str, alias: str = "rank",
               band: Column | None = None) -> DataFrame:
    """Dense rank within the key, for keys too large for one sort."""
    place = (F.col("values_before") + 1).cast("int").alias(alias)
    return attach(df, value_positions(df, keys, order, band).select(*keys, order, place), [*keys, order])


def exact_percentiles(df: DataFrame, keys: list[str], column: str, shares: dict[str, float],
                      interpolate: bool = True, band: Column | None = None) -> DataFrame:
    """Percentiles per key; linear between neighbours, or the first value reaching the share."""
    valued = df.where(F.col(column).isNotNull())
    placed = value_positions(valued, keys, column, band)
    first, last = F.col("rows_before"), F.col("rows_before") + F.col("n") - 1

    def at(index):
        return F.max(F.when((first <= index) & (index <= last), F.col(column)))

    columns = []
    for alias, share in shares.items():
        if interpolate:
            place = F.lit(float(share)) * (F.col("rows_total") - 1)
            low, high = at(F.floor(place)), at(F.ceil(place))
            rest = F.max(place - F.floor(place))
            between = low + (high - low) * rest
            columns.append(F.when(low == high, low).otherwise(between).alias(alias))
        else:
            place = F.greatest(F.ceil(F.lit(float(share)) * F.col("rows_total")) - 1, F.lit(0))
            columns.append(at(place).alias(alias))
    return placed.groupBy(*keys).agg(*columns)


def row_positions(df: DataFrame, keys: list[str], order: str, alias: str = "position",
                  band: Column | None = None) -> DataFrame:
    """0-based place of each row in its key; `order` must be unique within the key."""
    banded = with_band(df, order, band).withColumn(_PLACE, _place(keys))
    per_band = banded.groupBy(_PLACE).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*[f"{_PLACE}.{k}" for k in keys]).orderBy(f"{_PLACE}.{_BAND}") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_band.select(_PLACE, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(_PLACE).orderBy(order)
    placed = banded.withColumn("_inside", F.row_number().over(inside) - 1)
    return placed.join(offsets, _PLACE).select(
        *df.columns, (F.col("_offset") + F.col("_inside")).alias(alias))
