"""Aggregates over keys, all with partial sums before the shuffle."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from airgrid.functions.geo import coordinate_key
from airgrid.operators.ordering import attach, exact_percentiles, value_positions, value_ranks
from airgrid.session import settle


def numeric_columns(df: DataFrame, without=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in without]


def mean_by(df: DataFrame, keys: list[str], columns: list[str] | None = None, skip_nan: bool = False) -> DataFrame:
    """Mean of every numeric column per key, under its own name."""

    def value(c):
        wide = F.col(c).cast("double")
        return F.nanvl(wide, F.lit(None).cast("double")) if skip_nan else wide

    return df.groupBy(*keys).agg(*[F.avg(value(c)).alias(c) for c in columns or numeric_columns(df, keys)])


def max_by_key(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns or numeric_columns(df, keys)])


def band_min_max_mean(df: DataFrame, keys: list[str], bands: list[str], where=None) -> DataFrame:
    """min_, max_ and mean_ of each band per key; `where` filters rows first."""
    kept = df if where is None else df.where(where)
    return kept.groupBy(*keys).agg(*[
        f(c).alias(f"{name}_{c}") for c in bands for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


def band_min_max_median(df: DataFrame, keys: list[str], bands: list[str], where=None, exact: bool = False) -> DataFrame:
    """min_, max_ and median_ of each band per key; the median is a value of the group.

    The default median comes from mergeable sketches. `exact` ranks the values instead, one band
    after the other, without holding a group.
    """
    kept = df if where is None else df.where(where)
    columns = []
    for c in bands:
        columns += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
        if not exact:
            columns.append(F.percentile_approx(c, 0.5).alias(f"median_{c}"))
    out = kept.groupBy(*keys).agg(*columns)
    if exact:
        for c in bands:
            middle = exact_percentiles(kept, keys, c, {f"median_{c}": 0.5}, interpolate=False)
            out = attach(out, middle, keys)
    order = [*keys, *[f"{s}_{c}" for c in bands for s in ("min", "max", "median")]]
    return out.select(order)


def coordinate_lists(df: DataFrame, keys: list[str], lon: str = "lon", lat: str = "lat", alias: str = "lon_lat_list",
                     chunk: int = 10_000) -> DataFrame:
    """Coordinate texts of each key as sorted lists, repeats included.

    A list holds at most `chunk` texts; the rest of a longer one follows in the next `part`, so a
    key of any size stays whole without any array growing with it. Keys are counted when the query is built: those of one
    list are sorted where their rows meet, only longer ones are placed by bands.
    """
    texts = df.select(*keys, coordinate_key(lon, lat).alias("_pair"))
    if not keys:
        return _long_lists(texts, keys, alias, chunk)
    long = settle(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > chunk).drop("_rows"))
    none = long.isEmpty()
    short = texts if none else attach(texts, long, keys, "left_anti")
    # a NULL text is an entry too, so entries are structs
    entries = F.sort_array(F.collect_list(F.struct("_pair")))
    lists = short.repartition(*keys).groupBy(*keys).agg(entries.alias("_entries")) \
        .select(*keys, F.lit(0).alias("part"), F.col("_entries._pair").alias(alias))
    return lists if none else lists.unionByName(_long_lists(attach(texts, long, keys, "left_semi"), keys, alias, chunk))


def _long_lists(texts: DataFrame, keys: list[str], alias: str, chunk: int) -> DataFrame:
    """`coordinate_lists` of keys of any size."""
    placed = value_positions(texts, keys, "_pair")
    start, end = F.col("rows_before"), F.col("rows_before") + F.col("n")
    parts = placed.select(*keys, "_pair", start.alias("_start"), end.alias("_end"), F.explode(F.sequence(
        F.floor(start / chunk), F.floor((end - 1) / chunk))).alias("part"))
    repeats = F.least(F.col("_end"), (F.col("part") + 1) * chunk) - F.greatest(F.col("_start"), F.col("part") * chunk)
    entries = F.array_sort(F.collect_list(F.struct("_pair", repeats.cast("int").alias("n"))))
    return parts.groupBy(*keys, F.col("part").cast("int").alias("part")).agg(
        F.flatten(F.transform(entries, lambda e: F.array_repeat(e["_pair"], e["n"]))).alias(alias))


def station_days(df: DataFrame, keys: list[str], time: str = "datetime_utc", value: str = "value",
                 date: str = "date_utc") -> DataFrame:
    """Daily mean and last time per station; rows with an unknown key are left out."""
    return df.na.drop(subset=[*keys, time]).groupBy(F.to_date(time).alias(date), *keys).agg(
        F.max(time).alias(time), F.avg(value).alias(value))


def climatology(df: DataFrame, key: str, date: str, columns: list[str]) -> DataFrame:
    """Means per key and weekday, week, month or year: one pass with grouping sets."""
    parts = {"day_of_week": F.dayofweek(date), "week_of_year": F.weekofyear(date),
             "month": F.month(date), "year": F.year(date)}
    parted = df.select(key, *[F.col(c) for c in columns], *[v.alias(k) for k, v in parts.items()])
    sets = [[F.col(key), F.col(p)] for p in parts]
    level = F.coalesce(*[F.when(F.grouping(p) == 0, p) for p in parts]).alias("calendar")
    return parted.groupingSets(sets, key, *parts).agg(level, *[F.avg(c).alias(c) for c in columns]) \
        .select(key, "calendar", F.coalesce(*parts).alias("part"), *columns)


def extremes(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def counts(df: DataFrame, *columns: str) -> DataFrame:
    """Row count and distinct count of each column."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def collapse_texts(df: DataFrame, label: str) -> DataFrame:
    """Group by every text column and the label, averaging the other numbers."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return mean_by(df, [*text, label])


def collapse_predictions(df: DataFrame, keys: list[str], prediction: str = "pred", exact: bool = False) -> DataFrame:
    """Mean, min, max and median of the cell predictions of a key."""
    out = df.groupBy(*keys).agg(
        F.avg(prediction).alias("pred_mean"), F.min(prediction).alias("pred_min"), F.max(prediction).alias("pred_max"),
        *([] if exact else [F.percentile_approx(prediction, 0.5).alias("pred_median")]))
    if exact:
        middle = exact_percentiles(df, keys, prediction, {"pred_median": 0.5}, interpolate=False)
        out = attach(out, middle, keys)
    return out


def expand_predictions(df: DataFrame, keys: list[str], order: list[str], prediction: str = "pred",
                       width: int = 20, fill: float = 0.0) -> DataFrame:
    """The first `width` predictions of a key, in `order`, as columns pred1.., missing filled.

    Only the first `width` rows of a key leave each input partition.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    first = df.select(*keys, *order, prediction).withColumn("_place", F.row_number().over(window)) \
        .where(F.col("_place") <= width)
    return first.groupBy(*keys).agg(*[
        F.coalesce(F.max(F.when(F.col("_place") == i, F.col(prediction))), F.lit(fill)).alias(f"pred{i}")
        for i in range(1, width + 1)])


def correlations(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """Correlation of each pair of columns as (var1, var2, r), over the rows where both have a value.

    Spearman's is that of mean ranks. A column's values are placed once, with the rows that have each partner counted apart.
    """
    pairs = list(combinations(columns, 2))
    if method == "pearson":
        one = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
        entries = [F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"r{i}").alias("r"))
                   for i, (a, b) in enumerate(pairs)]
        return one.select(F.inline(F.array(*entries)))
    if method != "spearman":
        raise ValueError(f"unknown method {method}")
    # NaN counts as missing
    rows = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"_v{i}") for i, c in enumerate(columns)])
    values, ranked = rows.columns, rows
    for c in values:
        # ranks among the rows where c and the partner have a value, of each partner
        places = value_ranks(rows.where(F.col(c).isNotNull()), c, [p for p in values if p != c])
        ranked = attach(ranked, places, [c])
    both = list(combinations(values, 2))
    one = ranked.agg(*[F.corr(*[F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(r)) for r in (f"_rank{a}{b}", f"_rank{b}{a}")]).alias(f"r{i}")
                       for i, (a, b) in enumerate(both)])
    entries = [F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.inline(F.array(*entries)))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, standard deviation, min and max per column, one row each."""
    measures = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "low": F.min, "high": F.max}
    one = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}|{m}") for c in columns for m, f in measures.items()])
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{m}`").cast("double").alias(m) for m in measures])
            for c in columns]
    return one.select(F.inline(F.array(*rows)))


def class_hit_rate(df: DataFrame, actual_class: str = "actual_aqi", hit: str = "aqi_hit") -> DataFrame:
    return df.groupBy(actual_class).agg(
        F.sum(hit).alias("aqi_hit"), F.count(F.lit(1)).alias("count"),
        (F.sum(hit) / F.count(F.lit(1))).alias("percentage"))


def mean_error(df: DataFrame, prediction: str = "prediction", actual: str = "actual") -> DataFrame:
    """Mean prediction, mean actual and their absolute difference, with the true rmse."""
    return df.agg(
        F.avg(prediction).alias("prediction"), F.avg(actual).alias("actual"),
        F.abs(F.avg(prediction) - F.avg(actual)).alias("abs_mean_error"),
        F.sqrt(F.avg(F.pow(F.col(prediction) - F.col(actual), F.lit(2)))).alias("rmse"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)
