"""Mixing sources to target weights by systematic sampling: running expected copies, one random offset, one copy a whole number crossed.

The offset of a source is the one of OFFSETS equally spaced draws whose copies come nearest to the target: with few or very
uneven documents a single draw may miss it by the size of the longest one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid.llm.common import words_of
from airgrid.operators.ordering import attach, value_positions
from airgrid.session import settle

#: Weights of sources in code point order, again and again; share of all sizes that the mix has; most copies of a document.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Names the random offsets, of which so many are tried for each source.
SEED = "mix"
OFFSETS = 32
#: Rows of equal document, source and size that one task hands out at once.
CHUNK = 10_000
KEYS = ["source", "size", "doc_id"]


def _digest(*parts: Column | str) -> Column:
    return F.md5(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def _offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the source's name and the seed alone."""
    name = F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))
    return F.conv(F.substring(_digest(seed, name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target (double) of each row of `sources` (source, source_size; one row a source).

    Sources in code point order, NULL last, weigh `weights` in turn and share `share` times all sizes. A target stops at
    `most` times its source's size; what is left over is shared again by weight until no target is above. The level of
    that sharing is one number: each round is one aggregate over the sources, of which only sums reach the driver.
    """
    places = value_positions(sources, [], "source").select("source", F.col("values_before").alias("place"))
    has_null, = sources.agg(F.coalesce(F.bool_or(F.col("source").isNull()), F.lit(False))).first()
    # NULL sorts first there; a place of -1 or the last one stands in for it
    last, = places.agg(F.max("place")).first()
    place = F.when(F.col("source").isNull(), F.lit(last)).otherwise(F.col("place") - int(has_null))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    weighed = settle(attach(sources, places, ["source"]).select("source", "source_size", weight.cast("bigint").alias("weight")))
    most_of = F.col("source_size") * F.lit(float(most))
    level, before = 0.0, -1.0
    while level != before:
        full = F.col("weight") * F.lit(level) > most_of
        total, held, free = weighed.agg(F.sum("source_size"), F.sum(F.when(full, F.col("source_size")).otherwise(0)),
                                        F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        before, level = level, (share * total - most * held) / free if free else level
    return weighed.select("source", "source_size", F.least(F.col("weight") * F.lit(level), most_of).alias("target"))


def allocate(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """One row for each distinct (source, size, doc_id) of `rows`: how many rows it has (n), how many rows of the source lie
    before it (rows_before), source_size, target, rate (expected copies of each row) and start (the source's offset: of
    OFFSETS draws the one whose taken words are nearest to the target, told by one aggregation).

    Rows of a source lie in order of size, then of a digest of the id, so that copies lie even over sizes: what a source
    gives differs from its target by less than its longest document. No task orders a source: sizes are counted and
    summed within the source, 4 096 ranges of digests within a size, rows within such a range.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    groups = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    groups = settle(groups.withColumn("digest", _digest(name)).withColumn("range", F.substring("digest", 1, 3)))
    sizes = groups.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = settle(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    if sources.isEmpty():
        return groups.select(*KEYS, "n", F.lit(0).cast("bigint").alias("rows_before"), *[F.lit(0).cast(t).alias(c) for c, t in (
            ("source_size", "bigint"), ("target", "double"), ("rate", "double"), ("start", "double"))])
    by_size = Window.partitionBy("source").orderBy("size")
    of_size = sizes.select("source", "size", (F.sum("n").over(by_size) - F.col("n")).alias("smaller"))
    by_range = Window.partitionBy("source", "size").orderBy("range")
    ranges = groups.groupBy("source", "size", "range").agg(F.sum("n").alias("n"))
    ranges = ranges.select("source", "size", "range", (F.sum("n").over(by_range) - F.col("n")).alias("lower"))
    inside = Window.partitionBy("source", "size", "range").orderBy("digest", "doc_id")
    placed = groups.withColumn("_inside", F.sum("n").over(inside) - F.col("n"))
    placed = attach(placed, ranges, ["source", "size", "range"])
    placed = attach(placed, settle(of_size), ["source", "size"])
    placed = attach(placed, settle(targets(sources, weights, share, most)), ["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    placed = settle(placed.select(*KEYS, "n", (F.col("smaller") + F.col("lower") + F.col("_inside")).alias("rows_before"), "source_size", "target",
                                  rate.alias("rate"), _offset(F.col("source"), seed).alias("draw")))
    tried = []
    for k in range(OFFSETS):
        shifted = F.col("draw") + F.lit(k / OFFSETS)
        start = F.when(shifted >= 1, shifted - 1).otherwise(shifted)
        taken = F.sum(F.col("size") * _crossed(start, F.col("rows_before"), F.col("rows_before") + F.col("n")))
        tried.append(F.struct(F.abs(taken - F.first("target")).alias("off"), F.lit(k).alias("k"), F.first(start).alias("start")))
    starts = placed.groupBy("source").agg(F.array_min(F.array(*tried))["start"].alias("start"))
    return attach(placed.drop("draw"), settle(starts), ["source"])


def _crossed(start: Column, low: Column, high: Column) -> Column:
    """Whole numbers that the running sum crosses on the rows from place `low` up to `high`."""
    return (F.floor(start + high * F.col("rate")) - F.floor(start + low * F.col("rate"))).cast("bigint")


def _copies(place: Column) -> Column:
    return _crossed(F.col("start"), place, place + 1)


def _rows(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{source}`").alias("source"), F.size(words_of(F.col(f"`{text}`"))).cast("bigint").alias("size"), F.col(f"`{key}`").alias("doc_id"))


def shares(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS,
           share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, source, size (words), source_size, target, copies and taken (size * copies) of every row of `docs`.

    NULL or empty text has size 0 and its copies take nothing. NULL is a source of its own, as is the empty name. Rows
    equal in id, source and size cannot be told apart here: each gets its own place in the running sum. A source of size
    0 has target 0 and no copies. An empty table gives no rows; other columns are not read. The result depends on the
    rows alone, not on how they are dealt.
    """
    found = settle(allocate(_rows(docs, key, source, text), weights, share, most, seed))
    few = found.filter(F.col("n") <= CHUNK).withColumn("chunk", F.lit(0).cast("bigint"))
    many = found.filter(F.col("n") > CHUNK).withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n - 1) div {CHUNK})")))
    many = many.repartition(*KEYS, "chunk")
    each = few.unionByName(many).withColumn("row", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(n, (chunk + 1) * {CHUNK}) - 1)")))
    copies = _copies(F.col("rows_before") + F.col("row"))
    return each.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS,
          share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of `docs` as often as it has copies, all its columns.

    Copies are those of `shares`. Rows equal in id, source and size are told apart by the partition of `docs` they lie in
    and numbered within it, so none of them is ordered in one task.
    """
    found = settle(allocate(_rows(docs, key, source, text), weights, share, most, seed))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"), F.spark_partition_id().alias("part"),
                       F.monotonically_increasing_id().alias("at"))
    keyed = held.select("held", "part", "at", F.col(f"held.`{source}`").alias("source"), F.size(words_of(F.col(f"held.`{text}`"))).cast("bigint").alias("size"),
                        F.col(f"held.`{key}`").alias("doc_id"))
    parts = keyed.groupBy(*KEYS, "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*KEYS).orderBy("part")
    parts = parts.select(*KEYS, "part", (F.sum("n").over(before) - F.col("n")).alias("earlier"))
    numbered = keyed.withColumn("nth", F.row_number().over(Window.partitionBy(*KEYS, "part").orderBy("at")) - 1)
    placed = attach(attach(numbered, parts, [*KEYS, "part"]), found.drop("n"), KEYS)
    copies = _copies(F.col("rows_before") + F.col("earlier") + F.col("nth"))
    return placed.withColumn("copies", copies).filter("copies > 0").select("held", F.explode(F.sequence(F.lit(1), "copies"))).select("held.*")


def oracle() -> str:
    """DuckDB text for the query over `documents`."""
    weight = "[" + ", ".join(map(str, WEIGHTS)) + "]"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, {weight}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}]::BIGINT AS weight FROM d GROUP BY source),
levels AS (SELECT 0 AS step, 0.0::DOUBLE AS level, -1.0::DOUBLE AS before
  UNION ALL
  SELECT any_value(step) + 1, ({SHARE}::DOUBLE * sum(source_size) - {MOST} * sum(CASE WHEN weight * level > {MOST}.0::DOUBLE * source_size THEN source_size ELSE 0 END))::DOUBLE
         / sum(CASE WHEN weight * level > {MOST}.0::DOUBLE * source_size THEN 0 ELSE weight END), any_value(level)
  FROM levels, s WHERE level <> before HAVING count(*) > 0),
top AS (SELECT max_by(level, step) AS level FROM levels),
t AS (SELECT source, source_size, least(weight * level, source_size * {MOST}.0::DOUBLE) AS target,
             ('0x' || substr(md5('{SEED}' || coalesce('=' || source, '')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS draw FROM s, top),
p AS (SELECT doc_id, d.source, size, source_size, target, draw, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
             row_number() OVER (PARTITION BY d.source ORDER BY size, md5(coalesce(doc_id::VARCHAR, '-')), doc_id NULLS FIRST) - 1 AS i
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT source, target, k, CASE WHEN draw + k / {OFFSETS}.0::DOUBLE >= 1 THEN draw + k / {OFFSETS}.0::DOUBLE - 1 ELSE draw + k / {OFFSETS}.0::DOUBLE END AS start
      FROM t, (SELECT unnest(range({OFFSETS})) AS k)),
c AS (SELECT k.source, k.k, k.start, abs(sum(size * (floor(start + (i + 1) * rate) - floor(start + i * rate))::BIGINT) - any_value(k.target)) AS off
      FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source GROUP BY k.source, k.k, k.start),
b AS (SELECT source, arg_min(start, (off, k)) AS start FROM c GROUP BY source),
o AS (SELECT p.*, b.start FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (size * (floor(start + (i + 1) * rate) - floor(start + i * rate)))::BIGINT AS taken FROM o"""
