"""SimHash near-duplicates: fingerprints compared as vertical bit planes with carry-save counters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import arrow_map, reach, row_hash, without_rows, written
from airgrid.llm.components import components

SHINGLE = 3
MOST_BITS = 3
SEED = 42
#: Fingerprints that one comparison holds at most twice of; a larger bucket is split into blocks that meet in pairs.
BLOCK = 4_096
#: Words of 64 lanes that one pass compares, and planes between two looks for lanes still within the radius.
LANE_WORDS = 1 << 16
PLANES_A_LOOK = 8
SHINGLES_A_STEP = 1 << 20


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of lower-cased (A-Z) word shingles, repeats included; zero without a word."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, SHINGLES_A_STEP):
        part = words[a:min(a + SHINGLES_A_STEP, n) + size - 1]
        grams = map(b" ".join, zip(*[part[k:] for k in range(size)])) if len(words) >= size else [b" ".join(words)]
        h = np.fromiter((digest(g, SEED) for g in grams), dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: Column, text: Column, row: Column, size: int = SHINGLE) -> DataFrame:
    """doc_id, row and fp (the fingerprint's 64 bits as a signed number) of every row."""

    def step(c: dict) -> dict:
        fp = np.array([fingerprint(t, size) for t in c["text"].to_pylist()], dtype=np.uint64)
        return {"doc_id": c["doc_id"], "row": c["row"], "fp": pa.array(fp.view(np.int64))}

    rows = df.select(key.cast("bigint").alias("doc_id"), row.alias("row"), text.alias("text"))
    return arrow_map(rows, f"doc_id bigint, row {rows.schema['row'].dataType.simpleString()}, fp bigint", step, "text")


def _masks(most_bits: int) -> list[int]:
    """Sets of whole bit blocks of which two fingerprints within `most_bits` share at least one set."""
    n = most_bits + 3
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [sum(1 << b for b in range(x, y)) for x, y in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(blocks, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def planes(fp: np.ndarray) -> np.ndarray:
    """64 rows, one a bit, of the fingerprints' bits in words of 64 lanes, and room behind for shifted reads."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    packed = np.packbits(bits, axis=1, bitorder="little")
    out = np.zeros((64, 2 * (-(-len(fp) // 64)) + 2), dtype="<u8")
    out.view(np.uint8)[:, :packed.shape[1]] = packed
    return out


def _lanes(flags: np.ndarray) -> np.ndarray:
    packed = np.packbits(flags, bitorder="little")
    out = np.zeros(-(-len(flags) // 64), dtype="<u8")
    out.view(np.uint8)[:len(packed)] = packed
    return out


def within(fp: np.ndarray, left: np.ndarray, lags: range, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, i + lag) that differ in at most `radius` bits; `left[i]` counts the rows of i's group behind it.

    All lanes of a word add a plane's differences to a counter that stands vertically too and is started so that it
    overflows at radius + 1 (carry-save: one AND and one XOR a digit). Words without a lane in reach are abandoned.
    """
    p = planes(fp)
    words = -(-len(fp) // 64)
    digits = (radius + 1).bit_length() if (radius + 1) & radius else radius.bit_length()
    begin = (1 << digits) - (radius + 1)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    a_pass = max(1, LANE_WORDS // words)
    for d0 in range(lags.start, lags.stop, a_pass):
        ds = np.arange(d0, min(d0 + a_pass, lags.stop))
        over = np.concatenate([~_lanes(left >= d) for d in ds])
        at = np.flatnonzero(over != full)
        over, w, d = over[at], at % words, ds[at // words]
        q, s = w + (d >> 6), (d & 63).astype(np.uint64)
        count = [np.full(len(at), full if begin >> k & 1 else 0, dtype=np.uint64) for k in range(digits)]
        for k in range(64):
            row = p[k]
            carry = row[w] ^ ((row[q] >> s) | ((row[q + 1] << np.uint64(1)) << (np.uint64(63) - s)))
            for n in range(digits):
                count[n], carry = count[n] ^ carry, count[n] & carry
            over |= carry
            if k % PLANES_A_LOOK == PLANES_A_LOOK - 1:
                alive = over != full
                if not alive.any():
                    w = w[:0]
                    break
                if alive.mean() < 0.7:
                    over, w, d, q, s = over[alive], w[alive], d[alive], q[alive], s[alive]
                    count = [c[alive] for c in count]
        if len(w):
            r, lane = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i = w[r] * 64 + lane
            yield i, i + d[r]


def link(fp: np.ndarray, size: np.ndarray, left: np.ndarray, radius: int) -> np.ndarray:
    """For each row the first row it is connected with through pairs of its group; groups stand together."""
    parent = np.arange(len(fp))
    lo, most = 1, int(size.max(initial=0))
    while lo < most:
        hi = min(2 * lo, most)
        rows = np.flatnonzero(size > lo)
        for i, j in within(fp[rows], left[rows], range(lo, hi), radius):
            a, b = parent[rows[i]], parent[rows[j]]
            while True:
                differ = a != b
                if not differ.any():
                    break
                a, b = a[differ], b[differ]
                np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
                while (parent[parent] != parent).any():
                    parent = parent[parent]
                a, b = parent[a], parent[b]
        lo = hi
    return parent


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest of each bucket; rows come sorted by bucket, a bucket may run over batches."""
    held_g = held_fp = np.empty(0, dtype=np.int64)

    def edges(g: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        begins = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, dtype=np.int64)
        sizes = np.diff(np.append(begins, len(g)))
        size = np.repeat(sizes, sizes)
        left = np.repeat(begins + sizes, sizes) - np.arange(len(g)) - 1
        root = link(fp.view(np.uint64), size, left, radius)
        out = root != np.arange(len(g))
        return pa.RecordBatch.from_arrays([pa.array(fp[out]), pa.array(fp[root[out]])], names=["a", "b"])

    for batch in batches:
        g = np.concatenate([held_g, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([held_fp, batch.column(1).to_numpy(zero_copy_only=False)])
        last = int(np.searchsorted(g, g[-1])) if len(g) else 0
        if last:
            yield edges(g[:last], fp[:last])
        held_g, held_fp = g[last:], fp[last:]
    if len(held_g):
        yield edges(held_g, held_fp)


def linked(distinct: DataFrame, most_bits: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (column fp, distinct) within `most_bits` of each other.

    Fingerprints meet in buckets that agree on three of most_bits + 3 bit blocks (about half the bits), so none within
    reach is missed. Buckets of one are dropped, those above 2 * block are split by hash, and each pair of their blocks
    is compared in a task of its own. A bucket gives the edges of a forest, never all its pairs.
    """
    keys = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("k")) for t, m in enumerate(_masks(most_bits))])).alias("x"))
    keys = keys.select("fp", "x.t", "x.k")
    sizes = keys.groupBy("t", "k").count().filter("count > 1")
    parts = F.when(F.col("count") <= 2 * block, F.lit(1)).otherwise(F.ceil(F.col("count") / block)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    met = keys.join(sizes, ["t", "k"]).withColumn("parts", parts).withColumn("own", own)
    met = met.select("fp", "t", "k", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    bucket: Column = F.xxhash64("t", "k", F.least("own", "other"), F.greatest("own", "other"))
    met = met.select(bucket.alias("g"), "fp").repartition("g").sortWithinPartitions("g")
    reach(met.sparkSession)
    return met.mapInArrow(lambda batches: _links(batches, most_bits), "a bigint, b bigint")


def _grouped(df: DataFrame, key: Column, text: Column, row: Column, size: int, most_bits: int) -> DataFrame:
    """doc_id, row, fp, root and component_id of every row; root names a component where no row has an id, too."""
    docs, _ = written(fingerprints(df, key, text, row, size), "fingerprints")
    first, _ = written(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(linked(first.select("fp"), most_bits))
    found = first.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = found.groupBy("root").agg(F.min("first").alias("component_id"))
    return docs.join(found.join(named, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable by links) of every row.

    Texts without a word have fingerprint zero and link like any other; NULL text counts as empty. Copies share a
    fingerprint and are compared once, so a group of exact copies costs one row. A row with NULL id links others but
    names no component; a component of such rows alone has NULL. Repeated rows come back each. Other columns are not read.
    """
    out = _grouped(df, F.col(f"`{key}`"), F.col(f"`{text}`"), F.lit(0), size, most_bits)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of `df`, all columns, without near-duplicates: of each component the row with the smallest id stays.

    NULL ids come last; among rows with that id the one whose id and text have the least hash stays, and of rows equal
    in both one. Rows to drop are joined away by hash; texts are shuffled only if those are too many for Spark to send.
    """
    row = row_hash(F.col(f"`{key}`"), F.col(f"`{text}`"))
    found, _ = written(_grouped(df, F.col(f"`{key}`"), F.col(f"`{text}`"), row, size, most_bits).select("doc_id", "row", "root"), "groups")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("b")).select(F.col("b.row").alias("row"))
    copies = found.join(best, "row", "left_semi").groupBy("row").count().filter("count > 1").select("row")
    best, _ = written(best, "best")
    repeated, _ = written(copies, "repeated")
    all_columns = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("all")
    kept = without_rows(df.select(row.alias("row"), all_columns), found.select("row").distinct().join(best, "row", "left_anti"), best)
    if repeated.isEmpty():
        return kept.select("all.*")
    several = kept.join(repeated, "row", "left_semi").groupBy("row").agg(F.first("all").alias("all"))
    return kept.join(repeated, "row", "left_anti").select("row", "all").union(several).select("all.*")
