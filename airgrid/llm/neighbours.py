"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, survivors in double, merged by heaps."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import reach

#: Vectors of a block on either side of a tile, and candidates that are multiplied at once inside it.
QUERY_BLOCK = 4_096
CANDIDATE_BLOCK = 4_096
STRIP = 512
#: Part of the size of a product that single-precision rounding of scales and bounds may cost.
SLACK = 1e-5
#: Longest vectors whose sums of int8 products single precision holds exactly: length * 127 * 127 < 2**24.
SINGLE = (1 << 24) // (127 * 127)


def _usable(v: Column) -> Column:
    """Neither NULL nor empty nor zero, and no component NULL, infinite or NaN."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


class Quantised:
    """int8 codes of vectors (held in a precision in which sums of their products are exact), scales, and what rounding cost."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        top = np.abs(vectors).max(axis=1, initial=0.0)
        self.scale = np.where(top > 0, top / 127.0, 1.0)
        codes = np.rint(vectors / self.scale[:, None])
        rest = vectors - codes * self.scale[:, None]
        self.codes = codes.astype(np.float32 if vectors.shape[1] <= SINGLE else np.float64)
        self.norm = np.sqrt((vectors * vectors).sum(axis=1))
        self.rest = np.sqrt((rest * rest).sum(axis=1))

    def part(self, a: int, b: int) -> Quantised:
        out = object.__new__(Quantised)
        for name in ("vectors", "scale", "codes", "norm", "rest"):
            setattr(out, name, getattr(self, name)[a:b])
        return out


def tile(q: Quantised, c: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """Approximate inner products and how far each may be off: |x.y - x'.y'| <= |x - x'| |y'| + |x| |y - y'|."""
    about = (q.codes @ c.codes.T) * (q.scale[:, None] * c.scale[None, :])
    off = q.rest[:, None] * (c.norm + c.rest)[None, :] + q.norm[:, None] * c.rest[None, :]
    return about, off + SLACK * q.norm[:, None] * c.norm[None, :]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1)


def nearest_in_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, query_rows: np.ndarray | None = None,
                     rows: np.ndarray | None = None) -> list[list[tuple[float, int]]]:
    """For each query a heap of the k best (score, -id) of the block; equal scores go to the smaller id.

    A query meets all but its own row: one of its id or, if rows are named apart from ids, of its id and name.
    Strip by strip, pairs whose upper bound misses the k-th best lower bound (of the strip or of the heap) are dropped
    unseen; the others get their inner product in double and go through the heap.
    """
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(queries))]
    q, c = Quantised(queries), Quantised(vectors)
    floor = np.full(len(queries), -np.inf)
    for a in range(0, len(ids), STRIP):
        strip = c.part(a, a + STRIP)
        about, off = tile(q, strip)
        own = query_ids[:, None] == ids[None, a:a + STRIP]
        if rows is not None:
            own &= query_rows[:, None] == rows[None, a:a + STRIP]
        low = np.where(own, -np.inf, about - off)
        if low.shape[1] >= k:
            floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
        i, j = np.nonzero((about + off >= floor[:, None]) & ~own)
        for at in range(0, len(i), 1 << 16):
            part_i, part_j = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
            scores = _products(q.vectors[part_i], strip.vectors[part_j])
            for row, score, key in zip(part_i.tolist(), scores.tolist(), ids[a + part_j].tolist()):
                heap, item = heaps[row], (score, -key)
                if len(heap) < k:
                    heappush(heap, item)
                elif item > heap[0]:
                    heapreplace(heap, item)
        full = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
        floor = np.maximum(floor, full)
    return heaps


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of the given length as doubles, one after the other."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
            query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank (int, from 1), vec_id and score (double) of each query's k nearest by inner product; exact.

    Every usable row is a candidate, rows where `is_query` holds are queries too. Ties go to the smaller id. A query's
    own row is no candidate. Vectors NULL, empty, zero or with a component NULL or not finite, and rows with a NULL id,
    take no part. Rows equal in id and vector count once; different vectors of one id are candidates, and queries, of
    their own, so such an id has k rows for each. Components are doubles, or floats if the column has floats. Vectors of
    different length are not comparable and meet only their like. No queries or candidates: no rows.

    Queries and candidates are dealt into blocks by hashes of their ids, each pair of blocks is one tile in one task,
    so equal vectors spread and no task holds more than two blocks. A tile sends at most k pairs a query on.
    """
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast(f"array<{_kind(df, vector)}>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # adding zero makes -0.0 a 0.0, so that equal vectors have one name
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast(_kind(df, vector))))
    rows = rows.filter(F.col("id").isNotNull() & _usable(F.col("v"))).groupBy("id", "v").agg(F.max("asks").alias("asks")).withColumn("h", F.xxhash64("v"))
    total, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    across, down = max(1, -(-total // candidate_block)), max(1, -(-asking // query_block))
    hashed = F.xxhash64("id", "h")
    candidates = rows.select("id", "h", "v", F.lit(False).alias("asks"), F.pmod(hashed, F.lit(across)).cast("int").alias("c"),
                             F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("q"))
    queries = rows.filter("asks").select("id", "h", "v", "asks", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("c"),
                                         F.pmod(F.shiftright(hashed, 20), F.lit(down)).cast("int").alias("q"))
    tiles = candidates.unionByName(queries).groupBy("c", "q", F.size("v").alias("dim"))

    def one_tile(key: tuple, t: pa.Table) -> pa.Table:
        dim = key[2].as_py()
        asks = t.column("asks").to_numpy()
        ids, names = t.column("id").to_numpy(), t.column("h").to_numpy()
        v = _matrix(t.column("v").combine_chunks(), dim)
        order = np.argsort(ids[~asks], kind="stable")
        heaps = nearest_in_block(ids[asks], v[asks], ids[~asks][order], v[~asks][order], k, names[asks], names[~asks][order])
        out = [(q, h, -i, s) for q, h, heap in zip(ids[asks].tolist(), names[asks].tolist(), heaps) for s, i in heap]
        return pa.table([pa.array(list(x), kind) for x, kind in zip(zip(*out) if out else ([], [], [], []), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
                        names=["query_id", "query_row", "vec_id", "score"])

    reach(df.sparkSession)
    found = tiles.applyInArrow(one_tile, "query_id bigint, query_row bigint, vec_id bigint, score double")
    return _merged(found, k)


def _kind(df: DataFrame, vector: str) -> str:
    """float if the column's components are floats, else double."""
    return "float" if df.schema[vector].dataType.simpleString() == "array<float>" else "double"


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query from the heaps of all its tiles; tasks keep a heap a query, rows come sorted by query."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap = None, []
        out: list[tuple] = []

        def close() -> None:
            out.extend((now[0], r, -i, s) for r, (s, i) in enumerate(sorted(heap, reverse=True), 1))

        def batch() -> pa.RecordBatch:
            columns = zip(*out) if out else ([], [], [], [])
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(columns, kinds)], names=["query_id", "rank", "vec_id", "score"])

        for b in batches:
            for q, h, i, s in zip(*(b.column(n).to_pylist() for n in range(4))):
                if (q, h) != now:
                    close()
                    now, heap = (q, h), []
                if len(heap) < k:
                    heappush(heap, (s, -i))
                elif (s, -i) > heap[0]:
                    heapreplace(heap, (s, -i))
            if len(out) > 10_000:
                yield batch()
                out.clear()
        close()
        yield batch()

    rows = found.repartition("query_id", "query_row").sortWithinPartitions("query_id", "query_row")
    return rows.mapInArrow(merge, "query_id bigint, rank int, vec_id bigint, score double")
