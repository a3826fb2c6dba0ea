"""Best-fit packing by length patterns: non-negative least squares on the histogram of lengths, then best fit for the rest."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airgrid.llm.common import arrow_map, column_type
from airgrid.llm.word_ids import NUMBERED_BYTES, open_words
from airgrid.session import settle

#: Patterns that the fit may use, and its sweeps; both depend on the capacity, never on the number of documents.
MOST_PATTERNS = 6_000
SWEEPS = 60
#: Rows that share a length are numbered in buckets of about this many.
BUCKET_ROWS = 100_000


def patterns(histogram: np.ndarray, most: int = MOST_PATTERNS) -> list[tuple[int, ...]]:
    """Few-document length patterns (one, two or three documents) that fill the capacity exactly.

    `histogram[l]` counts the documents of length l. All singles and pairs are listed; triples by the count of their
    rarest member, as far as `most` allows. What they leave is packed by best fit, so a short list costs no document.
    """
    capacity = len(histogram) - 1
    there = np.flatnonzero(histogram)
    has = set(there.tolist())
    found = [(capacity,)] if capacity in has else []
    found += [(capacity - x, x) for x in there.tolist() if 2 * x <= capacity and capacity - x in has]
    best: list[tuple[int, tuple[int, ...]]] = []
    for a in there.tolist():
        b = there[(there <= a) & (there < capacity - a)]
        c = capacity - a - b
        ok = (c >= 1) & (c <= b)
        b, c = b[ok], c[ok]
        enough = histogram[c] > 0
        b, c = b[enough], c[enough]
        support = np.minimum(histogram[a], np.minimum(histogram[b], histogram[c]))
        top = np.argsort(-support, kind="stable")[:16]
        best += [(-int(support[i]), (a, int(b[i]), int(c[i]))) for i in top]
    best.sort()
    return found + [p for _, p in best[: max(0, most - len(found))]]


def fit_counts(histogram: np.ndarray, columns: list[tuple[int, ...]], sweeps: int = SWEEPS) -> np.ndarray:
    """x >= 0 with sum of x * pattern nearest to the histogram in squares, by coordinate descent."""
    left = histogram.astype(float).copy()
    uses = [sorted(Counter(c).items()) for c in columns]
    weight = [float(sum(m * m for _, m in u)) for u in uses]
    x = np.zeros(len(columns))
    for _ in range(sweeps):
        moved = 0.0
        for k, u in enumerate(uses):
            step = sum(m * left[n] for n, m in u) / weight[k]
            step = max(step, -x[k])
            if step:
                x[k] += step
                for n, m in u:
                    left[n] -= m * step
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences); uses every document of the histogram exactly once."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    capacity = len(left) - 1
    columns = patterns(left)
    x = fit_counts(left, columns)
    out: list[tuple[tuple[int, ...], int]] = []
    for k in np.argsort(-x, kind="stable").tolist():
        use = Counter(columns[k])
        repeat = min(int(np.floor(x[k] + 1e-9)), *(int(left[n]) // m for n, m in use.items()))
        if repeat > 0:
            out.append((columns[k], repeat))
            for n, m in use.items():
                left[n] -= m * repeat
    return out + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: equal documents go to equal sequences in one step."""
    spaces: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for n in np.flatnonzero(left)[::-1].tolist():
        docs = int(left[n])
        while docs:
            space = next((s for s in range(n, capacity) if spaces[s]), None)
            if space is None:
                each = min(capacity // n, docs)
                count = docs // each
                spaces[capacity - each * n].append(((n,) * each, count))
                docs -= each * count
                continue
            content, count = spaces[space].pop()
            put = min(docs, count)
            if count > put:
                spaces[space].append((content, count - put))
            spaces[space - n].append((content + (n,), put))
            docs -= put
    return [x for s in spaces for x in s]


class Slots:
    """Where the document number `rank` of a length goes, for whole columns of them."""

    def __init__(self, sequences: list[tuple[tuple[int, ...], int]]):
        rows, filled, first = [], Counter(), 0
        for content, repeat in sequences:
            at = 0
            for n, m in sorted(Counter(content).items(), reverse=True):
                rows.append((n, filled[n], m, first, at))
                filled[n] += m * repeat
                at += n * m
            first += repeat
        rows.sort()
        self.length, self.begin, self.each, self.first, self.at = (np.array(c, dtype=np.int64) for c in (zip(*rows) if rows else [[]] * 5))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.rec.fromarrays([self.length, self.begin])
        k = np.searchsorted(key, np.rec.fromarrays([length.astype(np.int64), rank.astype(np.int64)], dtype=key.dtype), side="right") - 1
        j = rank - self.begin[k]
        return self.first[k] + j // self.each[k], self.at[k] + j % self.each[k] * length


def cut(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` tokens: doc_id, piece, start, length, ids_crc32 and, if asked, ids.

    A document is its ids and then `end_id`; only longer ones are cut, into pieces of `capacity` and a rest. NULL text is
    empty and has the end id alone. Repeated rows are cut each.
    """

    def step(c: dict) -> dict:
        ids, at = open_words(tokenizer).texts(c["text"], end_id)
        sizes = np.diff(at)
        parts = -(-sizes // capacity)
        doc = np.repeat(np.arange(len(sizes)), parts)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = piece * capacity
        length = np.minimum(sizes[doc] - start, capacity)
        first = at[doc] + start
        data = memoryview(ids).cast("B")
        crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())]
        out = {"doc_id": c["doc_id"].take(pa.array(doc)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": crc}
        if with_ids:
            out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(first, at[-1]).astype(np.int32)), pa.array(ids.view(np.int32)))
        return out

    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return arrow_map(rows, schema, step, "text", NUMBERED_BYTES)


def pack(pieces: DataFrame, capacity: int, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """`pieces` with sequence_id and offset (long); every row is placed, every sequence is gapless from 0.

    Lengths are 1 to `capacity`; another length is an error. The histogram (at most `capacity` rows) goes to the driver,
    where patterns are enumerated, fitted and rounded; rows are numbered within their length by hashed buckets, so a
    length that a third of all rows share is numbered in many tasks, and placed by searching a table whose size depends
    on the capacity alone. Rows that tie in `order` take either place. An empty table stays empty.
    """
    pieces = pieces.drop("sequence_id", "offset")
    by = [F.col(f"`{c}`") for c in order]
    # rows are dealt by what is written here; the partition spreads rows of one id (NULL, or repeated)
    rows = settle(pieces.select(F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("held"), F.col(f"`{length}`").cast("bigint").alias("length"),
                                F.xxhash64(*by, F.spark_partition_id()).alias("spread")))
    counted = rows.groupBy("length").count().collect()
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for n, count in counted:
        if n is None or not 1 <= n <= capacity:
            raise ValueError(f"length {n} is not from 1 to {capacity}")
        histogram[n] = count
    slots = Slots(plan(histogram))
    buckets = max(8, int(histogram.sum()) // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.pmod("spread", F.lit(buckets)))
    per = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    per = per.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("spread", *[F.col(f"held.`{c}`") for c in order])
    ranked = rows.withColumn("nth", F.row_number().over(within) - 1).join(per, ["length", "bucket"])
    ranked = ranked.select("held", "length", (F.col("base") + F.col("nth")).alias("rank"))

    def step(c: dict) -> dict:
        sequence, offset = slots.place(c["length"].to_numpy(zero_copy_only=False), c["rank"].to_numpy(zero_copy_only=False))
        return {"held": c["held"], "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())}

    schema = f"{column_type(ranked, 'held')}, sequence_id bigint, offset bigint"
    return arrow_map(ranked, schema, step).select("held.*", "sequence_id", "offset")
