"""Vector codes by codebooks of vector parts: exact rounds of k-means whose bounds stand on net displacements of the entries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import dropped, reach, written
from airgrid.operators.ordering import attach

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE = 1_024
#: Entries that share a bound.
GROUP = 32
#: Whole numbers are below this size, so that squared distances fit 64 bits; larger components are an error.
LARGEST = 1 << 24
#: Part of a bound that rounding may cost.
SLACK = 1e-6
FAR = np.iinfo(np.int64).max


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, entries) of whole numbers; by a product where it is exact in double precision."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if x.shape[1] * (2 * largest) ** 2 < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in c], axis=1) if len(c) else np.empty((len(x), 0), np.int64)


def _root_below(d: np.ndarray) -> np.ndarray:
    return (np.sqrt(d.astype(np.float64)) * (1 - SLACK)).astype(np.float32)


class Codebook:
    """All versions of one part's codebook, and how far a group's entries have moved from any version to the last, net."""

    def __init__(self, history: list[np.ndarray]):
        self.history, self.now = history, history[-1]
        self.first = list(range(0, len(self.now), GROUP))
        # the distance between two versions of an entry, not the length of its way there
        self.moved = np.array([[np.sqrt(((self.now[g:g + GROUP] - old[g:g + GROUP]).astype(np.float64) ** 2).sum(1)).max() * (1 + SLACK) for g in self.first]
                               for old in history])

    def start(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry of each row (ties: the lower), its squared distance, bounds on the others by group, and their stamps."""
        d = squared(x, self.now)
        at = d.argmin(axis=1)
        rows = np.arange(len(x))
        least = d[rows, at]
        d[rows, at] = FAR
        bounds = np.stack([_root_below(d[:, g:g + GROUP].min(axis=1)) for g in self.first], axis=1)
        return at, least, bounds, np.full(bounds.shape, len(self.history) - 1, dtype=np.uint8)

    def again(self, x: np.ndarray, at: np.ndarray, bounds: np.ndarray, stamps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for rows with an earlier assignment; only groups that a bound does not rule out are scanned.

        A bound of stamp t holds for its group's entries of version t but the one then assigned. Less the group's net
        displacement since t it holds now. A group is scanned if that is not above the distance to the assigned entry.
        """
        now = len(self.history) - 1
        own = ((x - self.now[at]) ** 2).sum(1)
        left = bounds.astype(np.float64) - self.moved[stamps, np.arange(len(self.first))[None, :]]
        scan = left * (1 - SLACK) <= (np.sqrt(own.astype(np.float64)) * (1 + SLACK))[:, None]
        best, entry = own.copy(), at.copy()
        scanned = []
        for g, first in enumerate(self.first):
            rows = np.flatnonzero(scan[:, g])
            if not len(rows):
                continue
            d = squared(x[rows], self.now[first:first + GROUP])
            j = d.argmin(axis=1)
            least, index = d[np.arange(len(rows)), j], j + first
            nearer = (least < best[rows]) | ((least == best[rows]) & (index < entry[rows]))
            best[rows[nearer]], entry[rows[nearer]] = least[nearer], index[nearer]
            scanned.append((g, first, rows, d))
        bounds, stamps = bounds.copy(), stamps.copy()
        # an entry that is no longer assigned joins those its group's bound is about
        lost = np.flatnonzero(entry != at)
        group = at[lost] // GROUP
        bounds[lost, group] = np.minimum(left[lost, group], np.sqrt(own[lost].astype(np.float64)) * (1 - SLACK)).astype(np.float32) * np.float32(1 - SLACK)
        stamps[lost, group] = now
        for g, first, rows, d in scanned:
            inside = np.flatnonzero((entry[rows] >= first) & (entry[rows] < first + GROUP))
            d[inside, entry[rows[inside]] - first] = FAR
            bounds[rows, g], stamps[rows, g] = _root_below(d.min(axis=1)), now
        return entry, best, bounds, stamps


def _cuts(dim: int, parts: int) -> list[int]:
    """Where parts begin and end; the first ones are longer if the length does not divide."""
    return np.cumsum([0] + [len(p) for p in np.array_split(np.arange(dim), parts)]).tolist()


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    n, width = len(rows), rows.nbytes // max(1, len(rows))
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(rows.tobytes())])


def _bytes(column: pa.Array, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), *shape)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def assign(rows: DataFrame, books: list[list[np.ndarray]], dim: int) -> DataFrame:
    """`rows` (id, label, v, and from the second time on code, bounds, stamps) with code, bounds, stamps and error by the last codebooks.

    `books` holds each part's versions. The state of a row is a byte, and for each group of entries a bound and its stamp.
    """
    cuts, begun = _cuts(dim, len(books)), "code" in rows.columns
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"id bigint, label {kinds['label']}, v {kinds['v']}, code binary, bounds binary, stamps binary, error bigint"
    groups = -(-len(books[0][0]) // GROUP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Codebook(h) for h in books]
        for b in batches:
            c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            x = _matrix(c["v"], dim)
            if begun:
                code = _bytes(c["code"], np.uint8, (len(books),)).astype(np.int64)
                bounds, stamps = _bytes(c["bounds"], np.float32, (len(books), groups)), _bytes(c["stamps"], np.uint8, (len(books), groups))
            found = []
            for p, book in enumerate(held):
                part = x[:, cuts[p]:cuts[p + 1]]
                found.append(book.again(part, code[:, p], bounds[:, p], stamps[:, p]) if begun else book.start(part))
            at, least, new, stamp = (np.stack(y, axis=1) for y in zip(*found))
            columns = [c["id"], c["label"], c["v"], _binary(at.astype(np.uint8)), _binary(new.astype(np.float32)), _binary(stamp.astype(np.uint8)), pa.array(least.sum(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "v", "code", "bounds", "stamps", "error"])

    reach(rows.sparkSession)
    return rows.select(*[n for n in ("id", "label", "v", "code", "bounds", "stamps") if n in rows.columns]).mapInArrow(run, schema)


def moved(rows: DataFrame, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """The next codebooks: componentwise floor(sum / count) of the parts assigned to each entry; unused entries stay.

    Tasks send one row for each entry they met, Spark adds them up; the driver gets as many numbers as the codebooks have.
    """
    cuts = _cuts(dim, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(c), 1 + cuts[p + 1] - cuts[p]), dtype=np.int64) for p, c in enumerate(books)]
        for b in batches:
            x, code = _matrix(b.column(0), dim), _bytes(b.column(1), np.uint8, (len(books),))
            for p, total in enumerate(sums):
                total[:, 0] += np.bincount(code[:, p], minlength=len(total))
                for j in range(cuts[p], cuts[p + 1]):
                    # sums of a batch are whole numbers below 2**53
                    total[:, 1 + j - cuts[p]] += np.bincount(code[:, p], weights=x[:, j], minlength=len(total)).astype(np.int64)
        out = [(p, e, total[e].tolist()) for p, total in enumerate(sums) for e in np.flatnonzero(total[:, 0]).tolist()]
        columns = [pa.array(list(c), k) for c, k in zip(zip(*out) if out else ([], [], []), (pa.int32(), pa.int32(), pa.list_(pa.int64())))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "sums"])

    partial = rows.select("v", "code").mapInArrow(run, "part int, entry int, sums array<bigint>")
    sums = partial.select("part", "entry", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("x").alias("x"))
    found = sums.groupBy("part", "entry").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda y: y["x"]).alias("sums"))
    out = [c.copy() for c in books]
    for part, entry, (count, *total) in found.collect():
        out[part][entry] = [t // count for t in total]
    return out


def whole(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """id, label, v (floor(scale * x) of each component) of the rows whose vector is not NULL and holds finite numbers only."""
    v = F.col(f"`{vector}`").cast("array<double>")
    usable = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    numbers = F.transform(v, lambda x: F.when(F.abs(x * scale) < LARGEST, F.floor(x * scale).cast("int"))
                          .otherwise(F.raise_error(F.lit(f"a component is {LARGEST // scale} or more in size")).cast("int")))
    return df.filter(usable).select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{label}`").alias("label"), numbers.alias("v"))


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error) of every kept row, and the final codebooks.

    Rows whose vector is NULL or holds a NULL or non-finite component are dropped. Codebooks start as the parts of the
    rows with the smallest ids (NULL last, equal ids by vector); fewer rows give as many entries. Vectors of another
    length than the first of these rows cannot be compared: they keep their row with NULL code and error. A length that
    the parts do not divide makes the first parts longer. Rows that repeat stay and count each. A component of 16 384 and
    more is an error: squared distances would leave 64 bits. No rows: no codebooks.
    """
    spark = df.sparkSession
    kept, first = written(whole(df, key, vector, label, scale), "vectors")
    lead = kept.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v")).first()
    if lead is None:
        dropped(spark, first)
        return spark.createDataFrame([], f"id bigint, label {kept.schema['label'].dataType.simpleString()}, code string, error bigint"), []
    dim = lead[0]
    alike = kept.filter(F.size("v") == dim)
    seeds = [r[0] for r in alike.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    cuts = _cuts(dim, parts)
    books = [[np.array(seeds, dtype=np.int64).reshape(len(seeds), dim)[:, a:b]] for a, b in zip(cuts, cuts[1:])]
    rows, folder = alike, None
    for turn in range(rounds + 1):
        rows, new = written(assign(rows, books, dim), "codes")
        if folder:
            dropped(spark, folder)
        folder = new
        if turn < rounds:
            for history, book in zip(books, moved(rows, [h[-1] for h in books], dim)):
                history.append(book)
    others = kept.filter(F.size("v") != dim).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    found = rows.select("id", "label", F.lower(F.hex("code")).alias("code"), "error").unionByName(others)
    found, _ = written(found, "coded")
    dropped(spark, folder)
    dropped(spark, first)
    return found, [h[-1] for h in books]


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **how) -> DataFrame:
    """vec_id, code (hex), error, label_error (errors of equal labels, NULLs together) and codebooks_sha256 of every kept row; see `compress`."""
    found, books = compress(df, key, vector, label, **how)
    by_label = found.groupBy("label").agg(F.sum("error").alias("label_error"))
    return attach(found, by_label, ["label"]).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
