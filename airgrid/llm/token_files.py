"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airgrid.llm.common import arrow_map
from airgrid.llm.word_ids import NUMBERED_BYTES, open_words

#: Layout of the files: stripes are what readers split by, the row index stride is what a filter can skip.
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1_000
BLOOM_FPP = 0.01


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts and write them to ORC in ascending id order; file names ascend with the ids too.

    Columns: part (number of the file), doc_id, before (ids of earlier rows of the file), n_tokens, ids. NULL text is
    empty and has the end id alone; NULL ids sort first; repeated rows are written each. Only texts are shuffled (once,
    by id range): ids are made after it, in the tasks that write. An empty table gives a folder without rows.
    """
    ranged = (docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
              .repartitionByRange("doc_id").sortWithinPartitions("doc_id"))

    class Step:
        """Running count of one task; a task makes its own."""

        def __init__(self):
            self.part, self.before = None, 0

        def __call__(self, c: dict) -> dict:
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            if part != self.part:
                self.part, self.before = part, 0
            ids, at = open_words(tokenizer).texts(c["text"], end_id)
            before = self.before + at[:-1]
            self.before += int(at[-1])
            return {"part": pa.array(np.full(len(before), part, np.int32)), "doc_id": c["doc_id"], "before": pa.array(before),
                    "n_tokens": pa.array(np.diff(at)), "ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32)))}

    rows = arrow_map(ranged, "part int, doc_id bigint, before bigint, n_tokens bigint, ids array<int>", Step(), "text", NUMBERED_BYTES)
    (rows.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", BLOOM_FPP)
     .option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", INDEX_ROWS).option("orc.create.index", "true").orc(path))


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the files; stripes are read in parallel. `doc_ids` is pushed down to indexes and Bloom filters."""
    rows = spark.read.schema("part int, doc_id bigint, before bigint, n_tokens bigint, ids array<int>").orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin([int(i) for i in doc_ids]))


def checksums(rows: DataFrame) -> DataFrame:
    """part, doc_id, before, n_tokens and the CRC-32 of the ids read back, as unsigned little-endian 32-bit numbers."""

    def step(c: dict) -> dict:
        ids = c["ids"]
        data = memoryview(np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
        at = 4 * np.cumsum(np.concatenate([[0], ids.value_lengths().to_numpy(zero_copy_only=False)]))
        crc = [zlib.crc32(data[a:b]) for a, b in zip(at, at[1:])]
        return {"part": c["part"], "doc_id": c["doc_id"], "before": c["before"], "n_tokens": pa.array(np.diff(at) // 4), "ids_crc32": crc}

    return arrow_map(rows.select("part", "doc_id", "before", "ids"), "part int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint", step)


def with_starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Add start, the ids of all documents before a row's, from part and before; `files` are the rows as read.

    Sums per file are few and alone are ordered in one task; join them to narrow rows, not to the ids themselves.
    """
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    return rows.join(base, "part").withColumn("start", F.col("base") + F.col("before")).drop("base")
