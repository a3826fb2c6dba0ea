"""What the corpus operators share: word pattern, tables, Arrow maps."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

import airgrid
from airgrid.session import shared_folder

#: Fixed value: a word is a run of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Bytes of text that one step of a task handles at once.
STEP_BYTES = 4_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return reach(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words of a text as an array; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def row_hash(*columns: Column) -> Column:
    """128 bits that name a row by its columns, NULLs told from empty texts; rows are only ever dropped by both halves."""
    told = [y for c in columns for y in (c.isNull(), c)]
    return F.struct(F.xxhash64(*told).alias("a"), F.xxhash64(F.lit("other"), *told[::-1]).alias("b"))


def without_rows(named: DataFrame, gone: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of `named` whose `row` (`row_hash`) is not among `gone`; `kept` has the names of all rows that stay.

    Where no kept row shares the first half of a name, that half alone tells the rows to drop: half as much for Spark to
    send to the texts. The others, none but by accident, are told by the whole name.
    """
    gone, kept = gone.select("row").distinct(), kept.select(F.col("row.a").alias("a")).distinct()
    halves = gone.select("row", F.col("row.a").alias("a"))
    told, _ = written(halves.join(kept, "a", "left_anti").select("a"), "gone")
    untold, _ = written(halves.join(kept, "a", "left_semi").select("row"), "untold")
    out = named.withColumn("_a", F.col("row.a")).join(told.withColumnRenamed("a", "_a"), "_a", "left_anti").drop("_a")
    return out if untold.isEmpty() else out.join(untold, "row", "left_anti")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; looked up in the task that opens it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def reach(spark: SparkSession) -> SparkSession:
    """Let Python workers on this file system import the package; a cluster gets it by --py-files or an installation."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(airgrid.__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    return spark


#: Functions that hold a table in a worker, and the step that last ran there.
_tables: list = []
_ran: list[str] = []


def kept_by_worker(open_table: Callable) -> Callable:
    """Keep what `open_table` makes as long as a worker runs one kind of step; workers outlive their stage."""
    held = cache(open_table)
    _tables.append(held)
    return held


def _begin(step: Callable) -> None:
    """Drop the tables of other steps before this one fills its own."""
    name = f"{step.__module__}.{getattr(step, '__qualname__', type(step).__name__)}"
    if _ran != [name]:
        for held in _tables:
            held.cache_clear()
        _give_back()
        _ran[:] = [name]


def _give_back() -> None:
    """Return freed memory to the system: a worker that idles beside others must not hold its last step's peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(df: DataFrame, schema: str, step: Callable[[dict[str, list]], dict[str, list]], size_by: str | None = None,
              step_bytes: int = STEP_BYTES, step_rows: int | None = None) -> DataFrame:
    """Map `step` over columns, a bounded number of bytes at a time.

    `step` gets and returns a dict of equally long lists (or Arrow arrays) by column. `size_by` names the text column
    that is held to `step_bytes` bytes a step (or one row), so that long texts do not add up in memory. `step_rows` holds
    a step to so many rows, where a row makes many.
    """
    target = _arrow_schema(reach(df.sparkSession), schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(step)
        for batch in batches:
            for part in _steps(batch, size_by, step_bytes) if step_rows is None else _pieces(batch, step_rows):
                out = step({c: part.column(i) for i, c in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [v if isinstance(v, pa.Array) else pa.array(v, f.type) for f in target for v in (out[f.name],)], schema=target)
        _give_back()

    return df.mapInArrow(run, schema)


def _pieces(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _steps(batch: pa.RecordBatch, size_by: str | None, step_bytes: int) -> Iterator[pa.RecordBatch]:
    if size_by is None:
        yield batch
        return
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(size_by))), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start, n = 0, batch.num_rows
    while start < n:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + step_bytes, side="right")))
        yield batch.slice(start, end - start)
        start = end


def column_type(df: DataFrame, name: str) -> str:
    """A column's name and type as a schema's text, with names inside it quoted."""
    return StructType([StructField(name, df.schema[name].dataType)]).toDDL()


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    if path in _left:
        _left.remove(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Folders that `written` made in this driver and that are not deleted yet.
_left: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete all folders that results of this driver's corpus operators stand on; call it once they are read or saved."""
    while _left:
        dropped(spark, _left[-1])


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` written to the shared folder and read again, and the folder it is in."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _left.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
