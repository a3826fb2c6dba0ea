"""Files and views from tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.operators.ordering import attach
from airgrid.session import discard, settle

#: Folder beside the partitions with the work each of them holds; Spark's readers pass over its name.
MANIFEST = "_manifest"
#: Folders that values of shared partition columns are dealt into; files written under another number must be made anew.
SHARES = 16


def write_parquet(df: DataFrame, path: str, overwrite: bool = False, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet, partitioned by columns such as grid and month; an existing path is an error.

    Rows of a partition are brought together, so that it is few files; Spark splits a partition with most rows.
    """
    writer = (df.hint("rebalance", *partition_by) if partition_by else df).write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _existing(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    """The rows of a folder as it is now; None if there is no such folder yet."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        return None


def overwrite_partitions(df: DataFrame, path: str, partition_by: tuple[str, ...], sort_by: tuple[str, ...] = ()) -> None:
    """Replace the partitions that `df` has rows of and leave all others alone; `sort_by` orders rows inside a file."""
    dealt = df.hint("rebalance", *partition_by)
    dealt = dealt.sortWithinPartitions(*partition_by, *sort_by) if sort_by else dealt
    dealt.write.partitionBy(*partition_by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def _files(existing: DataFrame, partitions: DataFrame, by: list[str]) -> DataFrame:
    """Files (`_file`) that hold rows of some partitions."""
    return attach(existing.select(*by, F.col("_metadata.file_path").alias("_file")).distinct(), partitions.select(by), by, "inner").select("_file").distinct()


def _delete(spark: SparkSession, uri: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _delete_partitions(existing: DataFrame | None, partitions: DataFrame, by: list[str]) -> None:
    """Delete the folders of the files that hold rows of some partitions."""
    if existing is None:
        return
    for folder, in _files(existing, partitions, by).select(F.regexp_replace("_file", "/[^/]*$", "")).distinct().toLocalIterator():
        _delete(existing.sparkSession, folder)


def write_changed_partitions(work: DataFrame, rows: Callable[[DataFrame], DataFrame], path: str, partition_by: tuple[str, ...],
                             shared: tuple[str, ...] = ()) -> DataFrame:
    """Bring partitioned files up to date with the work they stand for; gives the partitions that changed, by kind.

    `work` has a row for each piece of work (partition columns and what identifies the piece), `rows` makes the files'
    rows of some work. A partition is written, whole, if its work is not that of the manifest, and deleted if it has no
    work any more; `change` is `new`, `written` (again) or `deleted`. Equal pieces of work count once. The manifest of
    a partition goes before its files do and comes after they are written, so a run that failed in between is done again
    and no row ever stands twice. Work is compared by count and two sums of hashes a partition, so nothing but changed
    partitions reaches the shuffles of `rows`.

    A folder for each partition is slow where partitions are many and small. Columns in `shared` name no folder: their
    values are dealt into SHARES folders (column `share`), in whose files rows lie by them. A folder is then written
    again if one of its partitions changed; rows of the others are copied from its files and not made again.
    """
    by = list(partition_by)
    folders = [*(["share"] if shared else []), *[c for c in by if c not in shared]]
    spark = work.sparkSession

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("share", F.pmod(F.xxhash64(*shared), F.lit(SHARES)).cast("int")) if shared else df

    work = settle(dealt(work.distinct()))
    manifest = f"{path.rstrip('/')}/{MANIFEST}"
    known = _existing(spark, manifest, work)
    held = spark.createDataFrame([], work.schema) if known is None else known.select(work.columns)

    def digests(df: DataFrame, kind: str) -> DataFrame:
        piece = F.struct(*[F.col(c) for c in sorted(df.columns)])
        sums = [F.sum(F.xxhash64(piece, F.lit(i)).cast("decimal(38,0)")) for i in range(2)]
        return df.groupBy(*by).agg(F.struct(F.count(F.lit(1)), *sums).cast("struct<n:bigint,a:decimal(38,0),b:decimal(38,0)>").alias(kind))

    hidden = {c: f"_on_{c}" for c in by}
    before = digests(held, "before").withColumnsRenamed(hidden)
    met = reduce(and_, [F.col(c).eqNullSafe(F.col(h)) for c, h in hidden.items()])
    both = digests(work, "now").join(before, met, "full").where(~F.col("now").eqNullSafe(F.col("before")))
    kind = F.when(F.col("now").isNull(), "deleted").when(F.col("before").isNull(), "new").otherwise("written")
    names = [F.when(F.col("now").isNull(), F.col(h)).otherwise(F.col(c)).alias(c) for c, h in hidden.items()]
    changed = settle(dealt(both.select(*names, kind.alias("change"))))
    todo = settle(attach(work, changed.select(*by), by, "inner"))
    if not changed.isEmpty():
        touched = settle(changed.select(*folders).distinct())
        kept = settle(attach(attach(held, touched, folders, "left_semi"), changed.select(*by), by, "left_anti")) if shared and known is not None else todo.limit(0)
        mixed = kept.select(*folders).distinct()
        _delete_partitions(known, touched, folders)
        made = dealt(rows(todo.drop("share") if shared else todo))
        # files of another state, or of a run that failed before its manifest was written, count as none
        _delete_partitions(_existing(spark, path, made), attach(touched, mixed, folders, "left_anti"), folders)
        existing, old = _existing(spark, path, made), []
        places = [place for place, in mixed.select(F.xxhash64(*folders)).collect()]
        if existing is not None and places:
            # a filter on folders alone, so that no others are read
            same = existing.where(F.xxhash64(*folders).isin(places))
            old = [file for file, in _files(same, mixed, folders).toLocalIterator()]
            same = attach(same, kept.select(*by).distinct(), by, "left_semi")
            made = made.unionByName(same.select(made.columns))
        overwrite_partitions(made, path, tuple(folders), shared)
        # a folder that got no row was not replaced
        for file in old:
            _delete(spark, file)
        overwrite_partitions(todo.unionByName(kept), manifest, tuple(folders))
    discard(work)
    discard(todo)
    return changed.select(*by, "change")


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with header; `single_file` sends all rows through one task, for small exports."""
    (df.coalesce(1) if single_file else df).write.option("header", True).mode("overwrite").csv(path)


def as_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df
