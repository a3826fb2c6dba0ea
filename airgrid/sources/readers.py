"""Tables from files."""

from __future__ import annotations

from io import BytesIO
from urllib.parse import quote

import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyarrow.lib import ArrowException
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from airgrid.session import settle


def parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",") -> DataFrame:
    reader = spark.read.option("header", True).option("sep", sep)
    return (reader if schema is None else reader.schema(schema)).csv(path)


def labels_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Pipe-delimited labels with a header."""
    return csv(spark, path, schema, sep="|")


_UNREADABLE = (OSError, ValueError, TypeError, ArrowException, PySparkException)


def _open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and name of a path as Spark lists it, in which nothing is escaped."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return pafs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    return pafs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")


def _footers(batches):
    """Column text of each file's footer; NULL where the store or the file cannot be opened."""
    for batch in batches:
        texts = []
        for path in batch["path"]:
            try:
                filesystem, name = _open_store(path)
                texts.append(_column_text(from_arrow_schema(pq.read_schema(name, filesystem=filesystem))))
            except _UNREADABLE:
                texts.append(None)
        yield batch.assign(columns=texts)


def _footers_of_contents(batches):
    """Column text of each file, from the bytes that Spark read; NULL where they are no parquet file."""
    for batch in batches:
        texts = []
        for content in batch["content"]:
            try:
                texts.append(_column_text(from_arrow_schema(pq.read_schema(BytesIO(content)))))
            except _UNREADABLE:
                texts.append(None)
        yield batch[["path", "length"]].assign(columns=texts)


def _column_text(schema: T.StructType) -> str:
    # times with and without zone read into the same column
    plain = sorted(f"{f.name} {f.dataType.simpleString().replace('_ntz', '')}" for f in schema.fields)
    return ", ".join(plain)


def directory_files(spark: SparkSession, directory: str, schema: T.StructType) -> DataFrame:
    """Every parquet file below the directory: path, size, its columns, and whether it can be read and fits.

    Spark lists the files and each task reads the footers of its share. Files that the task's own
    client cannot open (a store that only Spark reaches) are read through Spark instead, whole.
    A file fits when its column names and types are those of the schema, in any order; `readable`
    tells a file that does not fit from one that is no parquet file.
    """
    return _files_with_columns(spark, directory).withColumn("fits", F.coalesce(F.col("columns") == _column_text(schema), F.lit(False)))


def _files_with_columns(spark: SparkSession, directory: str) -> DataFrame:
    """path, length, columns (NULL where a file is no parquet) and readable of every parquet file below the directory."""
    out = "path string, length long, columns string"
    files = _listed(spark, directory)
    seen = settle(files.select("path", "length").mapInPandas(_footers, out))
    opened, other = seen.where(F.col("columns").isNotNull()), seen.where(F.col("columns").isNull())
    if not other.isEmpty():
        through_spark = files.join(other.select("path"), "path", "left_semi").select("path", "length", "content")
        opened = opened.unionByName(through_spark.mapInPandas(_footers_of_contents, out))
    return opened.withColumn("readable", F.col("columns").isNotNull())


def _listed(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(directory)


def directory_table(spark: SparkSession, directory: str, schema: T.StructType,
                    drop: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """One table of the files that fit the schema, and the list of files left out with what they hold.

    Names of the files come to the driver, which lists them for the scan anyway. A file that
    cannot be opened at all is Spark's error; one whose bytes are no parquet is left out as not
    `readable`, so an empty table says that files were looked at and none fits.
    """
    files = settle(directory_files(spark, directory, schema))
    paths = [_escaped(row["path"]) for row in files.where("fits").select("path").toLocalIterator()]
    table = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return table.drop(*drop), files.where(~F.col("fits")).drop("fits")


def _escaped(path: str) -> str:
    """A listed path as the scan takes it: characters that it would expand as a pattern are quoted."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in path)


#: Types that the parquet reader reads into a wider one, narrowest first.
_WIDER = (("tinyint", "smallint", "int", "bigint"), ("tinyint", "smallint", "int", "double"), ("float", "double"))


def _reads_as(found: str, wanted: str) -> bool:
    return found == wanted or any(found in chain and wanted in chain[chain.index(found):] for chain in _WIDER)


def one_layout(versions: dict[str, T.StructType]) -> T.StructType:
    """All columns of all versions, in order of appearance, each in the narrowest type that every version reads into."""
    kinds: dict[str, list[T.DataType]] = {}
    for schema in versions.values():
        for f in schema.fields:
            kinds.setdefault(f.name, []).append(f.dataType)
    fields = []
    for name, found in kinds.items():
        texts = {k.simpleString().replace("_ntz", "") for k in found}
        wide = [k for k in [*found, T.DoubleType(), T.LongType()] if all(_reads_as(t, k.simpleString().replace("_ntz", "")) for t in texts)]
        if not wide:
            raise ValueError(f"no type holds all versions of {name}: {', '.join(sorted(texts))}")
        fields.append(T.StructField(name, wide[0]))
    return T.StructType(fields)


def versioned_files(spark: SparkSession, directory: str, versions: dict[str, T.StructType]) -> DataFrame:
    """Every parquet file below the directory, as `directory_files`, with the version its columns are (NULL: none)."""
    texts = {_column_text(schema): name for name, schema in versions.items()}
    if len(texts) < len(versions):
        raise ValueError("two versions have the same columns")
    named = F.lit(None).cast("string")
    for text, name in texts.items():
        named = F.when(F.col("columns") == text, name).otherwise(named)
    return _files_with_columns(spark, directory).withColumn("version", named)


def _clash(name: str, allowed: list[str]):
    return lambda part: (part[0] == name) & ~part[1].isin(allowed)


def versioned_table(spark: SparkSession, directory: str, versions: dict[str, T.StructType]) -> tuple[DataFrame, DataFrame]:
    """One table of the files of all versions of a schema, and the list of files that are none of them.

    The directory is scanned once, in the layout that holds every version (`one_layout`); a column that a version lacks
    is NULL in its rows, and `version` names it. Rows find their file's version by a join on the file's name, so the
    names of fitting files stay in Spark. Only files whose bytes or columns the scan could not read in that layout are
    named to it and left unopened.
    """
    layout = one_layout(versions)
    files = settle(versioned_files(spark, directory, versions))
    wanted = {f.name: f.dataType.simpleString().replace("_ntz", "") for f in layout.fields}
    # a misfit that shares a column's name but no type with it
    parts = F.transform(F.split("columns", ", "), lambda x: F.split(x, " "))
    clashes = F.lit(False)
    for name, kind in wanted.items():
        allowed = [t for t in {kind, *[x for c in _WIDER for x in c]} if _reads_as(t, kind)]
        clashes = clashes | F.exists(parts, _clash(name, allowed))
    shut = files.where(~F.col("readable") | (F.col("version").isNull() & F.coalesce(clashes, F.lit(False))))
    names = _listed(spark, directory).select("path", F.col("_metadata.file_path").alias("_file"))
    unopened = [r[0] for r in names.join(shut.select("path"), "path", "left_semi").select("_file").toLocalIterator()]
    scan = spark.read.schema(layout).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(directory) \
        .select("*", F.col("_metadata.file_path").alias("_file"))
    if unopened:
        scan = scan.where(~F.col("_file").isin(unopened))
    fitting = settle(names.join(files.where("version IS NOT NULL").select("path", "version"), "path").drop("path"))
    return scan.join(fitting, "_file").drop("_file"), files.where("version IS NULL").drop("version")


def flatten_labels(df: DataFrame) -> DataFrame:
    """Nested station records to flat columns, without the unit."""
    moved = {"coordinates", "date", "unit"}
    return df.select(
        *[c for c in df.columns if c not in moved],
        F.col("coordinates.latitude").alias("latitude"), F.col("coordinates.longitude").alias("longitude"),
        F.col("date.utc").alias("datetime_utc"), F.col("date.local").alias("datetime_local"))


def granule_catalog(df: DataFrame, product: str | None = None, suffix: str | None = None,
                    split: str | None = None, url: str = "us_url") -> DataFrame:
    """Catalogue rows of a product and split whose address contains a file suffix."""
    if product is not None:
        df = df.where(F.col("product") == product)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df if suffix is None else df.where(F.col(url).contains(suffix))
