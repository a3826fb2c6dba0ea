"""A kept table of the latest value of each rounded place, advanced by new rows alone and asked without moving it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.constants import NO_DATA_ANSWER
from airgrid.session import shared_folder

PLACE = ["place_y", "place_x"]


class LatestValues:
    """place_y, place_x (whole numbers), date and value, in files bucketed and sorted by place.

    Rows of new days are summed up, dealt into the same buckets and merged with the kept table bucket by bucket; the
    kept side is neither shuffled nor sorted, nor is it when requests are answered. Each state is a folder of its own
    that is named only when it is whole, so a run that fails leaves the state before. Of equal dates the larger value counts.
    """

    def __init__(self, spark: SparkSession, name: str, digits: int = 2, buckets: int = 64, lat: str = "latitude", lon: str = "longitude"):
        self.spark, self.name, self.digits, self.buckets, self.lat, self.lon = spark, name, digits, buckets, lat, lon
        self.table: str | None = None

    def _placed(self, df: DataFrame) -> DataFrame:
        # whole numbers, so that a join takes the keys as they are stored
        return df.withColumns({p: F.round(F.round(F.col(c).cast("double"), self.digits) * 10**self.digits).cast("long") for p, c in zip(PLACE, (self.lat, self.lon))})

    def kept(self) -> DataFrame:
        return self.spark.table(self.table)

    def merged(self, rows: DataFrame, date: str, value: str) -> DataFrame:
        """The next state of the table with `rows` added."""
        newest = self._placed(rows).where(F.col(date).isNotNull() & F.col("place_y").isNotNull() & F.col("place_x").isNotNull()).groupBy(*PLACE).agg(
            F.max(F.struct(F.col(date).alias("date"), F.col(value).alias("value"))).alias("new"))
        if self.table is None:
            return newest.select(*PLACE, "new.date", "new.value")
        old = self.kept().select(*PLACE, F.struct("date", "value").alias("old"))
        both = old.join(newest.repartition(self.buckets, *PLACE), PLACE, "full")
        latest = F.greatest("old", "new")
        return both.select(*PLACE, latest["date"].alias("date"), latest["value"].alias("value"))

    def advance(self, rows: DataFrame, date: str, value: str = "value") -> None:
        """Add rows of any days; those older than what a place has change nothing."""
        state = self.merged(rows, date, value)
        table = f"{self.name}_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark).rstrip('/')}/{table}"
        state.write.bucketBy(self.buckets, *PLACE).sortBy(*PLACE).option("path", path).saveAsTable(table)
        before, self.table, path_before = self.table, table, getattr(self, "path", None)
        self.path = path
        if before:
            self.spark.sql(f"DROP TABLE {before}")
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path_before)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def answers(self, requests: DataFrame, answer: str = "answer") -> DataFrame:
        """Each request with the latest value at its place as text, or the no-data answer."""
        asked = self._placed(requests)
        found = asked.join(self.kept().select(*PLACE, F.col("value").alias("_value")), PLACE, "left")
        return found.select(*requests.columns, F.coalesce(F.col("_value").cast("string"), F.lit(NO_DATA_ANSWER)).alias(answer))
