"""Connected components by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import dropped, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang larger neighbours (large) or smaller ones and the node itself (small) under the smallest of a node's neighbourhood."""
    if large:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("m"))
        moved = near.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) of every node with an edge; edges are columns a and b (bigint).

    Rounds move edges to ever smaller centres, each is written and read again, and the folder before it is deleted. It
    ends when a round leaves the sum of the edges' hashes as it was. Minima are combined before the shuffle and joins go
    by node, which adaptive execution splits where one centre is heavy. NULL ends and loops are dropped. No edges: no rows.
    """
    spark = edges.sparkSession
    now, path = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        later, later_path = written(_stars(_stars(now, True), False), "edges")
        dropped(spark, path)
        now, path = later, later_path
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        mark = seen
