"""Adaptive tiles: a quadtree over degrees whose leaves hold a bounded number of points.

Points are counted in fine cells of every tile. A tile with too many is split into quarters until each holds few enough
or the finest level is reached; what is still too many there (points of one place) is dealt into blocks. A point lies in
one leaf and block; a box is copied to the leaves it meets and to all their blocks. Tiles with few points stay whole, so
only hot ones are in the table of leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airgrid.operators.ordering import attach
from airgrid.session import settle

#: Points that one leaf holds at most, unless a join says otherwise; and times that a tile may be quartered.
MOST_POINTS = 1_000_000
DEPTH = 8
LEAF = ["_level", "_ly", "_lx", "_block"]


def row_block(df: DataFrame, blocks: Column) -> Column:
    """A block for each row by its values and its partition, so that equal rows of different partitions spread too."""
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.pmod(F.xxhash64(*hashed) + F.spark_partition_id(), blocks)


@dataclass
class Tiles:
    """Tiles `size` degrees wide; `hot` has the leaves of split tiles by fine cell (None: no tile is split)."""

    size: float
    hot: DataFrame | None = None

    def fine(self, degrees: Column) -> Column:
        """Number of the fine cell; monotone in the coordinate, so that it keeps the order of compared values."""
        return F.floor(degrees.cast("double") / F.lit(self.size / (1 << DEPTH))).cast("long")

    def of_points(self, df: DataFrame, y: Column, x: Column) -> DataFrame:
        """Add LEAF, the leaf and block of each point; points without coordinates have none."""
        out = df.withColumns({"_fy": self.fine(y), "_fx": self.fine(x)})
        level, blocks = F.lit(0), F.lit(1)
        if self.hot is not None:
            out = attach(out, self.hot.select("_fy", "_fx", F.col("level").alias("_hot"), F.col("blocks").alias("_of")), ["_fy", "_fx"])
            level, blocks = F.coalesce("_hot", level), F.coalesce("_of", blocks)
        down = F.lit(DEPTH) - level
        block = F.lit(0).cast("long") if self.hot is None else row_block(df, blocks.cast("long"))
        return out.withColumns({"_level": level, "_ly": F.call_function("shiftright", F.col("_fy"), down), "_lx": F.call_function("shiftright", F.col("_fx"), down),
                                "_block": block}).drop("_fy", "_fx", "_hot", "_of")

    def of_boxes(self, df: DataFrame, south: Column, north: Column, west: Column, east: Column) -> DataFrame:
        """A row with LEAF for each leaf and block that a box can meet; none for a box without extent or ends."""
        ends = {"_s": self.fine(south), "_n": self.fine(north), "_w": self.fine(west), "_e": self.fine(east)}

        def span(low, high):
            ends = F.shiftright(low, DEPTH), F.shiftright(high, DEPTH)
            return F.explode(F.when(F.col(low) <= F.col(high), F.sequence(*ends)))

        out = df.withColumns(ends).withColumn("_ty", span("_s", "_n")).withColumn("_tx", span("_w", "_e"))
        if self.hot is None:
            return out.withColumns({"_level": F.lit(0), "_ly": F.col("_ty"), "_lx": F.col("_tx"), "_block": F.lit(0).cast("long")}).drop("_ty", "_tx", *ends)
        leaves = self.hot.select("_ty", "_tx", "level", "ly", "lx", "blocks").distinct()
        out = attach(out, leaves, ["_ty", "_tx"])
        width = F.expr(f"shiftleft(1L, {DEPTH} - level)")
        low_y, low_x = F.col("ly") * width, F.col("lx") * width
        meets = (low_y <= F.col("_n")) & (low_y + width > F.col("_s")) & (low_x <= F.col("_e")) & (low_x + width > F.col("_w"))
        out = out.where(F.col("level").isNull() | meets)
        out = out.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)).cast("long") - 1)))
        return out.withColumns({"_level": F.coalesce("level", F.lit(0)), "_ly": F.coalesce("ly", "_ty"), "_lx": F.coalesce("lx", "_tx")}).drop(
            "_ty", "_tx", "level", "ly", "lx", "blocks", *ends)


def adaptive_tiles(size: float, points: list[tuple[DataFrame, Column, Column]], most: int | None = MOST_POINTS) -> Tiles:
    """Tiles for tables of points (each with its y and x); one narrow pass counts them. `most` None: no tile is split."""
    plain = Tiles(size)
    if most is None:
        return plain
    counted = None
    for df, y, x in points:
        part = df.groupBy(plain.fine(y).alias("_fy"), plain.fine(x).alias("_fx")).agg(F.count(F.lit(1)).alias("n")).where("_fy IS NOT NULL AND _fx IS NOT NULL")
        counted = part if counted is None else counted.unionByName(part)
    # a tile's fine cells are counted together first, so that only hot tiles keep theirs
    tiled = counted.withColumns({"_ty": F.shiftright("_fy", DEPTH), "_tx": F.shiftright("_fx", DEPTH)})
    full = settle(tiled.groupBy("_ty", "_tx").agg(F.sum("n").alias("total")).where(F.col("total") > most))
    if full.isEmpty():
        return plain
    cells = tiled.join(full.drop("total"), ["_ty", "_tx"]).groupBy("_ty", "_tx", "_fy", "_fx").agg(F.sum("n").alias("n"))

    def inside(level: int) -> Column:
        down = DEPTH - level
        return F.sum("n").over(Window.partitionBy("_ty", "_tx", F.shiftright("_fy", down), F.shiftright("_fx", down)))

    level, held = F.lit(DEPTH), F.col(f"n{DEPTH}")
    for k in range(DEPTH - 1, 0, -1):
        fits = F.col(f"n{k}") <= most
        level, held = F.when(fits, k).otherwise(level), F.when(fits, F.col(f"n{k}")).otherwise(held)
    cells = cells.withColumns({f"n{k}": inside(k) for k in range(1, DEPTH + 1)})
    leaves = cells.select("_ty", "_tx", "_fy", "_fx", level.alias("level"), F.ceil(held / most).alias("blocks"))
    down = F.lit(DEPTH) - F.col("level")
    return Tiles(size, settle(leaves.withColumns({"ly": F.call_function("shiftright", F.col("_fy"), down), "lx": F.call_function("shiftright", F.col("_fx"), down)})))
