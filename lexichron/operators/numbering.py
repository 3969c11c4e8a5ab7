"""Dense numbers for the rows of a table, in an order, without one task that sees all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexichron.session import written

#: Bits of ``monotonically_increasing_id`` that hold the place within a partition.
_PLACE_BITS = 33


def numbered(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in order of the columns ``order``; equal rows are numbered in any order.

    Rows are sorted into ranges, each range begins after the sizes of those before
    it, and the place within it is part of Spark's own row id.  The table is
    written once, so that its ranges stay as they are; only their sizes, one row a
    partition, are summed up in one task.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "numbered").withColumn("_range", F.shiftright("_at", _PLACE_BITS))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.select("_range", before.alias("_begin"))
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return placed.join(F.broadcast(begins), "_range").withColumn(name, F.col("_begin") + place).drop("_at", "_range", "_begin")
