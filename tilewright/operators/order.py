"""Numbers in an order over a whole table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Bits of Spark's own row ids below the partition's number.
_LOCAL = 33


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """The rows with ``name``: 1 for the first in ``order``, and so on; rows that tie are numbered in some order.

    The table is cut into ranges, each sorted by a task; what comes before a range is known from the ranges' sizes, of
    which there are as many as partitions.
    """
    ranges = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", _LOCAL)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy(part.alias("_part")).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = F.col("_id").bitwiseAND(F.lit((1 << _LOCAL) - 1)) + 1
    return ranges.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + own).drop("_id", "_part", "_before")
