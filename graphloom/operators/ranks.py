"""Numbers in a total order without a task that holds the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut

#: Bits of a row's place within its partition in ``monotonically_increasing_id``.
PLACE_BITS = 33


def numbered(rows: DataFrame, *order: Column | str, name: str = "number", start: int = 0) -> DataFrame:
    """``rows`` with their number in an order, from ``start``; equal rows are numbered in any order.

    The table is sorted by range; a partition's numbers follow those of the
    partitions before, of which the driver sees one count each.
    """
    spark = rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("place_", F.monotonically_increasing_id()))
    part = F.shiftright("place_", PLACE_BITS)
    counts = placed.groupBy(part.alias("part_")).count().orderBy("part_").collect()
    before, at = [], start
    for r in counts:
        before.append((r["part_"], at))
        at += r["count"]
    offsets = F.broadcast(spark.createDataFrame(before, "part_ long, before_ long"))
    number = F.col("before_") + F.col("place_").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return placed.withColumn("part_", part).join(offsets, "part_").select(*rows.columns, number.alias(name))
