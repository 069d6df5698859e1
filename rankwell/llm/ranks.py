"""Dense numbers for the rows of a table, in a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

# monotonically_increasing_id keeps the partition above this many low bits.
_ROW_BITS = 33
PARTITION_ROWS = 1_000_000


def numbered(df: DataFrame, order: list[Column], column: str = "id") -> DataFrame:
    """``df`` (a written table) with numbers 0, 1, 2, ... in the order of ``order``.

    Rows are range-partitioned and sorted, then written, since range bounds are sampled
    anew by every run of a plan; each row takes its partition's offset plus its place. The
    offsets are one row a partition, so their broadcast and window stay small.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PARTITION_ROWS))
    sorted_ = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = staged(sorted_.withColumn("_place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_place", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(column, F.col("_offset") + place).drop("_part", "_place", "_offset")
