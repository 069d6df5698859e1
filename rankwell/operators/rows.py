"""Row-level operators: first-row dedup, dense positions, train/test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import file_bytes, first_rows
from ..sources.workspace import Workspace

# monotonically_increasing_id keeps the partition above this many low bits.
_ROW_BITS = 33

TRAIN, TEST = "train", "test"
PARTITION_BYTES = 64 << 20  # of files behind one range partition of numbered rows


def dedup_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """Keep, for each value of ``key``, the row with the smallest ``order``.

    A null key is a value like any other. Only a digest of the key and the order value are
    grouped (a hash aggregate with map-side combine), so a text copied a billion times
    still costs one row per task and long texts are not sorted. Of rows equal in both, the
    one with the least hash of its columns stays, whatever the partitions.
    """
    digest = F.coalesce(F.sha2(F.col(key), 256), F.lit("")).alias("_digest")
    first = df.groupBy(digest).agg(F.min(order).alias("_order"))
    marked = df.select("*", digest)
    same = (F.col("_digest") == F.col("_first")) & F.col(order).eqNullSafe(F.col("_order"))
    kept = marked.join(first.withColumnRenamed("_digest", "_first"), same, "left_semi")
    return first_rows(kept, ["_digest"]).select(*df.columns)


def dense_id(
    df: DataFrame, keys: list[str], workspace: Workspace, name: str, column: str = "id"
) -> DataFrame:
    """Number the rows 0, 1, 2, ... in the order of ``keys``.

    Rows are range-partitioned and sorted; each takes its partition's offset plus its
    place inside. The sorted rows are written first, since range bounds are sampled
    anew whenever a plan runs. Partitions follow the size of the files behind the rows.
    Pass only the columns the result needs.
    """
    spark = df.sparkSession
    parts = max(
        spark.sparkContext.defaultParallelism,
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        -(-file_bytes(df) // PARTITION_BYTES),
    )
    placed = workspace.stage(
        name,
        lambda: df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id()),
    )
    part = F.shiftright(F.col("_place"), _ROW_BITS)
    # One row per range partition: small whatever the size of the data.
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    local = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(column, F.col("_offset") + local)
        .drop("_part", "_place", "_offset")
    )


def split_positional(df: DataFrame, position: str, train_tenths: int = 9) -> DataFrame:
    """First ``int(0.9 n)`` rows train, the rest test; ``position`` is dense."""
    threshold = df.count() * train_tenths // 10
    return df.withColumn(
        "split", F.when(F.col(position) < threshold, TRAIN).otherwise(TEST)
    )


def _cluster_facts(split: DataFrame, position: str) -> DataFrame:
    """Per cluster: whether training lacks it, and its first test row. One aggregate."""
    is_test = F.col("split") == TEST
    return split.groupBy("cluster").agg(
        F.bool_and(is_test).alias("missing"),
        F.min(F.when(is_test, F.col(position))).alias("first_test"),
    )


def missing_clusters(split: DataFrame, position: str) -> DataFrame:
    """Clusters that no training row has."""
    return _cluster_facts(split, position).where("missing").select("cluster")


def cover_clusters(split: DataFrame, position: str) -> DataFrame:
    """Move the first test row of every cluster missing from training to training.

    At most one row per cluster moves, so the list of moved rows is as small as the
    list of clusters.
    """
    moved = _cluster_facts(split, position).where("missing").select(
        F.col("first_test").alias(position), F.lit(True).alias("_moved")
    )
    return (
        split.join(F.broadcast(moved), position, "left")
        .withColumn("split", F.when(F.col("_moved"), TRAIN).otherwise(F.col("split")))
        .drop("_moved")
    )


def hashed_bucket(key: Column, buckets: int = 10) -> Column:
    """Bucket of a row by a digest of its key: the same on every run and layout."""
    digits = F.substring(F.md5(key.cast("string")), 1, 8)
    return F.conv(digits, 16, 10).cast("long") % buckets


def split_hashed(df: DataFrame, key: str) -> DataFrame:
    """About 90/10 random split that depends on the key alone."""
    return df.withColumn(
        "split", F.when(hashed_bucket(F.col(key)) == 0, TEST).otherwise(TRAIN)
    )
