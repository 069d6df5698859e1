"""Written stages shared by all tasks of a session.

A stage is a Parquet table below the folder the cluster names in
``spark.checkpoint.dir``. It cuts lineage, outlives lost executors and is built once:
a finished stage is read back, an unfinished one is written again.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PACKAGE = "rankwell"


def shared_root(spark: SparkSession) -> str:
    """Folder for stages: the cluster's own setting, or a fresh one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)  # local mode only gets here without one
    return root.rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, on whatever file system it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has been committed."""
    return path_exists(spark, f"{path}/_SUCCESS")


def fingerprint(df: DataFrame, *parameters: object) -> str:
    """Digest of a plan, the files it reads (names, lengths, times) and parameters."""
    spark = df.sparkSession
    files = []
    for name in sorted(df.inputFiles()):
        target = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target)
        files.append((name, status.getLen(), status.getModificationTime()))
    return hashlib.md5(repr((df.semanticHash(), files, parameters)).encode()).hexdigest()[:16]


class Workspace:
    """Named stages of one input, private to the running application."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    @classmethod
    def of(cls, spark: SparkSession, *key: object) -> Workspace:
        digest = hashlib.md5(repr(key).encode()).hexdigest()[:12]
        app = spark.sparkContext.applicationId
        return cls(spark, f"{shared_root(spark)}/{PACKAGE}/{app}/{digest}")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def child(self, name: str) -> Workspace:
        return Workspace(self.spark, self.path(name))

    def has(self, name: str) -> bool:
        return is_complete(self.spark, self.path(name))

    def stage(
        self,
        name: str,
        build: Callable[[], DataFrame],
        partition_by: str | None = None,
        schema: StructType | None = None,
    ) -> DataFrame:
        """Write ``build()`` once under ``name`` and read it from there.

        A partitioned table without rows has no file; it is read by its ``schema``.
        """
        path = self.path(name)
        if not self.has(name):
            writer = build().write.mode("overwrite")
            if partition_by:
                writer = writer.partitionBy(partition_by)
            writer.parquet(path)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(path)

    def stage_bucketed(
        self,
        name: str,
        build: Callable[[], DataFrame],
        keys: list[str],
        buckets: int,
        sort_by: str | None = None,
        dealt: bool = False,
    ) -> DataFrame:
        """Like :meth:`stage`, hash-bucketed by ``keys``.

        Later aggregations on these keys (or on a superset of them) then need no
        shuffle. Each task writes one bucket, so there is one file per bucket; rows that
        are ``dealt`` out so already are not shuffled again. Take the number of buckets from :meth:`buckets` where stages outlive the session.
        """
        path, table = self.path(name), self._table(name)
        if not self.has(name):
            rows = build()
            rows = rows if dealt else rows.repartition(buckets, *keys)
            writer = rows.write.mode("overwrite").bucketBy(buckets, *keys)
            if sort_by:
                writer = writer.sortBy(sort_by)
            writer.option("path", path).saveAsTable(table)
        elif not self.spark.catalog.tableExists(table):
            # Written by an earlier session: only the catalog entry is missing.
            columns = self.spark.read.parquet(path).schema.toDDL()
            self.spark.sql(
                f"CREATE TABLE {table} ({columns}) USING parquet "
                f"CLUSTERED BY ({', '.join(keys)}) INTO {buckets} BUCKETS LOCATION '{path}'"
            )
        return self.spark.table(table)

    def buckets(self, name: str, wanted: int) -> int:
        """``wanted`` on the first call, and that same number ever after: it is noted
        down beside the stages, since files already bucketed keep their layout."""
        row = self.spark.range(1).select(F.lit(wanted).alias("buckets"))
        return self.stage(f"{name}_buckets", lambda: row).first()["buckets"]

    def forget(self, name: str) -> None:
        """Remove a bucketed stage from the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")

    def _table(self, name: str) -> str:
        digest = hashlib.md5(self.path(name).encode()).hexdigest()[:16]
        return f"{PACKAGE}_{re.sub(r'[^0-9a-z]', '_', name.lower())}_{digest}"


def bucket_count(spark: SparkSession, n_bytes: int, per_bucket: int = 64 << 20) -> int:
    """Buckets for a table of ``n_bytes``: at least the cluster's cores, and no more
    than Spark allows."""
    wanted = max(spark.sparkContext.defaultParallelism, -(-n_bytes // per_bucket))
    return min(wanted, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
