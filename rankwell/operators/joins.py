"""Joins whose plan follows a checked size."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import PACKAGE, shared_root

MAX_BROADCAST_KEYS = 1_000_000
_open = threading.local()


def fits(rows: DataFrame, limit: int) -> bool:
    """Whether ``rows`` has at most ``limit`` rows; never counts further."""
    return rows.limit(limit + 1).count() <= limit


def settle(df: DataFrame, only: bool = False) -> DataFrame:
    """Compute once a result that several parts of a plan use.

    A table in the shared folder: later jobs, and executors that take over lost work,
    read it back instead of running the plan again. Inside :func:`scratch` it goes at the
    end; otherwise it stays as long as the folder. With ``only``, what the same scratch
    has settled before goes as soon as this is written.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{PACKAGE}/{spark.sparkContext.applicationId}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if getattr(_open, "paths", None) is not None:
        while only and _open.paths:
            _delete(spark, _open.paths.pop())
        _open.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle_alone(df: DataFrame) -> DataFrame:
    """:func:`settle` for one of many results that are computed one after the other: its
    shuffle files go at once, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return settle(df)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)


def is_stored(df: DataFrame) -> bool:
    """Whether ``df`` only picks columns and rows of one stored table.

    Reading it again costs a scan, so there is nothing to settle.
    """
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    return node.nodeName().startswith("Relation") or node.nodeName() == "LogicalRelation"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is settled inside is deleted at the end; write the results before that."""
    before = getattr(_open, "paths", None)
    _open.paths = []
    try:
        yield
    finally:
        for path in _open.paths:
            _delete(spark, path)
        _open.paths = before


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def keep_matching(
    big: DataFrame, keys: DataFrame, key: str, max_broadcast: int = MAX_BROADCAST_KEYS
) -> DataFrame:
    """Rows of ``big`` whose ``key`` is among ``keys``, before a join that shuffles.

    When the distinct keys are few, they filter the scan of ``big`` as a broadcast;
    else ``big`` stays as it is, since the join that follows drops the other rows.
    """
    wanted = keys.select(key).distinct()
    if fits(wanted, max_broadcast):
        return big.join(F.broadcast(wanted), key, "left_semi")
    return big
