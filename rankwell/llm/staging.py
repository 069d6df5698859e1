"""Tables written once in the shared folder, and the small helpers every operator uses."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..sources.workspace import shared_root


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application.

    Tasks import it there, so that what its cached functions keep (models, tables of
    powers) outlives a task.
    """
    context = spark.sparkContext
    if getattr(context, "_rankwell_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, str(path.relative_to(root.parent)))
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/llm/rankwell-{uuid.uuid4().hex}.zip")
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(held.getvalue()))
    stream.close()
    context.addPyFile(target.toString())
    context._rankwell_shipped = True


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: a lost executor costs the tasks it ran, never an earlier stage, and
    what several later steps use is computed once.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_root(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held._staged_at = path
    return held


def discard(*held: DataFrame) -> None:
    """Remove staged tables once all that came from them is written itself."""
    for df in held:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
