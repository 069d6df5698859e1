"""Reading and writing corpora, and the keyed sinks built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import Snapshots
from .workspace import is_complete

# Declared types of the stored tables; JSON is never read by inference.
CORPUS_SCHEMA = "id string, question string, documents array<string>, dataset_name string"
TOKENIZED_SCHEMA = (
    "id long, original_id string, dataset_name string, question string, "
    "chunk array<string>, tokenized_chunk array<string>"
)
VECTOR_SCHEMA = (
    "id long, original_id string, dataset_name string, question string, "
    "chunk array<string>, model string, embedding array<float>"
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def union_splits(splits: dict[str, DataFrame], column: str = "split") -> DataFrame:
    """Stack named splits by column name and keep each row's split."""
    return reduce(
        DataFrame.unionByName,
        [df.withColumn(column, F.lit(name)) for name, df in splits.items()],
    )


def write_jsonl(df: DataFrame, path: str) -> None:
    """Replace the JSON Lines table at ``path``."""
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def first_rows(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row for each value of ``keys`` (nulls are equal): the first by ``order``.

    Rows that agree in that too, or all of them without ``order``, are settled by a hash of
    the whole row, so the choice does not depend on partitions.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    place = F.struct(*([F.col(order)] if order else []), F.xxhash64(*df.columns))
    chosen = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), place).alias("_row"))
    return chosen.select(*keys, "_row.*").select(*df.columns)


def append_new_rows(spark: SparkSession, rows: DataFrame, path: str, key: str, order: str | None = None) -> None:
    """Append the rows whose ``key`` the Parquet table at ``path`` does not hold yet.

    A repeated run adds nothing, and of rows that share a key the first by ``order`` goes
    in; a null key is a key. Only the key column of the table is read.
    """
    rows = first_rows(rows, [key], order)
    if is_complete(spark, path):
        present = spark.read.schema(rows.select(key).schema).parquet(path)
        present = present.select(F.col(key).alias("_present"))
        rows = rows.join(present, F.col(key).eqNullSafe(F.col("_present")), "left_anti")
    rows.write.mode("append").parquet(path)


def missing_vectors(store: DataFrame, wanted: DataFrame, model: str) -> DataFrame:
    """Rows of ``wanted`` that have no vector of ``model`` in the store."""
    have = store.where(F.col("model") == model).select("original_id")
    return wanted.join(have, "original_id", "left_anti")


def upsert_vectors(store: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """Store plus the incoming ``(original_id, model)`` vectors it lacks.

    A vector already present is never replaced, and of incoming repeats the first by
    ``order`` goes in. Both keys are compared at once, so no single model or id gathers in
    one task.
    """
    return store.unionByName(_lacking(store, incoming, order))


def _lacking(store: DataFrame | None, incoming: DataFrame, order: str | None) -> DataFrame:
    keys = ["original_id", "model"]
    new = first_rows(incoming, keys, order)
    return new if store is None else new.join(store.select(*keys), keys, "left_anti").select(*new.columns)


def write_upsert(spark: SparkSession, incoming: DataFrame, path: str, order: str | None = None) -> DataFrame:
    """:func:`upsert_vectors` into the table of snapshots at ``path``.

    Only the vectors it lacks are written, as one part more; they are seen once the
    manifest that names the part is put. A run that fails before leaves the table as it was.
    """
    table = Snapshots(spark, path)
    new = _lacking(table.read("vectors"), incoming, order)
    table.append("vectors", new)
    return table.read("vectors")


def vectors_of(store: DataFrame, model: str) -> DataFrame:
    """Vectors of one model; a partition filter when the store is split by model."""
    return store.where(F.col("model") == model)


def question_answer_pairs(conversations: DataFrame) -> DataFrame:
    """Corpus rows made from conversations: a user turn and the assistant's reply.

    Joined on ``(conv_id, turn)``, which is unique per row, so a very long
    conversation spreads over all tasks.
    """
    asked = conversations.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question")
    )
    reply = conversations.where(F.col("role") == "assistant").select(
        "conv_id",
        (F.col("turn") - 1).alias("turn"),
        F.array("text").alias("documents"),
    )
    return asked.join(reply, ["conv_id", "turn"]).select(
        F.format_string("%019d-%019d", "conv_id", "turn").alias("id"),
        "question",
        "documents",
        F.lit("conversations").alias("dataset_name"),
    )


def file_bytes(df: DataFrame) -> int:
    """Size of the tables a plan reads, without a scan; 0 where it is not known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    unknown = int(df.sparkSession.conf.get("spark.sql.defaultSizeInBytes", str((1 << 63) - 1)))
    total = 0
    while leaves.hasNext():
        total += int(str(leaves.next().stats().sizeInBytes()))
    return total if total < unknown else 0


def text_bytes(df: DataFrame, text: Column) -> int:
    """Size of the tables behind a text column, for choosing a number of buckets.

    Taken from the files that the plan reads; tables of unknown size (rows made by the
    driver) are summed up.
    """
    return file_bytes(df) or df.agg(F.sum(F.octet_length(text))).first()[0] or 0
