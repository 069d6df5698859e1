"""Questions that arrive over time, answered in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import scratch


def read_questions(
    spark: SparkSession,
    folder: str,
    schema: str,
    files_per_batch: int = 1000,
    kind: str = "parquet",
) -> DataFrame:
    """Stream of the question files that land in ``folder`` (``parquet`` or ``json``)."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .format(kind)
        .load(folder)
    )


def answer_stream(
    questions: DataFrame,
    retrieve: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Answer each micro-batch with a batch retriever and store its ranking.

    A batch owns one partition of the sink and replaces it, so a batch replayed after
    a failure does not show up twice; what a batch settles on the way goes with it.
    ``trigger``: arguments of ``DataStreamWriter.trigger``; by default the query works off
    what has arrived, then stops.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # a retriever reads its questions more than once
        with scratch(batch.sparkSession):
            retrieve(batch).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        batch.unpersist()

    return (
        questions.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
