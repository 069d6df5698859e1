"""Prompts for an answering model, built from the hits of each question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import keep_matching

INSTRUCTION = (
    "Answer from the numbered passages below and from nothing else. "
    "If they do not hold the answer, say so.\n\n%s"
)


def with_texts(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with the texts of their documents.

    Few distinct documents are picked out by a broadcast of their ids, so the texts of
    the rest of the corpus are never shuffled. Stage or settle ``hits`` first.
    """
    return hits.join(keep_matching(documents, hits, "doc_id"), "doc_id")


def build_context(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Numbered texts of the hits in rank order, each followed by a blank line.

    ``documents`` has ``doc_id, text``. A question has at most k hits, so its list is
    small.
    """
    numbered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    lines = F.transform(
        numbered, lambda h: F.concat(F.lit("["), h["rank"], F.lit("] "), h["text"], F.lit("\n\n"))
    )
    return (
        with_texts(hits.select("query_id", "rank", "doc_id"), documents)
        .groupBy("query_id")
        .agg(F.array_join(lines, "").alias("context"))
    )


def build_prompts(
    contexts: DataFrame, questions: DataFrame, instruction: str = INSTRUCTION
) -> DataFrame:
    """System and user message per question; ``questions`` has ``query_id, text``."""
    before, after = instruction.split("%s")
    system = F.concat(F.lit(before), "context", F.lit(after))
    return questions.join(contexts, "query_id").select(
        "query_id",
        F.array(
            F.struct(F.lit("system").alias("role"), system.alias("content")),
            F.struct(F.lit("user").alias("role"), F.col("text").alias("content")),
        ).alias("messages"),
    )
