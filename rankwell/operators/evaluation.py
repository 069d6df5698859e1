"""Retrieval quality: rank of the first relevant hit, success@k and MRR@k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import rounded


def relevant_by_pairs(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """Hits that are among the true ``(query_id, doc_id)`` pairs."""
    return hits.join(truth, ["query_id", "doc_id"], "left_semi")


def relevant_by_label(
    hits: DataFrame, question_labels: DataFrame, document_labels: DataFrame
) -> DataFrame:
    """Hits whose document carries the question's label.

    Two lookups by id; the pairs of equal label are never listed.
    """
    return (
        hits.join(document_labels.select("doc_id", F.col("label").alias("_d")), "doc_id")
        .join(question_labels.select("query_id", F.col("label").alias("_q")), "query_id")
        .where(F.col("_d") == F.col("_q"))
        .drop("_d", "_q")
    )


def truth_rank(
    questions: DataFrame, relevant: DataFrame, groups: tuple[str, ...] = ()
) -> DataFrame:
    """Rank of the first relevant hit per question, null for a miss.

    With ``groups`` (mode, number of clusters, ...), ``questions`` must already hold
    every combination, so that a miss shows up in each.
    """
    keys = [*groups, "query_id"]
    first = relevant.groupBy(*keys).agg(F.min("rank").alias("rank"))
    return questions.select(*keys).join(first, keys, "left")


def success(rank: Column, k: Column) -> Column:
    return F.avg(F.when(rank <= k, 1.0).otherwise(0.0))


def reciprocal_rank(rank: Column, k: Column) -> Column:
    return F.avg(F.when(rank <= k, 1.0 / rank).otherwise(0.0))


def report(
    ranks: DataFrame, ks: tuple[int, ...], groups: tuple[str, ...] = ()
) -> DataFrame:
    """success@k and MRR@k for several k from rankings made once for the largest."""
    swept = ranks.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return swept.groupBy(*groups, "k").agg(
        F.count("*").alias("n_questions"),
        rounded(success(F.col("rank"), F.col("k"))).alias("success"),
        rounded(reciprocal_rank(F.col("rank"), F.col("k"))).alias("mrr"),
    )


def expand(df: DataFrame, column: str, values: tuple) -> DataFrame:
    """One copy of each row per value: the grid of an experiment."""
    return df.withColumn(column, F.explode(F.array(*[F.lit(v) for v in values])))
