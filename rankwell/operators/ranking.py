"""The ranking shape shared by all retrievers, and operators on it.

A ranking has the columns ``query_id, rank, doc_id, score``. Scores are rounded before
they are compared; equal scores rank the smaller document id first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANKING = ["query_id", "rank", "doc_id", "score"]


# Parts a group is cut into where Spark does not limit it before the shuffle.
_PARTS = 64


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Best ``k`` rows per group, ranked from 1.

    Spark limits each group to ``k`` rows before the shuffle, so a group receives at
    most ``k`` rows per task however many it has. Above its threshold for ``k`` that
    limit is off; there the rows are first ranked in parts of each group.
    """
    threshold = scored.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    if k > int(threshold):
        part = F.pmod(F.xxhash64("doc_id"), F.lit(_PARTS))
        scored = _best(scored.withColumn("_part", part), k, (*by, "_part")).drop("_part")
    return _best(scored, k, by)


def _best(scored: DataFrame, k: int, by: tuple[str, ...]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranking(scored: DataFrame, k: int) -> DataFrame:
    return top_k(scored, k).select(*RANKING)


def pad_with_first(
    hits: DataFrame, questions: DataFrame, documents: DataFrame, k: int
) -> DataFrame:
    """Fill short result lists with zero-score documents in table order.

    A question with h hits needs k - h more, all found among the first k + h
    documents; so the first 2k ids serve every question. A question's list, at most k
    hits, is completed inside one row.
    """
    first_ids = [
        row.doc_id
        for row in documents.select("doc_id").orderBy("doc_id").limit(2 * k).collect()
    ]
    first = F.array(*[F.lit(i) for i in first_ids]).cast("array<bigint>")
    hit = F.struct("rank", "doc_id", "score")
    found = hits.groupBy("query_id").agg(F.collect_list(hit).alias("hits"))
    listed = questions.select("query_id").join(found, "query_id", "left").withColumn(
        "hits", F.coalesce("hits", F.array().cast("array<struct<rank:int,doc_id:bigint,score:double>>"))
    )
    h = F.size("hits")
    rest = F.slice(F.array_except(first, F.col("hits.doc_id")), F.lit(1), F.lit(k) - h)
    padding = F.transform(
        rest,
        lambda doc, i: F.struct(
            (h + i + 1).alias("rank"), doc.alias("doc_id"), F.lit(0.0).alias("score")
        ),
    )
    return listed.select("query_id", F.inline(F.concat("hits", padding)))
