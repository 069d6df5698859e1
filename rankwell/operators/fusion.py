"""Weighted reciprocal rank fusion (Cormack, Clarke, Buettcher, SIGIR 2009).

:func:`fuse` adds up rankings as they are. :func:`fuse_complete` gives the best of the
fusion of *complete* lists and reads only their tops, as the threshold algorithm of Fagin,
Lotem and Naor does: a document that no list has among its first ``depth`` earns less than
the k-th best surely has, and the few that are left get their exact places counted.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import rounded
from . import lexical, neighbours
from .joins import settle
from .ranking import ranking

RRF_CONSTANT = 60
DIGITS = 9
# Scores this near may be equal once rounded; a tie goes to the smaller id.
_TIE = 2.0 * 10.0**-DIGITS


@dataclass(frozen=True)
class Ranked:
    """A complete list for every question, read only as far as it is needed."""

    top: Callable[[int], DataFrame]
    """The first n places of every list, as a ranking."""
    places: Callable[[DataFrame], DataFrame]
    """``query_id, doc_id, rank`` of given pairs; pairs outside the list have no row."""


def cosine_list(corpus: DataFrame, questions: DataFrame, **options: object) -> Ranked:
    one = F.lit(0)
    return routed_list(corpus.withColumn("cluster", one), questions.withColumn("cluster", one), **options)


def routed_list(corpus: DataFrame, routed: DataFrame, **options: object) -> Ranked:
    """Documents of each question's clusters."""
    return Ranked(
        lambda n: neighbours.routed_topk(corpus, routed, n, **options),
        lambda wanted: neighbours.places(corpus, routed, wanted, **options),
    )


def bm25_list(index: lexical.LexicalIndex, weighted: DataFrame) -> Ranked:
    """Documents that share a term with the question, never zero-score fillers."""
    return Ranked(
        lambda n: lexical.best_documents(index, weighted, n),
        lambda wanted: lexical.places(index, weighted, wanted),
    )


def fuse(
    rankings: dict[str, DataFrame], k: int, weights: dict[str, float] | None = None
) -> DataFrame:
    """Fuse named rankings: sum of ``weight / (60 + rank)``; weights default to 1."""
    weights = weights or {}
    parts = [
        df.select(
            "query_id",
            "doc_id",
            (F.lit(float(weights.get(name, 1.0))) / (F.col("rank") + RRF_CONSTANT)).alias("part"),
        )
        for name, df in rankings.items()
    ]
    return ranking(_summed(reduce(DataFrame.unionByName, parts)), k)


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("query_id", "doc_id").agg(rounded(F.sum("part"), DIGITS).alias("score"))


def sufficient_depth(weights: list[float], k: int) -> int:
    """Places of every list among which the whole top ``k`` of the fusion is found.

    Take the lists longer than ``depth``, the heaviest of them with weight w. Its first
    k documents have at least ``w / (60 + k)``. A document seen nowhere has less than
    the sum of these weights over ``61 + depth``. Whichever lists are the longer ones,
    that is less once ``depth`` follows the worst share of a sum in its largest weight.
    """
    depth, total = k, 0.0
    for weight in sorted(weights):
        total += weight
        sure = weight / (RRF_CONSTANT + k) - _TIE
        if sure <= 0:
            raise ValueError(f"a weight of {weight} is lost in the rounding of scores at k = {k}")
        depth = max(depth, math.floor(total / sure) - RRF_CONSTANT)
    return depth


def fuse_complete(
    lists: dict[str, Ranked], k: int, weights: dict[str, float] | None = None
) -> DataFrame:
    """Exact top ``k`` of the fusion of complete lists: as :func:`fuse` over all places.

    Weights are at least 0, and default to 1. A list with weight 0 earns nothing.
    """
    weight = {name: float((weights or {}).get(name, 1.0)) for name in lists}
    if min(weight.values()) < 0:
        raise ValueError("weights must not be negative")
    # Up to 31 lists: each has a bit of an integer.
    weight = {name: w for name, w in weight.items() if w > 0} or dict.fromkeys(lists, 1.0)
    depth = sufficient_depth(list(weight.values()), k)

    bit = {name: 1 << at for at, name in enumerate(weight)}

    def part(name: str, ranks: DataFrame) -> DataFrame:
        earned = F.lit(weight[name]) / (F.col("rank") + RRF_CONSTANT)
        return ranks.select("query_id", "doc_id", F.lit(bit[name]).alias("lists"), earned.alias("part"))

    seen = settle(
        reduce(DataFrame.unionByName, [part(name, lists[name].top(depth)) for name in weight])
    )
    # A list with fewer places has been read to its end and owes nothing more.
    longer = seen.groupBy("query_id").agg(
        reduce(
            lambda total, b: total + F.when(F.count(F.when(F.col("lists") == b, 1)) == depth, b).otherwise(0),
            bit.values(),
            F.lit(0),
        ).alias("longer")
    )
    known = seen.groupBy("query_id", "doc_id").agg(
        F.sum("part").alias("score"), F.bit_or("lists").alias("lists")
    )
    floors = ranking(known, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))

    def owes(name: str) -> Column:
        return F.col("owed").bitwiseAND(bit[name]) > 0

    at_most = reduce(
        lambda total, name: total
        + F.when(owes(name), weight[name] / (RRF_CONSTANT + 1 + depth)).otherwise(0.0),
        weight,
        F.col("score"),
    )
    open_ = settle(
        known.join(longer.join(floors, "query_id", "left"), "query_id")
        .withColumn("owed", F.col("longer").bitwiseAND(F.bitwise_not("lists")))
        .where(at_most >= F.coalesce("floor", F.lit(0.0)) - _TIE)
        .select("query_id", "doc_id", F.col("score").alias("part"), "owed")
    )
    parts = [open_.select("query_id", "doc_id", "part")]
    for name in weight:
        wanted = open_.where(owes(name)).select("query_id", "doc_id")
        parts.append(part(name, lists[name].places(wanted)).drop("lists"))
    return ranking(_summed(reduce(DataFrame.unionByName, parts)), k)
