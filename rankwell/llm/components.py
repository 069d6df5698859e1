"""Connected components of a table of links, as a loop of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged

MAX_ROUNDS = 100


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _stars(links: DataFrame) -> DataFrame:
    """Large star, then small star: each node moves to the least node it sees.

    Only minima per node and a join back to the links are needed, so a hub of any degree
    is pre-aggregated and its join can be split.
    """
    ways = _both_ways(links)
    least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = ways.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    large = large.where("a != b").distinct()
    # Every link of ``large`` runs from a to a smaller b.
    down = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.where("a != b").unionAll(down.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root``: for each node of ``links (a, b)`` the least node it is joined with."""
    now = staged(links.where("a != b").select("a", "b").distinct(), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 31))).first()
        if state == before:
            # Stars: every node points at its root.
            roots = now.select(F.col("b").alias("node")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                roots.select("node", F.col("node").alias("root"))
            )
        before = state
        now = staged(_stars(now), "stars")
    raise RuntimeError("the components did not settle")
