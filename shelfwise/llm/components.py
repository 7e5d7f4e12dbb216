"""Connected components of a link table by alternating large-star and small-star steps.

Nodes are of any orderable type. Each step is a partial aggregate and a join over the links; the links are written to
the shared folder between rounds, so neither links nor components ever meet on the driver. The number of rounds grows
with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import Scratch


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    both = _both_ways(links)
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = both.filter(F.col("b") > F.col("a"))
    return larger.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    least = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = down.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a != b").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(``node``, ``root``) of every node of the links (``a``, ``b``) but the roots; a root is its component's least node."""

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    current = scratch.store(_small_star(links))
    before = state(current)
    while True:
        following = scratch.store(_small_star(_large_star(current)))
        after = state(following)
        scratch.drop(current)
        current = following
        if after == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
