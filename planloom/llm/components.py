"""Connected components of a table of links, by alternating large and small stars.

Each round links every node's larger neighbours to the node's smallest neighbour, then its smaller
ones, until no link changes; every node is then linked to the smallest node of its component. Links and
labels stay in tables. The minimum of a node's neighbours is combined on the map side and stored, so that
the joins that follow have plain shuffles on both sides, one with one row per node: adaptive execution
splits a node with many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import stored


def _summary(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a") % 1_000_003)).first())


def components(links: DataFrame) -> DataFrame:
    """For links ``a, b``: ``node, root`` for each node that is not the smallest of its component."""
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links)
    before = _summary(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.join(stored(least), "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = stored(large)
        least = stored(large.groupBy("a").agg(F.min("b").alias("least")))
        small = large.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        links = stored(small.unionByName(least.select("a", F.col("least").alias("b"))).distinct())
        after = _summary(links)
        if after == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
