"""Connected components of links, by alternating large and small stars.

Links are rewritten until every node is linked to its component's smallest node alone.
Each round is a minimum per node, combined on the map side and written, and a join with
it: broadcast if its count allows, else shuffled on plain rows, so that Spark can split
the links of a node that has many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written


def _large(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of it and its neighbours."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.join(small(written(low, "lowest")), "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    return out.where(F.col("a") != F.col("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them. Links have a < b."""
    low = written(links.groupBy("b").agg(F.min("a").alias("m")), "lowest")
    joined = links.join(small(low), "b")
    out = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).unionAll(low.select(F.col("m").alias("a"), F.col("b").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for each node of links (columns a, b): root is its component's smallest node.

    Links may repeat, in either direction; links of a node to itself are dropped, and a
    node that has no other doesn't appear.
    """
    now = links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = written(now, "links")
    state = _state(now)
    while True:
        large = written(_large(now), "links")
        before, state = state, _state(large)
        # Nothing moved and each node hangs on one other: these are stars.
        if state == before and state[0] == state[2]:
            return large.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(large.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        now = written(_small(large), "links")
        state = _state(now)


def _state(links: DataFrame) -> tuple:
    """Rows, a checksum, and how many different b."""
    each = links.groupBy("b").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    none = F.lit(0)
    return tuple(each.agg(F.coalesce(F.sum("n"), none), F.coalesce(F.sum("h"), none), F.count("*")).first())
