"""Connected components of a graph whose nodes are numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwright.llm.common import settle


def connected_components(edges: DataFrame) -> DataFrame:
    """The smallest node reachable from each node of an edge: columns node, root.

    ``edges`` has columns a and b, in any direction, repeats allowed; nodes without an edge to another
    node don't appear. Alternating large-star and small-star steps keep the edge set no larger than the
    input and need a few rounds even for long chains. Every round is written to the checkpoint folder.
    A node with many edges is never gathered: its smallest neighbour is an aggregate, and the join back
    has one row per node on the other side.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    pairs, before = settle(pairs), None
    while True:
        now = _fingerprint(pairs)
        if now == before:
            break
        before = now
        pairs = settle(_small_star(_large_star(pairs)))
    roots = pairs.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _fingerprint(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(v as decimal(38)))")).first())


def _large_star(pairs: DataFrame) -> DataFrame:
    """Connect each node's larger neighbours to the smallest node around it."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = both.where("v > u").join(least, "u")
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Connect each node's smaller neighbours, and the node, to the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    smaller = pairs.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return smaller.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
