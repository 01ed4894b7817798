"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlake.llm.store import staged


def _smallest(edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Each u's smallest neighbour m, itself included, and edges joined with it (a frequent u is split by the join)."""
    least = staged(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), name)
    return least, edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of the undirected edges (u, v: long), the smallest node it is linked with.

    A large star links every larger neighbour of a node with the smallest one, a small star the smaller ones; in a
    number of rounds logarithmic in the longest path only stars are left. Edges from a node to itself and repeated
    edges do not matter; no edges give no rows. Each round is staged, and the driver sees two numbers of it."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    now, before = staged(now, "edges"), None
    while True:
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        _, both = _smallest(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "large")
        large = staged(both.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least, own = _smallest(large, "small")
        small = own.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
