"""Connected components of an edge table, by alternating large-star and small-star rounds; no node's neighbours are ever collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm._common import stored

MOST_ROUNDS = 60  # the rounds grow as the logarithm of the longest path; this many would be a mistake


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for the nodes of edges (a, b: longs); nodes without an edge to another node have no row."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = stored(edges, "edges"), None
    for _ in range(MOST_ROUNDS):
        state = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if state == before or not state.n:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # large star: every larger neighbour of a node is tied to the least one
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour, and the node itself, is tied to the least one
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
    raise RuntimeError("components did not settle")
