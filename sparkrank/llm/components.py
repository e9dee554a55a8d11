"""Connected components of a graph whose edges are a DataFrame, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrank.llm.shared import join_hot, written


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a long, b long); the component is its least node.

    Each round replaces a node's edges by edges to the least node it knows, so stars of any size
    shrink in a number of rounds that grows with the logarithm of a component's diameter. The
    least neighbour comes from a partial aggregation, never from a collected list.
    """
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _fingerprint(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("degree")), "least")
        # large star: every larger neighbour of a node goes to the least one around it
        large = join_hot(edges.select(F.col("b").alias("a"), F.col("a").alias("v")), least, ["a"], "degree").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour, and the node itself, goes to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        edges = written(small, "edges")
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
