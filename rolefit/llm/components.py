"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a group-by and a join; edges stay distributed, and each round's
edges are written to the shared folder.  After some log(n) rounds every edge
points from a node to the smallest node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm.shared import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (smallest node of its component) for every node of an edge; self-loops and nulls are ignored."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col("u") != F.col("v")).distinct()
    e = written(e, "edges")
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        e = written(_small_star(_large_star(e)), "edges")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour (itself included)."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    out = e.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.union(least.select("u", F.col("m").alias("v"))).distinct()
