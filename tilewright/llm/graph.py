"""Connected components of an edge table, without collecting it.

Alternating star steps: a large-star step ties every larger neighbour of a
vertex to the smallest vertex of its neighbourhood; a small-star step does so
for the smaller neighbours and the vertex itself. Both are an aggregation and a
join on the vertex, so no neighbourhood is gathered in one place. They stop
when the edges do not change, after a number of rounds that grows with the
logarithm of the number of vertices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MAX_ROUNDS = 60


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """From edges (a long, b long): v long, root long (the component's smallest vertex) for every vertex."""
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.save(e)
    seen = None
    for _ in range(MAX_ROUNDS):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.save(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch.save(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        scratch.drop(large)
        scratch.drop(e)
        e = new
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    out = e.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return out.union(e.select("b", "b").distinct())
