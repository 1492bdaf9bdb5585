"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from creel.llm import scratch


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Node and the smallest node it is connected with, for every node that has an edge.

    Alternates large and small stars: each node's larger neighbours, then its smaller
    ones, are hung on the smallest neighbour, until nothing changes. Every step is an
    aggregation and a join, written to the shared folder; no group is collected. An
    edge from a node to itself says nothing.
    """
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    now = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    state = None
    while True:
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.written(small.union(root).distinct())
        was, state = state, now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == was:
            break
    roots = now.groupBy("u").agg(F.min("v").alias("component"))
    return roots.union(now.select("v", "v").distinct()).toDF("node", "component").groupBy("node").agg(F.min("component").alias("component"))
