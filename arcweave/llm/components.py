"""Connected components of an edge table by alternating large and small stars, with each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (a, b); component: the smallest node that is reached. Hubs are reduced to the least
    neighbour by aggregation, never gathered."""
    now = materialize(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v > u").distinct(), "edges")
    sign = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
    was = sign(now)
    for _ in range(most_rounds):
        if not was[0]:
            break
        both = now.union(now.select("u", "v")).toDF("x", "y")  # large star: each node's greater neighbours link to its least one
        least = both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))  # small star: a node and its lesser neighbours link to the least one
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.toDF("v", "u")).filter("v > u").distinct()
        now = materialize(small, "edges")
        new = sign(now)
        if new == was:
            break
        was = new
    else:
        raise RuntimeError("components did not settle")
    return now.toDF("node", "component").union(now.select("u", "u")).distinct()
