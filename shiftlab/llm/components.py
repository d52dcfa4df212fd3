"""Connected components of an edge table by alternating large-star and small-star steps.

Each round is a few aggregations and equi-joins; labels, edges and components stay
distributed, only a count and a checksum of the edges reach the driver. After the last
round every node but a component's smallest one has exactly one edge, to that smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (id, component) for every node that has an edge and isn't the smallest of its component.

    Nodes are longs. Self-loops, repeated edges and edges with a NULL end are ignored; an
    empty edge table gives no rows. Nodes that are missing from the result are their own component.
    """
    u, v = F.col(f"`{a}`"), F.col(f"`{b}`")
    e = cut(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        n, total = e.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == 0 or (n, total) == before:
            break
        before = (n, total)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
