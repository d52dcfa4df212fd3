"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; a component is named by its smallest node.

    Large-star and small-star steps by turns; edges stay distributed, their number and checksum
    tell when they have settled.
    """
    a, b = F.col(src), F.col(dst)
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    before = None
    for _ in range(max_rounds):
        state = tuple(e.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state[0] == 0 or state == before:
            break
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def grid_edges(cells: DataFrame, connectivity: int = 8) -> DataFrame:
    """(src, dst), src < dst: neighbouring cells (cell_id, y_idx, x_idx) of a grid, without wrapping, by equi-joins on shifted indices."""
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    shifts = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps])).alias("d")
    moved = cells.select("cell_id", "y_idx", "x_idx", shifts).select(F.col("cell_id").alias("a"), (F.col("y_idx") + F.col("d.dy")).alias("y_idx"), (F.col("x_idx") + F.col("d.dx")).alias("x_idx"))
    return moved.join(cells.select("cell_id", "y_idx", "x_idx"), ["y_idx", "x_idx"]).select(F.least("a", "cell_id").alias("src"), F.greatest("a", "cell_id").alias("dst"))


def knn_edges(points: DataFrame, k: int = 8, block: int = 2000) -> DataFrame:
    """(src, dst), src < dst where dst is among the k nearest of src on the unit sphere: points (node, lat, lon).

    Points meet only in latitude bands: first one band and its neighbours are searched. A point whose k-th
    neighbour there is farther than the searched bands reach is searched again in twice as many, until there are no more. Ties go to the smaller node.
    """
    from ..functions.geo import unit_sphere

    n = points.count()
    bands = max(1, int((n / block) ** 0.5 * 2))
    height = 180.0 / bands
    p = points.select("node", *[c.alias(x) for c, x in zip(unit_sphere(F.col("lat"), F.col("lon")), "xyz")], F.least(F.floor((F.col("lat") + 90) / height), F.lit(bands - 1)).cast("int").alias("band"), "lat")

    def ranked(pairs: DataFrame) -> DataFrame:
        d = sum((F.col(c) - F.col("o" + c)) * (F.col(c) - F.col("o" + c)) for c in "xyz")
        w = Window.partitionBy("node").orderBy("d", "other")
        return pairs.where("node != other").withColumn("d", d).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)

    kept, left, reach = None, p, 1
    while True:
        near = p.select(F.explode(F.sequence(F.greatest(F.lit(0), F.col("band") - reach), F.least(F.lit(bands - 1), F.col("band") + reach))).alias("band"), F.col("node").alias("other"), *[F.col(c).alias("o" + c) for c in "xyz"])
        found = ranked(left.join(near, "band"))
        if reach >= bands:
            sure = left.select("node")
        else:  # the searched bands reach at least to the near edge of the outer ones
            low = F.when(F.col("band") - reach <= 0, 1e9).otherwise(F.col("lat") + 90 - (F.col("band") - reach) * height)
            high = F.when(F.col("band") + reach >= bands - 1, 1e9).otherwise((F.col("band") + reach + 1) * height - 90 - F.col("lat"))
            chord = F.when(F.least(low, high) > 179, F.lit(9.0)).otherwise(2 * F.sin(F.radians(F.least(low, high)) / 2))
            far = found.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max("d")).alias("far"))
            sure = far.join(left.select("node", chord.alias("chord")), "node").where((F.col("n") == k) & (F.col("far") <= F.col("chord"))).select("node")
        own = cut(found.join(sure, "node", "left_semi").select("node", "other"))
        kept = own if kept is None else kept.unionByName(own)
        left = cut(left.join(own.select("node").distinct(), "node", "left_anti"))
        if reach >= bands or left.isEmpty():
            break
        reach *= 2
    return kept.where("node < other").select(F.col("node").alias("src"), F.col("other").alias("dst"))
