"""Agreement of several clusterings of one cube."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions.geo import ang2pix, auto_nside, pix2ang
from .graph import connected_components, grid_edges, knn_edges
from .masks import top_clusters
from .select import transition_time

# Fixed value: the published name of the column, spelled as it is there.
RATE = "cluster_occurence_rate"

def stacked(maps: dict[str, DataFrame]) -> DataFrame:
    """(map, cell_id, t_idx, cluster) of named label tables."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("map"), "cell_id", "t_idx", "cluster") for name, df in maps.items()])


def occurrence_rate(maps: dict[str, DataFrame], cells: DataFrame) -> DataFrame:
    """(cell_id, cluster_occurence_rate): the share of maps in which a cell is ever in a cluster."""
    n = stacked(maps).where("cluster >= 0").groupBy("cell_id").agg((F.countDistinct("map") / F.lit(len(maps))).alias("rate"))
    return cells.select("cell_id").join(n, "cell_id", "left").select("cell_id", F.coalesce("rate", F.lit(0.0)).alias(RATE))


def jaccard_consistency(maps: dict[str, DataFrame], cells: DataFrame) -> DataFrame:
    """(cell_id, consistency): the mean Jaccard similarity, over pairs of maps, of the footprints of the (largest) labels that a cell has; NULL without two maps that label it."""
    s = stacked(maps).where("cluster >= 0")
    last = s.groupBy("map", "cell_id").agg(F.max("cluster").alias("cluster"))
    size = last.groupBy("map", "cluster").agg(F.count(F.lit(1)).alias("n"))
    a, b = (last.select(F.col("map").alias(f"m{i}"), "cell_id", F.col("cluster").alias(f"c{i}")) for i in (1, 2))
    pairs = a.join(b, "cell_id").where("m1 < m2")
    shared = pairs.groupBy("m1", "c1", "m2", "c2").agg(F.count(F.lit(1)).alias("shared"))
    for i in (1, 2):
        shared = shared.join(size.withColumnsRenamed({"map": f"m{i}", "cluster": f"c{i}", "n": f"n{i}"}), [f"m{i}", f"c{i}"])
    j = shared.select("m1", "c1", "m2", "c2", (F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared"))).alias("j"))
    mean = pairs.join(j, ["m1", "c1", "m2", "c2"]).groupBy("cell_id").agg(F.avg("j").alias("consistency"))
    return cells.select("cell_id").join(mean, "cell_id", "left")


def votes(maps: dict[str, DataFrame], edges: DataFrame, node_of: DataFrame | None = None, union: bool = False, top_n: int | None = None) -> DataFrame:
    """(src, dst, w): of the candidate edges the share of the maps with clusters in which both ends are in the same cluster's footprint (with `union`, in any's).

    `node_of` (cell_id, node) maps cells to the graph's nodes.
    """
    counted = {name: (top_clusters(df, top_n) if top_n else df.where("cluster >= 0")) for name, df in maps.items()}
    s = cut(stacked(counted).select("map", "cell_id", F.lit(0).alias("cluster") if union else "cluster").distinct())
    if node_of is not None:
        s = s.join(node_of, "cell_id").select("map", F.col("node"), "cluster").distinct()
    else:
        s = s.withColumnRenamed("cell_id", "node")
    n = s.select("map").distinct().count()
    held = edges.join(s.withColumnRenamed("node", "src"), "src").join(s.withColumnRenamed("node", "dst"), ["dst", "map", "cluster"], "left_semi").select("map", "src", "dst").distinct()
    return held.groupBy("src", "dst").agg((F.count(F.lit(1)) / F.lit(max(1, n))).alias("w"))


def consensus(maps: dict[str, DataFrame], cells: DataFrame, grid_kind: str = "native", min_consensus: float = 0.75, top_n_clusters: int | None = None, neighbor_connectivity: int = 8, k_neighbors: int = 8, nside: int | None = None) -> DataFrame:
    """(cell_id, cluster, consistency) of all cells: components of the edges that enough maps agree on, by size, -1 where there are none; consistency is the mean share of a node's kept edges."""
    node_of = None
    if grid_kind == "native":
        edges = grid_edges(cells, neighbor_connectivity)
    elif grid_kind == "irregular":
        edges = knn_edges(cells.select(F.col("cell_id").alias("node"), "lat", "lon"), k_neighbors)
    else:
        size = nside or auto_nside(cells.count())
        node_of = cut(cells.select("cell_id", ang2pix(size, F.col("lat"), F.col("lon")).alias("node")))
        lat, lon = pix2ang(size, F.col("node"))
        edges = knn_edges(node_of.select("node").distinct().select("node", lat.alias("lat"), lon.alias("lon")), k_neighbors)
    kept = cut(votes(maps, edges, node_of, node_of is not None, top_n_clusters).where((F.col("w") >= min_consensus) & (F.col("w") > 0)))
    comps = connected_components(kept)
    both = kept.select(F.col("src").alias("node"), "w").unionByName(kept.select(F.col("dst").alias("node"), "w"))
    mean = both.groupBy("node").agg(F.avg("w").alias("consistency"))
    nodes = comps.join(mean, "node")
    own = cells.select("cell_id", F.col("cell_id").alias("node")) if node_of is None else node_of
    placed = own.join(nodes, "node", "left")
    sizes = placed.where("component is not null").groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    rank = sizes.select("component", (F.row_number().over(Window.orderBy(F.desc("n"), "component")) - 1).cast("int").alias("cluster"))
    return placed.join(rank, "component", "left").select("cell_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("consistency", F.lit(0.0)).alias("consistency"))


def consensus_summary(found: DataFrame, cells: DataFrame, shifts: dict[str, DataFrame], times: DataFrame, threshold: float = 0.0) -> DataFrame:
    """One row for each consensus cluster: mean consistency, size, mean place, and the mean and spread over maps (`shifts`: the shift table of each) of the mean and spread over cells of shift times."""
    own = found.where("cluster >= 0")
    base = own.join(cells.select("cell_id", "y", "x"), "cell_id").groupBy("cluster").agg(F.avg("consistency").alias("mean_consistency"), F.count(F.lit(1)).alias("size"), F.avg("y").alias("mean_y"), F.avg("x").alias("mean_x"))
    t = reduce(DataFrame.unionByName, [transition_time(s, times, threshold).select(F.lit(name).alias("map"), "cell_id", "t") for name, s in shifts.items()])
    per = own.join(t, "cell_id").groupBy("cluster", "map").agg(F.avg("t").alias("m"), F.stddev_pop("t").alias("s"))
    over = per.groupBy("cluster").agg(F.avg("m").alias("mean_mean_shift_time"), F.coalesce(F.stddev_pop("m"), F.lit(0.0)).alias("std_mean_shift_time"), F.coalesce(F.avg("s"), F.lit(0.0)).alias("mean_std_shift_time"), F.coalesce(F.stddev_pop("s"), F.lit(0.0)).alias("std_std_shift_time"))
    return base.join(over, "cluster", "left")
