"""Masks, counts and densities of cluster labels.

Labels are sparse: (cell_id, t_idx, cluster) of the selected points; all other points are -1. `cells` and `times` have all cells and all steps.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ids(ids: int | Iterable[int]) -> list[int]:
    return [int(ids)] if isinstance(ids, int) or not isinstance(ids, Iterable) else [int(i) for i in ids]


def is_equal_to(value: object, wanted: object) -> bool:
    """Whether a value, or the only one of a sequence, is the wanted one."""
    if isinstance(value, Iterable) and not isinstance(value, str):
        value = list(value)
        return len(value) == 1 and value[0] == wanted
    return value == wanted


def contains_value(values: object, wanted: object) -> bool:
    """Whether the wanted value is the value, or one of a sequence."""
    return wanted in list(values) if isinstance(values, Iterable) and not isinstance(values, str) else values == wanted


def existing_ids(labels: DataFrame, ids: int | Iterable[int]) -> list[int]:
    """Those of the ids that there are clusters of, in the order given; a warning names the others."""
    wanted = _ids(ids)
    there = {r[0] for r in labels.where(F.col("cluster").isin(wanted)).select("cluster").distinct().collect()}  # as many as were asked for at most
    if missing := [i for i in wanted if i not in there]:
        logging.getLogger("shiftlab").warning("no clusters %s", missing)
    return [i for i in wanted if i in there]


def dense(labels: DataFrame, cells: DataFrame, times: DataFrame) -> DataFrame:
    """(cell_id, t_idx, cluster) of every point, -1 where there is no label. As many rows as the cube has points."""
    every = cells.select("cell_id").crossJoin(F.broadcast(times.select("t_idx")))
    return every.join(labels, ["cell_id", "t_idx"], "left").select("cell_id", "t_idx", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def cluster_mask(labels: DataFrame, ids: int | Iterable[int]) -> DataFrame:
    """(cell_id, t_idx) in the clusters."""
    return labels.where(F.col("cluster").isin(_ids(ids))).select("cell_id", "t_idx")


def spatial_mask(labels: DataFrame, ids: int | Iterable[int]) -> DataFrame:
    """(cell_id) ever in the clusters."""
    return cluster_mask(labels, ids).select("cell_id").distinct()


def temporal_mask(labels: DataFrame, ids: int | Iterable[int]) -> DataFrame:
    """(t_idx) at which any cell is in the clusters."""
    return cluster_mask(labels, ids).select("t_idx").distinct()


def permanent_mask(labels: DataFrame, cluster: int, n_t: int) -> DataFrame:
    """(cell_id) in the cluster at every step."""
    return labels.where(F.col("cluster") == cluster).groupBy("cell_id").agg(F.countDistinct("t_idx").alias("n")).where(F.col("n") == n_t).select("cell_id")


def permanent_noise(labels: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell_id) never in any cluster, cells without values included."""
    return cells.select("cell_id").join(labels.where("cluster >= 0").select("cell_id").distinct(), "cell_id", "left_anti")


def apply_mask(grid: DataFrame, value: str, mask: DataFrame) -> DataFrame:
    """`grid` with `value` NULL outside of the mask, which has some of the columns cell_id and t_idx."""
    keys = [c for c in ("cell_id", "t_idx") if c in mask.columns]
    marked = grid.join(mask.select(*keys).distinct().withColumn("in_mask", F.lit(True)), keys, "left")
    return marked.select(*[F.when(F.col("in_mask"), F.col(c)).alias(c) if c == value else F.col(c) for c in grid.columns])


def keep_mask(grid: DataFrame, mask: DataFrame) -> DataFrame:
    """The rows of `grid` in the mask."""
    return grid.join(mask, [c for c in ("cell_id", "t_idx") if c in mask.columns], "left_semi")


def cluster_data(grid: DataFrame, labels: DataFrame, cells: DataFrame, ids: int | Iterable[int]) -> DataFrame:
    """The rows of `grid` in the clusters' points; for -1 those of cells that are noise throughout."""
    return keep_mask(grid, permanent_noise(labels, cells) if _ids(ids) == [-1] else cluster_mask(labels, ids))


def cluster_ids(labels: DataFrame) -> DataFrame:
    """The ids in ascending order, -1 first where there is noise among the selected points."""
    return labels.select("cluster").distinct().orderBy("cluster")


def cluster_counts(labels: DataFrame, n_points: int | None = None) -> DataFrame:
    """(cluster, n): points by cluster, largest first; with the cube's number of points, -1 counts all that are in none."""
    n = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    if n_points is not None:
        n = n.where("cluster >= 0").unionByName(labels.where("cluster >= 0").agg((F.lit(n_points) - F.count(F.lit(1))).alias("n")).select(F.lit(-1).alias("cluster"), "n").where("n > 0"))
    return n.orderBy(F.desc("n"), "cluster")


def active_clusters(labels: DataFrame, times: DataFrame, n_cells: int) -> DataFrame:
    """(t_idx, n): distinct labels at each step, -1 counting where any cell has no label."""
    own = labels.where("cluster >= 0").groupBy("t_idx").agg(F.countDistinct("cluster").alias("k"), F.countDistinct("cell_id").alias("held"))
    return times.select("t_idx").join(own, "t_idx", "left").select("t_idx", (F.coalesce("k", F.lit(0)) + F.when(F.coalesce("held", F.lit(0)) < n_cells, 1).otherwise(0)).alias("n"))


def temporal_density(labels: DataFrame, cells: DataFrame, cluster: int, n_t: int) -> DataFrame:
    """(cell_id, density): the share of steps that each cell is in the cluster."""
    own = labels.where(F.col("cluster") == cluster).groupBy("cell_id").agg((F.countDistinct("t_idx") / F.lit(n_t)).alias("density"))
    return cells.select("cell_id").join(own, "cell_id", "left").select("cell_id", F.coalesce("density", F.lit(0.0)).alias("density"))


def spatial_density(labels: DataFrame, times: DataFrame, n_cells: int, cluster: int | None = None) -> DataFrame:
    """(t_idx, density): the share of all cells that are in the cluster (any, without one) at each step."""
    own = labels.where("cluster >= 0" if cluster is None else F.col("cluster") == cluster).groupBy("t_idx").agg((F.countDistinct("cell_id") / F.lit(n_cells)).alias("density"))
    return times.select("t_idx").join(own, "t_idx", "left").select("t_idx", F.coalesce("density", F.lit(0.0)).alias("density"))


def density_by_cluster(labels: DataFrame, n_cells: int) -> DataFrame:
    """(cluster, t_idx, density) where a cluster is active."""
    return labels.where("cluster >= 0").groupBy("cluster", "t_idx").agg((F.countDistinct("cell_id") / F.lit(n_cells)).alias("density"))


def sorted_labels(labels: DataFrame) -> DataFrame:
    """Labels renamed by size, largest 0 (of equal ones the larger old label); -1 stays."""
    n = labels.where("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    rank = n.select(F.col("cluster").alias("old"), (F.row_number().over(Window.orderBy(F.desc("n"), F.desc("cluster"))) - 1).alias("new"))
    return labels.join(rank, labels["cluster"] == rank["old"], "left").select("cell_id", "t_idx", F.coalesce("new", F.lit(-1)).cast("int").alias("cluster"))


def top_clusters(labels: DataFrame, n: int) -> DataFrame:
    """The points of the first n ids in ascending order."""
    ids = labels.where("cluster >= 0").select("cluster").distinct().orderBy("cluster").limit(n)
    return labels.join(F.broadcast(ids), "cluster", "left_semi")


def cluster_summary(labels: DataFrame) -> DataFrame:
    """One row: clusters, selected points, and the percentage of them that is noise."""
    return labels.agg(F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"), F.count(F.lit(1)).alias("n_points"), F.try_divide(100.0 * F.count_if(F.col("cluster") < 0), F.count(F.lit(1))).alias("noise_percent"))


def last_label(labels: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell_id, cluster): the largest label of each cell over time."""
    return cells.select("cell_id").join(labels.groupBy("cell_id").agg(F.max("cluster").alias("cluster")), "cell_id", "left").select("cell_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
