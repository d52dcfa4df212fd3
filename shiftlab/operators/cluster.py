"""Clustering of shift points in space and time."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import ang2pix, auto_nside, geodetic_to_cartesian, pix2ang
from ..checkpoints import cut
from .graph import connected_components
from .hierarchy import BLOCK, core_distances, mutual_tree, spanning_tree
from .masks import sorted_labels


class Clusterer(Protocol):
    """A user's clusterer: coordinates (n x 3 or 4) and weights in, a label for each out, -1 for noise."""

    def fit_predict(self, X: np.ndarray, y: np.ndarray | None = None) -> np.ndarray: ...  # noqa: N803


class Regridder(Protocol):
    """Maps points (cell_id, t_idx, t, w, lat, lon and others) to other places and labels back.

    `key` names the long column that numbers the places. `regrid` returns (t_idx, t, key, w, lat, lon), one row for each place and step;
    `labels_back` takes the points and (t_idx, key, cluster) and returns (cell_id, t_idx, cluster). A method `sized(points)`, if there is one, returns the regridder to use for the points.
    """

    key: str

    def regrid(self, points: DataFrame) -> DataFrame: ...

    def labels_back(self, points: DataFrame, labels: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class HealPixRegridder:
    """Points of one step in the same equal-area pixel become one, of their mean weight, at the pixel's centre."""

    nside: int | None = None
    key = "hp_pix"

    def sized(self, points: DataFrame) -> HealPixRegridder:
        """With a resolution that suits the points' distinct places; of fewer than 4 places the coarsest."""
        return self if self.nside else HealPixRegridder(auto_nside(max(4, points.select("cell_id").distinct().count())))

    def with_pixels(self, df: DataFrame) -> DataFrame:
        return df.withColumn("hp_pix", ang2pix(self.nside, F.col("lat"), F.col("lon")))

    def regrid(self, points: DataFrame) -> DataFrame:
        """(t_idx, t, hp_pix, w, lat, lon)."""
        lat, lon = pix2ang(self.nside, F.col("hp_pix"))
        return self.with_pixels(points).groupBy("t_idx", "t", "hp_pix").agg(F.avg("w").alias("w")).withColumns({"lat": lat, "lon": lon})

    def labels_back(self, points: DataFrame, labels: DataFrame) -> DataFrame:
        """Labels (t_idx, hp_pix, cluster) for the points; -1 where a pixel has none."""
        own = self.with_pixels(points).select("cell_id", "t_idx", "hp_pix")
        return own.join(labels, ["t_idx", "hp_pix"], "left").select("cell_id", "t_idx", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def located(points: DataFrame, times: DataFrame, cells: DataFrame) -> DataFrame:
    """Selected points with their time, coordinates and weight |dts|."""
    return points.join(F.broadcast(times.select("t_idx", "t")), "t_idx").join(cells, "cell_id").withColumn("w", F.abs("dts"))


def coordinates(df: DataFrame, has_latlon: bool, time_weight: float = 1.0) -> DataFrame:
    """Adds c0 (time), c1, c2 and, for geographic points, c3 (WGS84 km); time is brought to the mean spread of the spatial axes and multiplied by `time_weight`.

    Axes are those of the points; the statistics are one row that is broadcast.
    """
    space = dict(zip(("c1", "c2", "c3"), geodetic_to_cartesian(F.col("lat"), F.col("lon")))) if has_latlon else {"c1": F.col("y").cast("double"), "c2": F.col("x").cast("double")}
    p = df.withColumns(space)
    spread = sum((F.stddev_pop(c) for c in space), F.lit(0.0)) / len(space)
    one = p.agg(F.avg("t").alias("t_mean"), F.stddev_pop("t").alias("t_std"), spread.alias("s_std"))
    scaled: Column = F.when(F.col("t_std") > 0, (F.col("t") - F.col("t_mean")) / F.col("t_std") * F.col("s_std")).otherwise(F.col("t"))
    return p.crossJoin(F.broadcast(one)).withColumn("c0", scaled * F.lit(float(time_weight))).drop("t_mean", "t_std", "s_std")


def dbscan(points: DataFrame, axes: list[str], eps: float, min_samples: int = 5, key: str = "id") -> DataFrame:
    """(key, cluster): density clusters, -1 for noise; `key` is a long that is unique among the points.

    Points meet by an equi-join on a grid of cells of width eps and their neighbours. Core points
    have `min_samples` points within eps, themselves included; components of linked core points
    are clusters, numbered by their smallest key; another point goes to the cluster of the smallest core point that it is linked with.
    """
    p = cut(points.select(F.col(key).alias("k"), *[F.col(a).cast("double").alias(a) for a in axes]))  # both sides of the join read it
    home = {f"g_{a}": F.floor(F.col(a) / eps).cast("long") for a in axes}
    p = p.withColumns(home)
    around = p.select(F.col("k").alias("o"), *[F.col(a).alias(f"o_{a}") for a in axes], *home)
    for g in home:
        around = around.withColumn(g, F.explode(F.array(F.col(g) - 1, F.col(g), F.col(g) + 1)))
    d2 = sum((F.col(a) - F.col(f"o_{a}")) * (F.col(a) - F.col(f"o_{a}")) for a in axes)
    linked = cut(p.join(around, list(home)).where(d2 <= eps * eps).select("k", "o"))
    core = linked.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_samples).select("k")
    from_core = linked.join(core, "k")
    both = from_core.join(core.withColumnRenamed("k", "o"), "o", "left_semi").where("k < o")
    comps = connected_components(both, "k", "o")
    named = core.join(comps.withColumnRenamed("node", "k"), "k", "left").select("k", F.coalesce("component", "k").alias("component"))
    border = from_core.join(core.withColumnRenamed("k", "o"), "o", "left_anti").groupBy("o").agg(F.min("k").alias("k")).join(named, "k").select(F.col("o").alias("k"), "component")
    every = named.unionByName(border)
    number = every.select("component").distinct().select("component", (F.row_number().over(Window.orderBy("component")) - 1).cast("int").alias("cluster"))
    found = every.join(number, "component").select(F.col("k").alias(key), "cluster")
    return points.select(key).join(found, key, "left").select(key, F.coalesce("cluster", F.lit(-1)).alias("cluster"))


class Distributed(Protocol):
    """A clusterer of DataFrames: points (id, axes, w) in, (id, cluster) out, -1 for noise."""

    def cluster(self, points: DataFrame, axes: list[str]) -> DataFrame: ...


@dataclass(frozen=True)
class DBSCAN:
    eps: float = 0.5
    min_samples: int = 5

    def cluster(self, points: DataFrame, axes: list[str]) -> DataFrame:
        return dbscan(points, axes, self.eps, self.min_samples)


@dataclass(frozen=True)
class SparkML:
    """Any estimator of `pyspark.ml.clustering` with features and predictions, such as KMeans, BisectingKMeans and GaussianMixture."""

    estimator: Any

    def cluster(self, points: DataFrame, axes: list[str]) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        rows = VectorAssembler(inputCols=axes, outputCol="features_of_point").transform(points.select("id", *axes))
        model = self.estimator.copy().setFeaturesCol("features_of_point").setPredictionCol("cluster_of_point").fit(rows)
        return model.transform(rows).select("id", F.col("cluster_of_point").cast("int").alias("cluster"))


@dataclass(frozen=True)
class HDBSCAN:
    """Hierarchical density clusters by excess of mass. The cube's points are clustered by `hdbscan`; `fit_predict` takes arrays."""

    min_cluster_size: int = 5
    min_samples: int | None = None
    allow_single_cluster: bool = False

    def fit_predict(self, X: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:  # noqa: N803
        n, k = len(X), self.min_samples or self.min_cluster_size
        if n < max(k, 2):
            return np.full(n, -1)
        x = np.asarray(X, dtype=float)
        core = np.concatenate([core_distances(x[i : i + 256], iter([x]), k) for i in range(0, n, 256)])
        return _excess_of_mass(*spanning_tree(x, core), n, self.min_cluster_size, self.allow_single_cluster)

    def cluster(self, points: DataFrame, axes: list[str]) -> DataFrame:
        return hdbscan(points, axes, self)


def hdbscan(points: DataFrame, axes: list[str], method: HDBSCAN, block: int = BLOCK) -> DataFrame:
    """(id, cluster): labels of the points (id, axes), -1 for noise, the same as `fit_predict` gives for them in order of their ids.

    The spanning tree is built from pairs of blocks; the tree of clusters from its edges (one for each point, 24 bytes) in one task.
    """
    n, k = points.count(), method.min_samples or method.min_cluster_size
    if n < max(k, 2):
        return points.select("id", F.lit(-1).alias("cluster"))

    def run(table: pa.Table) -> pa.Table:
        a, b, w = (table.column(c).to_numpy() for c in "abw")
        ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        labels = _excess_of_mass(ends[: len(a)], ends[len(a) :], w, len(ids), method.min_cluster_size, method.allow_single_cluster)
        return pa.table({"id": pa.array(ids), "cluster": pa.array(labels.astype(np.int32))})

    return mutual_tree(points.select("id", *axes), axes, k, block).withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "id long, cluster int")


def _excess_of_mass(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, least: int, single: bool) -> np.ndarray:
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), w))
    parent = np.arange(2 * n - 1)
    left, right, height, size = np.full(2 * n - 1, -1), np.full(2 * n - 1, -1), np.zeros(2 * n - 1), np.ones(2 * n - 1, int)

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for m, e in enumerate(order):
        i, j, new = top(a[e]), top(b[e]), n + m
        parent[i] = parent[j] = new
        left[new], right[new], height[new], size[new] = i, j, w[e], size[i] + size[j]
    # condensed clusters: where both halves of a split are large enough, two are born
    up, birth, stability, fallen = [-1], [0.0], [0.0], np.zeros(n, int)
    todo = [(2 * n - 2, 0)]
    while todo:
        node, c = todo.pop()
        if node < n:
            fallen[node] = c
            continue
        lam = 1 / height[node] if height[node] > 0 else 1e300
        big = [x for x in (left[node], right[node]) if size[x] >= least]
        if len(big) == 2:
            for x in big:
                up.append(c)
                birth.append(lam)
                stability.append(0.0)
                todo.append((x, len(up) - 1))
            stability[c] += (lam - birth[c]) * size[node]
        else:
            for x in (left[node], right[node]):
                if size[x] >= least:
                    todo.append((x, c))
                else:
                    stability[c] += (lam - birth[c]) * size[x]
                    inner = [x]
                    while inner:
                        z = inner.pop()
                        if z < n:
                            fallen[z] = c
                        else:
                            inner += [left[z], right[z]]
    children: dict[int, list[int]] = {}
    for c, p in enumerate(up):
        children.setdefault(p, []).append(c)
    chosen, value = set(), list(stability)
    for c in range(len(up) - 1, -1, -1):
        own = children.get(c, [])
        below = sum(value[x] for x in own)
        if (c > 0 or single) and (not own or stability[c] >= below):
            drop = list(own)
            while drop:
                x = drop.pop()
                chosen.discard(x)
                drop += children.get(x, [])
            chosen.add(c)
        else:
            value[c] = below
    names = {c: i for i, c in enumerate(sorted(chosen))}
    out = np.full(n, -1)
    for i in range(n):
        c = fallen[i]
        while c >= 0 and c not in names:
            c = up[c]
        if c >= 0:
            out[i] = names[c]
    return out


MAX_POINTS = 200_000


def grouped_fit(points: DataFrame, axes: list[str], method: Clusterer, keys: list[str]) -> DataFrame:
    """(keys, cluster) by a user's clusterer, which sees all points in one task; more than `MAX_POINTS` are refused."""
    n = points.count()
    if n > MAX_POINTS:
        raise ValueError(f"{n} points, over {MAX_POINTS}: use HDBSCAN or DBSCAN, which are distributed, or fewer points")
    schema = points.select(*keys, F.lit(0).alias("cluster")).schema

    def run(table: pa.Table) -> pa.Table:
        table = table.drop_columns("all").sort_by([(k, "ascending") for k in keys])
        x = np.column_stack([table.column(a).to_numpy() for a in axes])
        try:
            labels = np.asarray(method.fit_predict(x, table.column("w").to_numpy()))
        except ValueError as e:
            if "min_samples" not in str(e) or "must be at most" not in str(e):
                raise
            labels = np.full(len(x), -1)  # too few points
        return table.select(keys).append_column("cluster", pa.array(labels.astype(np.int32)))

    return points.select(F.lit(0).alias("all"), *keys, *axes, "w").groupBy("all").applyInArrow(run, schema)


def cluster_points(points: DataFrame, times: DataFrame, cells: DataFrame, method: Clusterer | Distributed, grid_kind: str = "native", time_weight: float = 1.0, regridder: Regridder | None = None, disable_regridder: bool = False, sort_by_size: bool = True) -> DataFrame:
    """(cell_id, t_idx, cluster) of selected points.

    Points of a regular lat/lon grid go through equal-area pixels unless `disable_regridder`;
    a regridder that is passed is used for any grid with lat and lon. No points give no rows.
    """
    has = grid_kind in ("latlon", "irregular")
    own = located(points, times, cells)
    used = None
    if not disable_regridder and has and (regridder is not None or grid_kind == "latlon"):
        if own.isEmpty():
            return own.select("cell_id", "t_idx", F.lit(-1).alias("cluster"))
        used = regridder or HealPixRegridder()
        used = used.sized(own) if hasattr(used, "sized") else used
    p = coordinates(used.regrid(own) if used else own, has, time_weight)
    keys, axes = ["t_idx", used.key if used else "cell_id"], ["c0", "c1", "c2"] + ["c3"] * has
    if hasattr(method, "cluster"):  # ids in order of time, then of place
        coded = cut(p.withColumn("id", (F.col("t_idx").cast("long") * F.lit(1 << 40) + F.col(keys[1])).cast("long")))
        labels = method.cluster(coded, axes).join(coded.select("id", *keys), "id").select(*keys, "cluster")
    else:
        labels = grouped_fit(p, axes, method, keys)
    labels = used.labels_back(own, labels) if used else labels.select("cell_id", "t_idx", "cluster")
    return sorted_labels(labels) if sort_by_size else labels
