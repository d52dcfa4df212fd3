"""Statistics of clusters in time and space, and scores of how abrupt and coherent they are.

All functions give one row for each cluster; `labels` are sparse and noise (-1) is left out unless an operator says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from inspect import signature
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .masks import density_by_cluster, permanent_noise
from .series import _aggregate, clean


def _members(labels: DataFrame) -> DataFrame:
    return labels.where("cluster >= 0")


def time_extent(labels: DataFrame, times: DataFrame) -> DataFrame:
    """(cluster, start, end, start_timestep, end_timestep, duration, duration_timesteps)."""
    a = _members(labels).join(F.broadcast(times), "t_idx").groupBy("cluster").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.min("t_idx").alias("start_timestep"), F.max("t_idx").alias("end_timestep"))
    return a.select("*", (F.col("end") - F.col("start")).alias("duration"), (F.col("end_timestep") - F.col("start_timestep")).alias("duration_timesteps"))


def membership_peak(labels: DataFrame, times: DataFrame, n_cells: int) -> DataFrame:
    """(cluster, membership_peak, membership_peak_density): the middle one of the steps at which most cells are in it."""
    d = density_by_cluster(labels, n_cells)
    w = Window.partitionBy("cluster")
    ties = d.withColumn("top", F.max("density").over(w)).where("density = top")
    ties = ties.withColumn("r", F.row_number().over(w.orderBy("t_idx"))).withColumn("n", F.count(F.lit(1)).over(w))
    return ties.where(F.col("r") == F.floor(F.col("n") / 2) + 1).join(F.broadcast(times), "t_idx").select("cluster", F.col("t").alias("membership_peak"), F.col("density").alias("membership_peak_density"))


def time_quantiles(labels: DataFrame, times: DataFrame, n_cells: int, low: float, high: float) -> DataFrame:
    """(cluster, low, high): the first times at which the cumulated membership comes up to these shares of it."""
    d = density_by_cluster(labels, n_cells)
    w = Window.partitionBy("cluster")
    c = d.withColumn("total", F.sum("density").over(w)).withColumn("cum", F.sum("density").over(w.orderBy("t_idx").rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda q: F.min(F.when(F.col("cum") >= q * F.col("total") - 1e-12, F.col("t_idx")))
    at = c.groupBy("cluster").agg(first(low).alias("a"), first(high).alias("b"))
    t = F.broadcast(times.select("t_idx", "t"))
    return at.join(t.withColumnsRenamed({"t_idx": "a", "t": "low"}), "a").join(t.withColumnsRenamed({"t_idx": "b", "t": "high"}), "b").select("cluster", "low", "high")


def time_moments(labels: DataFrame, times: DataFrame) -> DataFrame:
    """(cluster, mean, median, std) over the distinct steps at which a cluster is active."""
    steps = _members(labels).select("cluster", "t_idx").distinct().join(F.broadcast(times), "t_idx")
    return steps.groupBy("cluster").agg(F.avg("t").alias("mean"), F.percentile("t", F.lit(0.5)).alias("median"), F.stddev_pop("t").alias("std"))


def _cluster_series(grid: DataFrame, value: str, labels: DataFrame, how: str = "mean", percentile: float | None = None) -> DataFrame:
    """(cluster, t_idx, v) over the cells that are ever in each cluster."""
    footprint = _members(labels).select("cluster", "cell_id").distinct()
    return footprint.join(grid.select("cell_id", "t_idx", clean(value).alias("v")), "cell_id").groupBy("cluster", "t_idx").agg(_aggregate(F.col("v"), how, percentile).alias("v"))


def steepest_gradient(grid: DataFrame, value: str, labels: DataFrame, times: DataFrame) -> DataFrame:
    """(cluster, steepest_gradient, steepest_gradient_timestep): the step before the steepest drop of the median series from the cluster's start (included) to its end (excluded); the first step of all where that holds no two steps."""
    span = _members(labels).groupBy("cluster").agg(F.min("t_idx").alias("a"), F.max("t_idx").alias("b"))
    s = _cluster_series(grid, value, labels, "median").join(span, "cluster").where("t_idx >= a and t_idx < b")
    w = Window.partitionBy("cluster").orderBy("t_idx")
    d = s.withColumn("d", F.lead("v").over(w) - F.col("v")).where("d is not null")
    best = d.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("d", "t_idx"))).where("r = 1").select("cluster", "t_idx")
    at = span.select("cluster").join(best, "cluster", "left").select("cluster", F.coalesce("t_idx", F.lit(0)).alias("t_idx"))
    return at.join(F.broadcast(times), "t_idx").select("cluster", F.col("t").alias("steepest_gradient"), F.col("t_idx").alias("steepest_gradient_timestep"))


def _place(cells: DataFrame) -> tuple[Column, Column]:
    """The coordinates of cells: lat and lon where there are any, else y and x."""
    has = "lat" in cells.columns and "lon" in cells.columns
    return (F.coalesce("lat", "y"), F.coalesce("lon", "x")) if has else (F.col("y"), F.col("x"))


def space_moments(labels: DataFrame, cells: DataFrame, footprint: bool = False) -> DataFrame:
    """(cluster, y_mean, x_mean, y_median, x_median, y_std, x_std) over a cluster's points, or over its distinct cells."""
    m = _members(labels).select("cluster", "cell_id")
    y, x = _place(cells)
    p = (m.distinct() if footprint else m).join(cells.select("cell_id", y.alias("py"), x.alias("px")), "cell_id")
    out = []
    for name, f in (("mean", F.avg), ("median", lambda c: F.percentile(c, F.lit(0.5))), ("std", F.stddev_pop)):
        out += [f(F.col("py")).alias(f"y_{name}"), f(F.col("px")).alias(f"x_{name}")]
    return p.groupBy("cluster").agg(*out)


def footprint_area(labels: DataFrame) -> DataFrame:
    """(cluster, footprint_cumulative_area): the number of distinct cells."""
    return _members(labels).groupBy("cluster").agg(F.countDistinct("cell_id").alias("footprint_cumulative_area"))


def central_point(labels: DataFrame, cells: DataFrame) -> DataFrame:
    """(cluster, y, x): the cell of the footprint that is farthest (by index) from any cell outside of it, the first in order of the grid of equal ones.

    The nearest outside cell lies beside the footprint's edge, so only outside cells that touch
    the footprint are compared. Where the footprint is the whole grid its first cell is taken.
    """
    inside = _members(labels).select("cluster", "cell_id").distinct().join(cells.select("cell_id", "y_idx", "x_idx"), "cell_id")
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), a -> transform(sequence(-1, 1), b -> struct(a as dy, b as dx))))")).alias("d")
    touched = inside.select("cluster", "y_idx", "x_idx", around).select("cluster", (F.col("y_idx") + F.col("d.dy")).alias("y_idx"), (F.col("x_idx") + F.col("d.dx")).alias("x_idx")).distinct()
    outside = touched.join(cells.select("cell_id", "y_idx", "x_idx"), ["y_idx", "x_idx"]).join(inside.select("cluster", "cell_id"), ["cluster", "cell_id"], "left_anti").select("cluster", F.col("y_idx").alias("oy"), F.col("x_idx").alias("ox"))
    d = inside.join(outside, "cluster", "left").withColumn("d", (F.col("y_idx") - F.col("oy")) * (F.col("y_idx") - F.col("oy")) + (F.col("x_idx") - F.col("ox")) * (F.col("x_idx") - F.col("ox")))
    nearest = d.groupBy("cluster", "cell_id", "y_idx", "x_idx").agg(F.min("d").alias("d"))
    w = Window.partitionBy("cluster").orderBy(F.desc_nulls_last("d"), "y_idx", "x_idx")
    y, x = _place(cells)
    return nearest.withColumn("r", F.row_number().over(w)).where("r = 1").select("cluster", "cell_id").join(cells.select("cell_id", y.alias("y"), x.alias("x")), "cell_id").select("cluster", "y", "x")


def _linear(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, rss): the squared residuals of v's linear fit on t; 0 where t doesn't vary. Both are brought to mean zero first, as squares of times in seconds leave no digits for their differences."""
    w = Window.partitionBy(*keys)
    rows = rows.where("v is not null").select(*keys, (F.col("t") - F.avg("t").over(w)).alias("t"), (F.col("v") - F.avg("v").over(w)).alias("v"))
    t, v = F.col("t"), F.col("v")
    s = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(t).alias("x"), F.sum(v).alias("y"), F.sum(t * t).alias("xx"), F.sum(t * v).alias("xy"), F.sum(v * v).alias("yy"))
    sxx, sxy, syy = F.col("xx") - F.col("x") * F.col("x") / F.col("n"), F.col("xy") - F.col("x") * F.col("y") / F.col("n"), F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    return s.select(*keys, "n", F.greatest(F.lit(0.0), syy - F.coalesce(F.try_divide(sxy * sxy, sxx), F.lit(0.0))).alias("rss"))


def score_heaviside(grid: DataFrame, value: str, labels: DataFrame, times: DataFrame, how: str = "mean", percentile: float | None = None, norm: str | None = None) -> DataFrame:
    """(cluster, score): squared residuals of the linear fit over squared distances from the median; 0 for a constant series."""
    if how == "raw":
        raise ValueError("raw series have no score")
    s = _cluster_series(grid, value, labels, how, percentile).join(F.broadcast(times), "t_idx")
    if norm is not None:
        s = _by_max(s)
    w = Window.partitionBy("cluster")
    away = s.withColumn("m", F.percentile("v", F.lit(0.5)).over(w)).groupBy("cluster").agg(F.sum((F.col("v") - F.col("m")) * (F.col("v") - F.col("m"))).alias("full"))
    return _linear(s, ["cluster"]).join(away, "cluster").select("cluster", F.coalesce(F.try_divide("rss", "full"), F.lit(0.0)).alias("score"))


def _by_max(s: DataFrame) -> DataFrame:
    top = F.max("v").over(Window.partitionBy("cluster"))
    return s.withColumn("v", F.when(top == 0, F.col("v")).otherwise(F.try_divide("v", top)))


def score_nonlinearity(grid: DataFrame, value: str, labels: DataFrame, times: DataFrame, cells: DataFrame | None = None, how: str = "mean", percentile: float | None = None, against_unclustered: bool = False, guarded: bool = True) -> DataFrame:
    """(cluster, score): root mean squared residual of the series divided by its maximum, and with `against_unclustered` over the mean of that of the min-max-scaled series of permanent noise.

    The mean is 1e-10 at least. With `guarded` (as published) constant series of noise are left out, and where none is left the score stays as it is.
    Without it, as in the SQL of the registered query, constant series make the mean NaN, and a mean of no series counts as 1e-10.
    """
    s = _by_max(_cluster_series(grid, value, labels, how, percentile).join(F.broadcast(times), "t_idx"))
    own = _linear(s, ["cluster"]).select("cluster", F.sqrt(F.try_divide("rss", "n")).alias("score"))
    if not against_unclustered:
        return own
    w = Window.partitionBy("cell_id")
    noise = grid.join(permanent_noise(labels, cells), "cell_id", "left_semi").select("cell_id", "t_idx", clean(value).alias("v")).join(F.broadcast(times), "t_idx")
    low, high = F.min("v").over(w), F.max("v").over(w)
    scaled = noise.withColumn("reach", high - low).withColumn("v", F.try_divide(F.col("v") - low, high - low))
    scaled = scaled.where("reach > 0") if guarded else scaled.withColumn("v", F.when(F.col("reach") == 0, F.lit(float("nan"))).otherwise(F.col("v")))
    mean = _linear(scaled, ["cell_id"]).agg(F.avg(F.sqrt(F.try_divide("rss", "n"))).alias("noise"))
    relative = F.col("score") / F.greatest("noise", F.lit(1e-10))  # greatest() passes over a null
    return own.crossJoin(F.broadcast(mean)).select("cluster", (F.when(F.col("noise").isNull(), F.col("score")).otherwise(relative) if guarded else relative).alias("score"))


def pair_correlations(grid: DataFrame, value: str, labels: DataFrame) -> DataFrame:
    """(cluster, a, b, r2) for the pairs a < b of a cluster's cells: squared correlations, 0 where one is constant.

    Series are brought to mean zero and length one, one row of arrays each, so that a pair is one product of arrays.
    """
    footprint = _members(labels).select("cluster", "cell_id").distinct()
    s = grid.select("cell_id", "t_idx", clean(value).alias("v")).groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t_idx", "v"))), lambda x: x["v"]).alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")
    c = s.select("cell_id", "v", mean.alias("m")).select("cell_id", F.transform("v", lambda x: x - F.col("m")).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = c.select("cell_id", "v", size.alias("n")).select("cell_id", F.transform("v", lambda x: F.coalesce(F.try_divide(x, F.col("n")), F.lit(0.0))).alias("v"))
    m = footprint.join(unit, "cell_id")
    p = m.select("cluster", F.col("cell_id").alias("a"), F.col("v").alias("va")).join(m.select("cluster", F.col("cell_id").alias("b"), F.col("v").alias("vb")), "cluster").where("a < b")
    r = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return p.select("cluster", "a", "b", F.coalesce(r * r, F.lit(0.0)).alias("r2"))


#: Clusters whose matrices a task holds at once.
MAX_HELD = 64


def score_spatial_autocorrelation(grid: DataFrame, value: str, labels: DataFrame) -> DataFrame:
    """(cluster, score): the mean squared correlation of a cluster's series; 0 for a single one.

    The mean over pairs of cells needs no pairs: the sum over all pairs of the squared products of
    unit series is the squared Frobenius norm of their second-moment matrix over time, which has
    n_t x n_t entries however many cells there are.
    """
    footprint = _members(labels).select("cluster", "cell_id").distinct()
    rows = grid.select("cell_id", "t_idx", clean(value).alias("v")).groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t_idx", "v"))), lambda x: x["v"]).alias("v"))

    def moments(batches):
        total: dict[int, list] = {}

        def summed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x[0] for x in total.values()], pa.int64()), pa.array([float(x[1]) for x in total.values()]), pa.array([x[2].ravel() for x in total.values()], pa.list_(pa.float64()))], names=["cluster", "n", "own", "m"])

        for b in batches:
            if not b.num_rows:
                continue
            clusters, whole, n = b.column(0).to_numpy(), b.column(1).is_valid().to_numpy(zero_copy_only=False), int(b.column(2)[0].as_py())
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)  # of the series without gaps
            x = x - x.mean(axis=1, keepdims=True)
            size = np.sqrt((x * x).sum(axis=1, keepdims=True))
            x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
            ok = np.isfinite(size[:, 0])
            for cluster in np.unique(clusters).tolist():
                u = x[(clusters[whole] == cluster) & ok]
                at = total.setdefault(cluster, [0, 0.0, np.zeros((n, n))])
                at[0] += int((clusters == cluster).sum())
                at[1] += float(((u * u).sum(axis=1) ** 2).sum())
                at[2] += u.T @ u
                if len(total) >= MAX_HELD:
                    yield summed()
                    total.clear()
        if total:
            yield summed()

    steps = grid.agg((F.max("t_idx") + 1).cast("int").alias("steps"))  # one row
    parts = footprint.join(rows, "cell_id").crossJoin(F.broadcast(steps)).select(F.col("cluster").cast("int"), F.when(F.size("v") == F.col("steps"), F.col("v")).alias("v"), "steps").mapInArrow(moments, "cluster int, n long, own double, m array<double>")
    sums = parts.select("cluster", F.posexplode("m").alias("i", "m")).groupBy("cluster", "i").agg(F.sum("m").alias("m")).groupBy("cluster").agg(F.sum(F.col("m") * F.col("m")).alias("frobenius"))
    counts = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))
    pairs = F.col("n") * (F.col("n") - 1)
    return counts.join(sums, "cluster").select("cluster", F.when(F.col("n") <= 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("frobenius") - F.col("own"), pairs), F.lit(0.0))).alias("score"))


def ward_consistency(series: np.ndarray) -> float:
    """1 over the inconsistency of the last Ward link of the distances 1 - r2 between series; 0 for one series, 1 where all links are alike."""
    n = len(series)
    if n <= 1:
        return 0.0
    x = series - series.mean(axis=1, keepdims=True)
    size = np.sqrt((x * x).sum(axis=1))
    r = np.nan_to_num(np.divide(x @ x.T, np.outer(size, size), out=np.zeros((n, n)), where=np.outer(size, size) > 0))
    d2 = np.maximum(0, 1 - r * r) ** 2
    np.fill_diagonal(d2, np.inf)
    sizes, alive, heights = np.ones(n), np.ones(n, bool), []
    for _ in range(n - 1):
        i, j = divmod(int(d2.argmin()), n)
        i, j = min(i, j), max(i, j)
        h = d2[i, j]
        heights.append(np.sqrt(h))
        alive[j] = False
        others = alive.copy()
        others[i] = False
        k = np.flatnonzero(others)
        total = sizes[i] + sizes[j] + sizes[k]
        d2[i, k] = d2[k, i] = ((sizes[i] + sizes[k]) * d2[i, k] + (sizes[j] + sizes[k]) * d2[j, k] - sizes[k] * h) / total
        sizes[i] += sizes[j]
        d2[j, :] = d2[:, j] = np.inf
    h = np.array(heights)
    spread = h.std(ddof=1) if len(h) > 1 else 0.0
    value = (h.max() - h.mean()) / spread if spread > 0 else 0.0
    return 1.0 if value < 1e-10 else float(1 / value)


MAX_WARD = 5000


def score_consistency(grid: DataFrame, value: str, labels: DataFrame) -> DataFrame:
    """(cluster, score) by Ward linkage of the squared correlations, one task for each cluster; a cluster of over `MAX_WARD` cells is refused, as its matrix of distances would not fit a task."""
    footprint = _members(labels).select("cluster", "cell_id").distinct()
    rows = grid.select("cell_id", "t_idx", clean(value).alias("v")).groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t_idx", "v"))), lambda x: x["v"]).alias("v"))

    def run(table: pa.Table) -> pa.Table:
        if table.num_rows > MAX_WARD:
            raise ValueError(f"cluster {table.column('cluster')[0]} has {table.num_rows} cells, over {MAX_WARD}")
        order = np.argsort(table.column("cell_id").to_numpy())
        s = np.array([[np.nan if y is None else y for y in v] for v in table.column("v").to_pylist()], dtype=float)[order]
        return pa.table({"cluster": pa.array([table.column("cluster")[0].as_py()], pa.int32()), "score": pa.array([ward_consistency(s)])})

    return footprint.join(rows, "cell_id").select(F.col("cluster").cast("int"), "cell_id", "v").groupBy("cluster").applyInArrow(run, "cluster int, score double")


def aggregate_scores(scores: DataFrame, how: str | Callable[[list[float]], float] = "mean", weights: DataFrame | None = None) -> DataFrame:
    """One row (score): mean, median or weighted mean (`weights`: cluster, weight) of the clusters' scores, or what a function gives for the list of them in order of the clusters; any other name gives 0."""
    if callable(how):
        run = lambda table: pa.table({"score": pa.array([float(how(table.sort_by("cluster").column("score").to_pylist()))])})
        return scores.select(F.lit(0).alias("all"), "cluster", "score").groupBy("all").applyInArrow(run, "score double")
    if how == "mean":
        return scores.agg(F.avg("score").alias("score"))
    if how == "median":
        return scores.agg(F.percentile("score", F.lit(0.5)).alias("score"))
    if how == "weighted":
        return scores.join(weights, "cluster").agg(F.try_divide(F.sum(F.col("score") * F.col("weight")), F.sum("weight")).alias("score"))
    return scores.sparkSession.range(1).select(F.lit(0.0).alias("score"))


#: Published names of keyword arguments of scores, and ours.
_ALIASES = {"aggregation": "how", "normalize": "norm", "normalise_against_unclustered": "against_unclustered"}


def score_overview(grid: DataFrame, value: str, labels: DataFrame, times: DataFrame, cells: DataFrame, shifts: DataFrame | None = None, shift_threshold: float = 0.0, exclude_noise: bool = True, **how: Any) -> DataFrame:
    """One row for each cluster: four scores, their product, size, mean place, and mean and spread of its cells' shift times.

    Keyword arguments go to the scores that take them. Without `exclude_noise` there is a row for -1: the cells that are never in a cluster, its size
    being the number of all points outside of clusters.
    """
    if not exclude_noise:  # scored as one more cluster, number 0
        cast = lambda df: df.select("cell_id", "t_idx", F.col("cluster").cast("int").alias("cluster"))
        never = permanent_noise(labels, cells).select("cell_id", F.lit(0).alias("t_idx"), F.lit(-1).alias("cluster"))
        moved = cast(_members(labels)).unionByName(cast(never)).withColumn("cluster", F.col("cluster") + 1)
        out = score_overview(grid, value, moved, times, cells, shifts, shift_threshold, True, **how).withColumn("cluster", F.col("cluster") - 1)
        outside = cells.select(F.count(F.lit(1)).alias("c")).crossJoin(times.select(F.count(F.lit(1)).alias("t"))).crossJoin(_members(labels).select(F.count(F.lit(1)).alias("m"))).select((F.col("c") * F.col("t") - F.col("m")).alias("outside"))  # three single rows
        return out.crossJoin(F.broadcast(outside)).withColumn("size", F.when(F.col("cluster") == -1, F.col("outside")).otherwise(F.col("size"))).drop("outside")
    given = {_ALIASES.get(k, k): v for k, v in how.items()}
    taken = lambda score: {k: v for k, v in given.items() if k in signature(score).parameters}
    named = lambda df, name: df.withColumnRenamed("score", name)
    names = ["score_heaviside", "score_consistency", "score_spatial_autocorrelation", "score_nonlinearity"]
    every = [score_heaviside(grid, value, labels, times, **taken(score_heaviside)), score_consistency(grid, value, labels), score_spatial_autocorrelation(grid, value, labels), score_nonlinearity(grid, value, labels, times, cells, **taken(score_nonlinearity))]
    out = _members(labels).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    for df, name in zip(every, names, strict=True):
        out = out.join(named(df, name), "cluster", "left")
    out = out.join(space_moments(labels, cells).select("cluster", F.col("y_mean").alias("mean_y"), F.col("x_mean").alias("mean_x")), "cluster", "left")
    if shifts is not None:
        from .select import transition_time

        times_of = _members(labels).select("cluster", "cell_id").distinct().join(transition_time(shifts, times, shift_threshold), "cell_id")
        out = out.join(times_of.groupBy("cluster").agg(F.avg("t").alias("mean_shift_time"), F.stddev_pop("t").alias("std_shift_time")), "cluster", "left")
    product = F.aggregate(F.array_compact(F.array(*names)), F.lit(1.0), lambda a, x: a * x)
    return out.withColumn("aggregate_score", product)
