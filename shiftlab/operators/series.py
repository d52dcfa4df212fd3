"""Time series of clusters, reshaping and coarsening of cubes."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .masks import keep_mask, permanent_noise, spatial_mask

AGGREGATIONS = ("raw", "mean", "median", "sum", "std", "max", "min", "percentile")


def _aggregate(value: Column, how: str, percentile: float | None) -> Column:
    """Population statistics; percentiles are exact and interpolated."""
    if how == "percentile" and percentile is None:
        raise ValueError("aggregation percentile needs a percentile between 0 and 1")
    every = {"mean": F.avg(value), "median": F.percentile(value, F.lit(0.5)), "sum": F.coalesce(F.sum(value), F.lit(0.0)), "std": F.stddev_pop(value), "max": F.max(value), "min": F.min(value), "percentile": F.percentile(value, F.lit(percentile if percentile is not None else 0.5))}
    if how not in every:
        raise ValueError(f"unknown aggregation {how!r}")
    return every[how]


def clean(value: str) -> Column:
    """A value whose NaN is NULL."""
    return F.when(~F.isnan(value), F.col(value).cast("double"))


def aggregate_space(grid: DataFrame, value: str, how: str = "mean", percentile: float | None = None) -> DataFrame:
    """(t_idx, v) over the cells at each step; `raw` gives (cell_id, t_idx, v) of the cells that have any value."""
    if how == "raw":
        v = grid.select("cell_id", "t_idx", clean(value).alias("v"))
        return v.join(v.where("v is not null").select("cell_id").distinct(), "cell_id", "left_semi")
    return grid.groupBy("t_idx").agg(_aggregate(clean(value), how, percentile).alias("v"))


def normalise(rows: DataFrame, how: str | None) -> DataFrame:
    """Divides `v` by its largest value over all (`max`) or in each cell's series (`max_each`). With `max` an unusable largest value leaves all as it is; with `max_each` it gives NULL unless no series has a usable one."""
    if how is None:
        return rows
    if how not in ("max", "max_each"):
        raise ValueError(f"unknown normalisation {how!r}")
    each = how == "max_each" and "cell_id" in rows.columns
    top = F.max("v").over(Window.partitionBy("cell_id")) if each else F.max("v").over(Window.partitionBy(F.lit(0)))
    if not each:  # one row of statistics instead of a window over everything
        one = rows.agg(F.max("v").alias("top"))
        return rows.crossJoin(F.broadcast(one)).withColumn("v", F.when(F.coalesce("top", F.lit(0.0)) == 0, F.col("v")).otherwise(F.try_divide("v", "top"))).drop("top")
    usable = rows.agg(F.count_if(F.col("v").isNotNull() & (F.col("v") != 0)).alias("usable"))
    marked = rows.withColumn("top", top).crossJoin(F.broadcast(usable))
    return marked.withColumn("v", F.when(F.col("usable") == 0, F.col("v")).otherwise(F.try_divide("v", "top"))).drop("top", "usable")


def cluster_timeseries(grid: DataFrame, value: str, labels: DataFrame | None = None, cells: DataFrame | None = None, cluster: int | Iterable[int] | None = None, how: str = "raw", percentile: float | None = None, norm: str | None = None, full: bool = True) -> DataFrame:
    """The series of a cluster's cells (all cells without one; the permanently unclustered ones for -1).

    With `full` off, steps outside of the cluster's first (included) to last (excluded) become NULL.
    """
    rows = grid
    if cluster is not None:
        noise = cluster == -1
        rows = keep_mask(grid, permanent_noise(labels, cells) if noise else spatial_mask(labels, cluster))
        if not full:
            ids = [cluster] if isinstance(cluster, int) else list(cluster)
            span = labels.where(F.col("cluster").isin(ids)).agg(F.min("t_idx").alias("first"), F.max("t_idx").alias("last"))
            inside = (F.col("t_idx") >= F.col("first")) & (F.col("t_idx") < F.col("last"))
            rows = rows.crossJoin(F.broadcast(span)).withColumn(value, F.when(inside, F.col(value))).drop("first", "last")
    return normalise(aggregate_space(rows, value, how, percentile), norm)


def coarsen(grid: DataFrame, values: list[str], y: int = 1, x: int = 1, t: int = 1, sizes: tuple[int, int, int] = (0, 0, 0), skip_missing: bool = True) -> DataFrame:
    """Block means; incomplete blocks at the ends are left out. `sizes`: the cube's (ny, nx, n_t). A missing value is left out of its block's mean, or makes it missing."""
    ny, nx, n_t = sizes
    blocks = [F.floor(F.col(c) / k).cast("int").alias(c) for c, k in (("y_idx", y), ("x_idx", x), ("t_idx", t))]
    kept = grid.where((F.col("y_idx") < ny // y * y) & (F.col("x_idx") < nx // x * x) & (F.col("t_idx") < n_t // t * t))
    full = x * y * t
    mean = lambda c: F.avg(clean(c)).alias(c) if skip_missing else F.when(F.count(clean(c)) == full, F.avg(clean(c))).alias(c)
    out = kept.groupBy(*blocks).agg(*[mean(c) for c in values])
    return out.select((F.col("y_idx").cast("long") * (nx // x) + F.col("x_idx")).alias("cell_id"), "y_idx", "x_idx", "t_idx", *values)


def stride(grid: DataFrame, y: int = 1, x: int = 1, t: int = 1, nx: int = 0) -> DataFrame:
    """Every y-th, x-th and t-th index, renumbered."""
    kept = grid.where((F.col("y_idx") % y == 0) & (F.col("x_idx") % x == 0) & (F.col("t_idx") % t == 0))
    part = lambda c, k: F.floor(F.col(c) / k).cast("int")
    out = kept.withColumns({"y_idx": part("y_idx", y), "x_idx": part("x_idx", x), "t_idx": part("t_idx", t)})
    return out.withColumn("cell_id", F.col("y_idx").cast("long") * (-(-nx // x)) + F.col("x_idx"))


#: The columns that a dimension may become.
MAX_MEMBERS = 10_000


def dimension_to_variables(df: DataFrame, value: str, dim: str, keys: list[str], members: list | None = None, add_name: bool = True, drop_original: bool = True) -> DataFrame:
    """One column `{value}_{dim}_{member}` for each member of a dimension, one row for each of `keys`; without `drop_original` the rows of `df` with these columns added. A dimension of more than `MAX_MEMBERS` members needs `members`."""
    if members is None:  # the members name columns, so they must be known to the plan
        members = [r[0] for r in df.select(dim).distinct().orderBy(dim).limit(MAX_MEMBERS + 1).collect()]
        if len(members) > MAX_MEMBERS:
            raise ValueError(f"{dim} has more than {MAX_MEMBERS} members: name those that become variables")
    wide = df.groupBy(*keys).pivot(dim, members).agg(F.first(value))
    name = lambda m: f"{value}_{dim}_{m}" if add_name else f"{value}_{m}"
    out = wide.select(*keys, *[F.col(f"`{m}`").alias(name(m)) for m in members])
    return out if drop_original else df.join(out, keys)


def preprocess_variable(grid: DataFrame, value: str, keep: Callable[[Column], Column], fill: float | None = None) -> DataFrame:
    """Values that `keep` doesn't hold for become `fill`."""
    return grid.withColumn(value, F.when(keep(F.col(value)), F.col(value)).otherwise(F.lit(fill).cast("double")))


def cluster_bands(grid: DataFrame, value: str, labels: DataFrame, cluster: int, low: float = 0.16, high: float = 0.84) -> DataFrame:
    """(t_idx, low, median, high, min, max) of a cluster's cells at each step."""
    v = clean(value)
    p = lambda q, name: F.percentile(v, F.lit(q)).alias(name)
    return keep_mask(grid, spatial_mask(labels, cluster)).groupBy("t_idx").agg(p(low, "low"), p(0.5, "median"), p(high, "high"), F.min(v).alias("min"), F.max(v).alias("max"))


def sample_trajectories(grid: DataFrame, value: str, n: int = 1000, seed: int = 0) -> DataFrame:
    """The series of at most n cells, the same ones for a seed."""
    cells = grid.where(clean(value).isNotNull()).select("cell_id").distinct().orderBy(F.xxhash64("cell_id", F.lit(seed)), "cell_id").limit(n)
    return grid.join(F.broadcast(cells), "cell_id", "left_semi").select("cell_id", "t_idx", clean(value).alias("v"))
