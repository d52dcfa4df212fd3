"""`ShiftCube`: a cube of variables over cells and time, its shifts and its clusters.

A cube holds immutable DataFrames; methods that compute something return a new cube. Only the
numbers of cells and steps and the time axis (one number a step) are known to the driver.
"""

from __future__ import annotations

import json
import logging
import re
import time as clock
from collections import ChainMap
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import cut
from .functions.times import seconds_since_first, time_index
from .operators import cluster as cl
from .operators import consensus as co
from .operators import detect as de
from .operators import masks, series, stats
from .operators import select as se

logger = logging.getLogger("shiftlab")
LAT_NAMES, LON_NAMES = ("lat", "latitude", "nav_lat"), ("lon", "longitude", "nav_lon")
#: Values of an axis that are broadcast.
MAX_AXIS = 1_000_000
BASE, SHIFT, CLUSTER = "base", "shift", "cluster"


@dataclass(frozen=True)
class ShiftCube:
    grid: DataFrame  # cell_id, y_idx, x_idx, t_idx, values
    cells: DataFrame  # cell_id, y_idx, x_idx, y, x [, lat, lon]
    times: DataFrame  # t_idx, t, t_orig
    axis: tuple[float, ...]
    ny: int
    nx: int
    grid_kind: str = "native"
    time_name: str = "time"
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    catalog: dict[str, dict[str, Any]] = field(default_factory=dict)

    # -- making one

    @staticmethod
    def from_dataframe(df: DataFrame, time: str, y: str | None = None, x: str | None = None, values: Iterable[str] | None = None, lat: str | None = None, lon: str | None = None) -> ShiftCube:
        """A cube of long rows. `y` and `x` name the space columns (found among x/y, lon/lat and their longer names otherwise); with `lat` and `lon` besides, the grid is irregular."""
        for old, new in (("longitude", "lon"), ("latitude", "lat")):
            if old in df.columns and new not in df.columns:
                df = df.withColumnRenamed(old, new)
        if time not in df.columns:
            raise AssertionError(f"time dimension {time!r} is not in {df.columns}")
        if y is None or x is None:
            found = next(((a, b) for a, b in (("y", "x"), ("lat", "lon"), ("j", "i")) if a in df.columns and b in df.columns), None)
            if found is None:
                raise ValueError("no pair of space columns found; name y and x")
            y, x = found
        regular = (y, x) == ("lat", "lon")
        lat, lon = lat or next((c for c in LAT_NAMES if c in df.columns), None), lon or next((c for c in LON_NAMES if c in df.columns), None)
        kind = "latlon" if regular else "irregular" if lat and lon else "native"
        names = list(values) if values is not None else [c for c, t in df.dtypes if c not in (time, y, x, lat, lon) and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
        df = seconds_since_first(df, time, "__t")
        steps = time_index(df, "__t")
        ys, xs = (time_index(df.select(c), c, i) for c, i in ((y, "y_idx"), (x, "x_idx")))
        axis = tuple(r[0] for r in steps.orderBy("t_idx").select("__t").collect())  # one number for each step
        ny, nx = ys.count(), xs.count()
        extra = [c for c in (lat, lon) if c and c not in (y, x)]
        small = lambda table, n: F.broadcast(table) if n <= MAX_AXIS else table
        rows = df.join(small(steps, len(axis)), "__t").join(small(ys, ny), y).join(small(xs, nx), x)
        cell = (F.col("y_idx").cast("long") * nx + F.col("x_idx")).alias("cell_id")
        value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c)  # noqa: E731  missing is NULL, never NaN
        grid = rows.select(cell, "y_idx", "x_idx", "t_idx", *[value(c) for c in names])
        every = ys.crossJoin(small(xs, nx)).select(cell, "y_idx", "x_idx", F.col(y).alias("y"), F.col(x).alias("x"))
        if regular:
            every = every.withColumns({"lat": F.col("y").cast("double"), "lon": F.col("x").cast("double")})
        elif extra:
            every = every.join(rows.select(cell, F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).groupBy("cell_id").agg(F.first("lat", True).alias("lat"), F.first("lon", True).alias("lon")), "cell_id", "left")
        times = rows.groupBy("t_idx").agg(F.first("__t").alias("t"), F.first(time).alias("t_orig"))
        return ShiftCube(grid, every, times, axis, ny, nx, kind, time, {}, {c: {"variable_type": BASE} for c in names})

    @staticmethod
    def load(spark: SparkSession, path: str) -> ShiftCube:
        """A cube that `save` wrote."""
        about = json.loads("".join(r[0] for r in spark.read.text(f"{path}/_catalog.json.d").collect()))
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        tables = {n: read(f"tables/{n}") for n, a in about["catalog"].items() if a["variable_type"] != BASE}
        return ShiftCube(read("grid"), read("cells"), read("times"), tuple(about["axis"]), about["ny"], about["nx"], about["grid_kind"], about["time_name"], tables, about["catalog"])

    def save(self, path: str, suffix: str | None = None, overwrite: bool = False) -> str:
        """Parquet tables and a catalogue; an existing cube is refused unless `overwrite`."""
        path = path + (f"_{suffix.lstrip('_')}" if suffix else "")
        mode = "overwrite" if overwrite else "errorifexists"
        self.grid.write.mode(mode).parquet(f"{path}/grid")
        self.cells.write.mode(mode).parquet(f"{path}/cells")
        self.times.write.mode(mode).parquet(f"{path}/times")
        for name, df in self.tables.items():
            df.write.mode(mode).parquet(f"{path}/tables/{name}")
        about = {"axis": self.axis, "ny": self.ny, "nx": self.nx, "grid_kind": self.grid_kind, "time_name": self.time_name, "catalog": self.catalog}
        self.spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/_catalog.json.d")
        return path

    # -- what it holds

    @property
    def spark(self) -> SparkSession:
        return self.grid.sparkSession

    @property
    def n_t(self) -> int:
        return len(self.axis)

    @property
    def n_cells(self) -> int:
        return self.ny * self.nx

    @property
    def space_dims(self) -> tuple[str, str]:
        return ("lat", "lon") if self.grid_kind == "latlon" else ("y", "x")

    def _named(self, kind: str) -> list[str]:
        return [n for n, a in self.catalog.items() if a["variable_type"] == kind]

    base_vars = property(lambda self: self._named(BASE))
    shift_vars = property(lambda self: self._named(SHIFT))
    cluster_vars = property(lambda self: self._named(CLUSTER))

    def shift_vars_for_var(self, var: str) -> list[str]:
        return [n for n in self.shift_vars if self.catalog[n]["base_variable"] == var]

    def cluster_vars_for_var(self, var: str) -> list[str]:
        return [n for n in self.cluster_vars if var in (self.catalog[n]["base_variable"], self.catalog[n]["shifts_variable"])]

    def get_base_var(self, var: str | None = None) -> str:
        """The base variable of a variable; without one, the only base variable there is."""
        if var is None:
            if len(self.base_vars) != 1:
                raise ValueError(f"name a variable: there are {self.base_vars}")
            return self.base_vars[0]
        if var not in self.catalog:
            raise ValueError(f"no variable {var!r}; there are {sorted(self.catalog)}")
        return self.catalog[var].get("base_variable", var)

    def _one(self, var: str | None, kind: str, of: Callable[[str], list[str]]) -> str:
        if var in self.catalog and self.catalog[var]["variable_type"] == kind:
            return var
        found = of(self.get_base_var(var)) if var is None or self.catalog.get(var, {}).get("variable_type") == BASE else of(var)
        if len(found) != 1:
            raise ValueError(f"{'no' if not found else 'more than one'} {kind} variable for {var!r}: {found}")
        return found[0]

    def shift_var(self, var: str | None = None) -> str:
        return self._one(var, SHIFT, self.shift_vars_for_var)

    def cluster_var(self, var: str | None = None) -> str:
        return self._one(var, CLUSTER, self.cluster_vars_for_var)

    def get_shifts(self, var: str | None = None) -> DataFrame:
        return self.tables[self.shift_var(var)]

    def get_clusters(self, var: str | None = None) -> DataFrame:
        return self.tables[self.cluster_var(var)]

    def set_log_level(self, level: str | int) -> None:
        logger.setLevel(level)

    def numeric_time_values(self) -> list[float]:
        return list(self.axis)

    def _unique(self, name: str, overwrite: bool) -> str:
        while not overwrite and name in self.catalog:
            m = re.search(r"_(\d+)$", name)
            name = f"{name[: m.start()]}_{int(m[1]) + 1}" if m else f"{name}_1"
        return name

    def _with(self, name: str, df: DataFrame, attributes: dict[str, Any]) -> ShiftCube:
        return replace(self, tables=ChainMap({name: df}, self.tables), catalog={**self.catalog, name: attributes})

    def _repr_html_(self) -> str:
        items = []
        for b in self.base_vars:
            inner = "".join(f"<li>{s}<ul>{''.join(f'<li>{c}</li>' for c in self.cluster_vars_for_var(s))}</ul></li>" for s in self.shift_vars_for_var(b))
            items.append(f"<li>{b}<ul>{inner}</ul></li>")
        return f"<p>{self.ny} x {self.nx} cells x {self.n_t} steps ({self.grid_kind})</p><ul>{''.join(items)}</ul>"

    # -- stages

    def compute_shifts(self, var: str | None = None, method: de.ShiftsMethod | None = None, output_label_suffix: str = "", overwrite: bool = False) -> ShiftCube:
        """Adds `<var>_dts<suffix>`: (cell_id, t_idx, dts) of the usable cells, computed once into the checkpoint folder."""
        var, method = self.get_base_var(var), method or de.ASDETECT()
        started = clock.time()
        if not getattr(method, "ignore_nan_warnings", False) and logger.isEnabledFor(logging.WARNING):
            gappy = de.cell_status(self.grid, var, self.n_t).where("gappy").count()
            if gappy:
                logger.warning("%d cells have gaps in their series and are left out of the detection", gappy)
        df = de.detect(self.grid.select("cell_id", "t_idx", var), var, list(self.axis), method)
        about = {f"method_{k}": str(v) for k, v in sorted(getattr(method, "__dict__", {}).items()) if v is not None and not k.startswith("_")}
        return self._with(self._unique(f"{var}_dts{output_label_suffix}", overwrite), cut(df), {"variable_type": SHIFT, "base_variable": var, "method_name": type(method).__name__, "time_dim": self.time_name, "runtime_planning": clock.time() - started, **about})

    def compute_clusters(self, var: str | None = None, method: Any = None, shift_threshold: float = 0.5, shift_direction: str = "both", shift_selection: str = "local", time_weight: float = 1.0, regridder: cl.Regridder | None = None, disable_regridder: bool = False, output_label_suffix: str = "", output_label: str | None = None, overwrite: bool = False, sort_by_size: bool = True, optimize: bool = False, optimize_params: dict[str, Any] | None = None, objective: Any = "combined_spatial_nonlinearity", n_trials: int = 50, direction: str = "maximize") -> ShiftCube:
        """Adds `<shift>_cluster<suffix>`: (cell_id, t_idx, cluster) of the selected points, computed once into the checkpoint folder."""
        name, method = self.shift_var(var), method or cl.HDBSCAN()
        if optimize:
            from .operators.optimize import optimise

            best = optimise(self, name, method, optimize_params or {}, objective, n_trials, direction, {"shift_threshold": shift_threshold, "shift_direction": shift_direction, "shift_selection": shift_selection, "time_weight": time_weight, "regridder": regridder, "disable_regridder": disable_regridder})
            out = self.compute_clusters(name, best.method, output_label_suffix=output_label_suffix, output_label=output_label, overwrite=overwrite, sort_by_size=sort_by_size, **best.arguments)
            made = next(n for n in out.catalog if n not in self.catalog or overwrite and out.tables.get(n) is not self.tables.get(n))
            out.catalog[made].update({"optimization": True, "opt_best_score": best.score, "opt_best_params": best.params, "opt_n_trials": n_trials, "opt_direction": direction, "opt_objective": str(objective)})
            return out
        points = se.select_points(self.tables[name], shift_threshold, shift_direction, shift_selection)
        df = cl.cluster_points(points, self.times, self.cells, method, self.grid_kind, time_weight, regridder, disable_regridder, sort_by_size)
        about = {"variable_type": CLUSTER, "base_variable": self.get_base_var(name), "shifts_variable": name, "method_name": type(method).__name__, "shift_threshold": shift_threshold, "shift_direction": shift_direction, "shift_selection": shift_selection, "time_weight": time_weight}
        return self._with(self._unique(output_label or f"{name}_cluster{output_label_suffix}", overwrite), cut(df), about)

    def drop_clusters(self, *names: str) -> ShiftCube:
        gone = set(names or self.cluster_vars)
        return replace(self, tables={n: self.tables[n] for n in self.tables if n not in gone}, catalog={n: a for n, a in self.catalog.items() if n not in gone})

    def drop_shifts(self, *names: str) -> ShiftCube:
        """Also drops the clusters that were made of them."""
        gone = set(names or self.shift_vars)
        return self.drop_clusters(*gone, *[c for c in self.cluster_vars if self.catalog[c]["shifts_variable"] in gone])

    # -- masks, counts, densities

    def get_cluster_counts(self, var: str | None = None) -> DataFrame:
        return masks.cluster_counts(self.get_clusters(var), self.n_cells * self.n_t)

    def get_cluster_ids(self, var: str | None = None) -> DataFrame:
        return masks.cluster_ids(self.get_clusters(var))

    def get_active_clusters_count_per_timestep(self, var: str | None = None) -> DataFrame:
        return masks.active_clusters(self.get_clusters(var), self.times, self.n_cells)

    def get_cluster_mask(self, var: str | None, ids: int | Iterable[int]) -> DataFrame:
        return masks.cluster_mask(self.get_clusters(var), ids)

    def get_cluster_mask_spatial(self, var: str | None, ids: int | Iterable[int]) -> DataFrame:
        return masks.spatial_mask(self.get_clusters(var), ids)

    def get_cluster_mask_temporal(self, var: str | None, ids: int | Iterable[int]) -> DataFrame:
        return masks.temporal_mask(self.get_clusters(var), ids)

    def get_cluster_mask_permanent(self, var: str | None, cluster: int) -> DataFrame:
        return masks.permanent_mask(self.get_clusters(var), cluster, self.n_t)

    def get_cluster_mask_permanent_noise(self, var: str | None = None) -> DataFrame:
        return masks.permanent_noise(self.get_clusters(var), self.cells)

    def apply_cluster_mask(self, var: str, apply_to: str, ids: int | Iterable[int]) -> DataFrame:
        return masks.apply_mask(self.grid, apply_to, self.get_cluster_mask(var, ids))

    def apply_cluster_mask_spatial(self, var: str, apply_to: str, ids: int | Iterable[int]) -> DataFrame:
        return masks.apply_mask(self.grid, apply_to, self.get_cluster_mask_spatial(var, ids))

    def apply_cluster_mask_temporal(self, var: str, apply_to: str, ids: int | Iterable[int]) -> DataFrame:
        return masks.apply_mask(self.grid, apply_to, self.get_cluster_mask_temporal(var, ids))

    def get_cluster_density_temporal(self, var: str | None, cluster: int) -> DataFrame:
        return masks.temporal_density(self.get_clusters(var), self.cells, cluster, self.n_t)

    def get_cluster_density_spatial(self, var: str | None = None, cluster: int | None = None) -> DataFrame:
        return masks.spatial_density(self.get_clusters(var), self.times, self.n_cells, cluster)

    def get_cluster_data(self, var: str | None, ids: int | Iterable[int]) -> DataFrame:
        return masks.cluster_data(self.grid, self.get_clusters(var), self.cells, ids)

    def get_cluster_timeseries(self, var: str, cluster_id: int | Iterable[int] | None = None, cluster_var: str | None = None, aggregation: str = "raw", percentile: float | None = None, normalize: str | None = None, keep_full_timeseries: bool = True) -> DataFrame:
        labels = None if cluster_id is None else self.get_clusters(cluster_var or var)
        return series.cluster_timeseries(self.grid, self.get_base_var(var), labels, self.cells, cluster_id, aggregation, percentile, normalize, keep_full_timeseries)

    # -- grouped APIs

    def stats(self, var: str | None = None) -> Stats:
        return Stats(self, self.cluster_var(var))

    @cached_property
    def aggregate(self) -> Aggregate:
        return Aggregate(self)

    @cached_property
    def preprocess(self) -> Preprocess:
        return Preprocess(self)

    @cached_property
    def plot_data(self) -> PlotData:
        return PlotData(self)


@dataclass(frozen=True)
class Stats:
    """Statistics of one cluster variable; each method gives one row for each cluster."""

    cube: ShiftCube
    var: str

    @property
    def _of(self) -> tuple[DataFrame, str, DataFrame]:
        return self.cube.grid, self.cube.get_base_var(self.var), self.cube.tables[self.var]

    def time(self) -> DataFrame:
        """Extent, peak, steepest gradient, quantile ranges and moments in time, side by side."""
        g, v, lab = self._of
        c, parts = self.cube, []
        parts += [stats.time_extent(lab, c.times), stats.membership_peak(lab, c.times, c.n_cells), stats.steepest_gradient(g, v, lab, c.times)]
        parts += [stats.time_quantiles(lab, c.times, c.n_cells, a, b).withColumnsRenamed({"low": f"{n}_low", "high": f"{n}_high"}) for n, a, b in (("iqr_50", 0.25, 0.75), ("iqr_68", 0.16, 0.84), ("iqr_90", 0.05, 0.95))]
        parts.append(stats.time_moments(lab, c.times))
        out = parts[0]
        for p in parts[1:]:
            out = out.join(p, "cluster", "left")
        return out

    def iqr(self, low: float, high: float) -> DataFrame:
        return stats.time_quantiles(self._of[2], self.cube.times, self.cube.n_cells, low, high)

    def transition_time(self, cluster_ids: Iterable[int] | None = None, shift_threshold: float = 0.5) -> DataFrame:
        shifts = self.cube.tables[self.cube.catalog[self.var]["shifts_variable"]]
        cells = self.cube.cells if cluster_ids is None else masks.spatial_mask(self._of[2], cluster_ids)
        return se.transition_time(shifts, self.cube.times, shift_threshold, cells)

    def space(self) -> DataFrame:
        _, _, lab = self._of
        cells = self.cube.cells
        foot = stats.space_moments(lab, cells, True)
        foot = foot.withColumnsRenamed({c: f"footprint_{c}" for c in foot.columns if c != "cluster"})
        centre = stats.central_point(lab, cells).withColumnsRenamed({"y": "central_y", "x": "central_x"})
        return stats.space_moments(lab, cells).join(foot, "cluster").join(stats.footprint_area(lab), "cluster").join(centre, "cluster", "left")

    def score_heaviside(self, **how: Any) -> DataFrame:
        return stats.score_heaviside(*self._of, self.cube.times, **how)

    def score_consistency(self) -> DataFrame:
        return stats.score_consistency(*self._of)

    def score_spatial_autocorrelation(self) -> DataFrame:
        return stats.score_spatial_autocorrelation(*self._of)

    def score_nonlinearity(self, **how: Any) -> DataFrame:
        return stats.score_nonlinearity(*self._of, self.cube.times, self.cube.cells, **how)

    def score_overview(self, shift_threshold: float = 0.0, exclude_noise: bool = True, **how: Any) -> DataFrame:
        shifts = self.cube.tables[self.cube.catalog[self.var]["shifts_variable"]]
        return stats.score_overview(*self._of, self.cube.times, self.cube.cells, shifts, shift_threshold, exclude_noise, **how)

    def aggregate_cluster_scores(self, score_method: str, aggregation: str | Callable[[list[float]], float] = "mean", cluster_ids: Iterable[int] | None = None, weights: DataFrame | None = None, **how: Any) -> DataFrame:
        scores = getattr(self, score_method)(**how)
        if cluster_ids is not None:
            scores = scores.where(F.col("cluster").isin(list(cluster_ids)))
        return stats.aggregate_scores(scores, aggregation, weights)


@dataclass(frozen=True)
class Aggregate:
    """Operators over several cluster variables."""

    cube: ShiftCube

    def _maps(self, names: Iterable[str] | None) -> dict[str, DataFrame]:
        return {n: self.cube.tables[n] for n in (names or self.cube.cluster_vars)}

    def cluster_occurrence_rate(self, cluster_vars: Iterable[str] | None = None) -> DataFrame:
        return co.occurrence_rate(self._maps(cluster_vars), self.cube.cells)

    def cluster_consistency(self, cluster_vars: Iterable[str] | None = None) -> DataFrame:
        return co.jaccard_consistency(self._maps(cluster_vars), self.cube.cells)

    def cluster_consensus(self, cluster_vars: Iterable[str] | None = None, min_consensus: float = 0.75, top_n_clusters: int | None = None, neighbor_connectivity: int = 8, regridder: cl.HealPixRegridder | None = None, k_neighbors: int = 8) -> tuple[DataFrame, DataFrame]:
        """The consensus of the cells, and the summary of its clusters over all cluster variables of the cube."""
        c = self.cube
        found = co.consensus(self._maps(cluster_vars), c.cells, c.grid_kind, min_consensus, top_n_clusters, neighbor_connectivity, k_neighbors, regridder.nside if regridder else None)
        shifts = {n: c.tables[c.catalog[n]["shifts_variable"]] for n in c.cluster_vars}
        return found, co.consensus_summary(found, c.cells, shifts, c.times)


@dataclass(frozen=True)
class Preprocess:
    cube: ShiftCube

    def preprocess(self) -> ShiftCube:
        raise NotImplementedError("there is no general preprocessing; see preprocess_variable and dimension_to_variables")

    def preprocess_variable(self, var: str, filter_func: Callable[[Column], Column], fill_value: float | None = None) -> ShiftCube:
        return replace(self.cube, grid=series.preprocess_variable(self.cube.grid, var, filter_func, fill_value))

    def dimension_to_variables(self, df: DataFrame, var: str, dim: str, keys: list[str], drop_original: bool = True, add_dim_to_name: bool = True) -> DataFrame:
        return series.dimension_to_variables(df, var, dim, keys, None, add_dim_to_name, drop_original)


@dataclass(frozen=True)
class PlotData:
    """The data of plots; drawing is left to others."""

    cube: ShiftCube

    def max_shift(self, var: str | None = None) -> DataFrame:
        return se.max_shift(self.cube.get_shifts(var))

    def time_of_max_shift(self, var: str | None = None) -> DataFrame:
        return self.max_shift(var).join(F.broadcast(self.cube.times), "t_idx").select("cell_id", "t")

    def shift_histogram(self, var: str | None = None, bins: int = 20) -> DataFrame:
        return se.shift_histogram(self.cube.get_shifts(var), bins)

    def cluster_bands(self, cluster: int, var: str | None = None) -> DataFrame:
        name = self.cube.cluster_var(var)
        return series.cluster_bands(self.cube.grid, self.cube.get_base_var(name), self.cube.tables[name], cluster)

    def sample_trajectories(self, var: str, n: int = 1000, seed: int = 0) -> DataFrame:
        return series.sample_trajectories(self.cube.grid, var, n, seed)
