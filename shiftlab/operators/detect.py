"""Abrupt-shift detection: a detection time series in [-1, 1] for each cell.

`detect` gathers each cell's series once and runs a vectorised kernel on Arrow batches of
series. `detect_sql` is the same detector as a plan of joins and aggregations without Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LMIN = 5


def polyfit(x: np.ndarray, y: np.ndarray, deg: int) -> np.ndarray:
    """Coefficients of the least-squares polynomial, highest power first; one column of them for each column of y."""
    return np.polyfit(x, y, deg)


class ShiftsMethod(Protocol):
    """A user's detector: one series in, one of the same length out."""

    def fit_predict(self, values_1d: np.ndarray, times_1d: np.ndarray) -> np.ndarray: ...


@dataclass(frozen=True)
class ASDETECT:
    """Segments of each length from lmin to lmax; those whose slope is an outlier among slopes vote.

    `timescale` (low, high) in units of time replaces the lengths. Mode `two_sided` cuts from both
    ends, `original` from the middle.
    """

    lmin: int = LMIN
    lmax: int | None = None
    timescale: tuple[float | None, float | None] | None = None
    segmentation: str = "two_sided"
    ignore_nan_warnings: bool = False

    def lengths(self, times: np.ndarray) -> tuple[int, int]:
        n = len(times)
        low, high = self.lmin, n // 3 if self.lmax is None else self.lmax
        if self.timescale is not None:
            step = np.diff(times)
            if len(step) and not np.allclose(step, step[0], rtol=1e-3):
                raise ValueError("timescale needs evenly spaced times")
            dt = float(step[0]) if len(step) else 1.0
            short, long = self.timescale
            low = LMIN if short is None else int(short / dt)
            high = n // 3 if long is None else min(int(long / dt), n // 3)
            if low < LMIN:
                raise ValueError(f"timescale is too short: segments need {LMIN} steps")
        if self.segmentation not in ("two_sided", "original"):
            raise ValueError(f"unknown segmentation {self.segmentation!r}")
        if not low < high <= n:
            raise ValueError(f"segment lengths {low} to {high} don't fit a series of {n} steps")
        return low, high

    def block(self, values: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Detects in all rows of `values` (cells x steps), none with missing values."""
        low, high = self.lengths(times)
        cells, n = values.shape
        votes, cover = np.zeros((cells, n)), np.zeros(n)
        for length in range(low, high + 1):
            m = n // length
            starts = (0, n - m * length) if self.segmentation == "two_sided" else ((n - m * length) // 2,)
            slopes = []
            for s in starts:
                x = times[s : s + m * length].reshape(m, length)
                y = values[:, s : s + m * length].reshape(cells, m, length)
                sx, sy = x.sum(axis=1), y.sum(axis=2)
                below = length * (x * x).sum(axis=1) - sx * sx
                above = length * (x * y).sum(axis=2) - sx * sy
                slopes.append(np.divide(above, below, out=np.zeros_like(above), where=below != 0))
            every = np.concatenate(slopes, axis=1)
            median = np.median(every, axis=1, keepdims=True)
            spread = np.median(np.abs(every - median), axis=1, keepdims=True)
            for s, own in zip(starts, slopes, strict=True):
                away = own - median
                votes[:, s : s + m * length] += np.repeat(np.where(np.abs(away) > 3 * spread, np.sign(away), 0.0), length, axis=1)
                cover[s : s + m * length] += 1
        return votes / (cover.max() if self.segmentation == "two_sided" else high - low + 1)

    def fit_predict(self, values_1d: np.ndarray, times_1d: np.ndarray) -> np.ndarray:
        return self.block(np.asarray(values_1d, dtype=float)[None, :], np.asarray(times_1d, dtype=float))[0]


@dataclass(frozen=True)
class MeanDifference:
    """A simple detector: the mean of the `window` steps from a step on less that of those before it, over the series' range."""

    window: int = 10

    def fit_predict(self, values_1d: np.ndarray, times_1d: np.ndarray) -> np.ndarray:
        v, w = np.asarray(values_1d, dtype=float), self.window
        out, reach = np.zeros(len(v)), np.ptp(v) if len(v) else 0.0
        if reach > 0 and len(v) >= 2 * w:
            c = np.concatenate([[0.0], np.cumsum(v)])
            i = np.arange(w, len(v) - w + 1)
            out[i] = np.clip(((c[i + w] - c[i]) - (c[i] - c[i - w])) / w / reach, -1, 1)
        return out


def cell_status(grid: DataFrame, value: str, n_t: int) -> DataFrame:
    """(cell_id, n_valid, constant, all_null, gappy, valid): which cells a detector can use; NaN counts as missing."""
    v = F.when(~F.isnan(value), F.col(value))
    s = grid.groupBy("cell_id").agg(F.count(v).alias("n_valid"), F.min(v).alias("low"), F.max(v).alias("high"))
    none, constant = F.col("n_valid") == 0, F.coalesce(F.col("low") == F.col("high"), F.lit(False))
    gappy = ~none & ~constant & (F.col("n_valid") < n_t)
    return s.select("cell_id", "n_valid", constant.alias("constant"), none.alias("all_null"), gappy.alias("gappy"), (~none & ~constant & ~gappy).alias("valid"))


def series(grid: DataFrame, value: str) -> DataFrame:
    """(cell_id, t_idx, v): each cell's steps and values as arrays in order of time, cells without a value left out."""
    v = F.when(~F.isnan(value), F.col(value))
    rows = grid.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("t_idx", v.alias("v")))).alias("s"))
    rows = rows.where(F.exists("s", lambda x: x["v"].isNotNull()))
    return rows.select("cell_id", F.transform("s", lambda x: x["t_idx"]).alias("t_idx"), F.transform("s", lambda x: x["v"]).alias("v"))


def detect(grid: DataFrame, value: str, times: list[float], method: ShiftsMethod | None = None) -> DataFrame:
    """(cell_id, t_idx, dts) of the cells with a value at every step that isn't always the same.

    `times`: the cube's time axis. One shuffle by cell; a task holds a batch of series at a time.
    """
    method, n = method or ASDETECT(), len(times)
    axis = np.asarray(times, dtype=float)
    if isinstance(method, ASDETECT):
        method.lengths(axis)
    v = F.when(~F.isnan(value), F.col(value).cast("double"))
    rows = grid.groupBy("cell_id").agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.array_sort(F.collect_list(F.struct("t_idx", v.alias("v")))).alias("s"))
    usable = rows.where((F.col("n") == n) & (F.col("low") < F.col("high"))).select("cell_id", F.transform("s", lambda x: x["v"]).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, n)
            if isinstance(method, ASDETECT):
                out = method.block(values, axis)
            else:
                out = np.array([method.fit_predict(row, axis) for row in values], dtype=float)
                if out.shape != values.shape:
                    raise ValueError("a detector must return one value for each step")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, n), pa.int32()), pa.array(out.ravel()))], names=["cell_id", "dts"])

    found = usable.mapInArrow(run, "cell_id long, dts array<double>")
    return found.select("cell_id", F.posexplode("dts").alias("t_idx", "dts"))


def detect_sql(grid: DataFrame, value: str, n_t: int, lmin: int = LMIN, lmax: int | None = None) -> DataFrame:
    """Two-sided ASDETECT on step numbers, of built-in operators only; segments meet steps by an equi-join."""
    high = n_t // 3 if lmax is None else lmax
    if not lmin < high <= n_t:
        raise ValueError(f"segment lengths {lmin} to {high} don't fit a series of {n_t} steps")
    spark = grid.sparkSession
    usable = cell_status(grid, value, n_t).where("valid").select("cell_id")
    points = grid.join(usable, "cell_id", "left_semi").select("cell_id", F.col("t_idx").alias("t"), F.col(value).alias("v"))
    lengths = spark.range(lmin, high + 1).select(F.col("id").cast("int").alias("l"), F.floor(F.lit(n_t) / F.col("id")).cast("int").alias("m"))
    twice = lengths.select("l", "m").select("l", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("k"), "m")
    segments = twice.select("l", "k", F.explode(F.array(F.struct(F.lit(0).alias("d"), (F.col("k") * F.col("l")).alias("s")), F.struct(F.lit(1).alias("d"), (F.col("k") * F.col("l") + n_t - F.col("l") * F.col("m")).alias("s")))).alias("x")).select("l", "k", "x.d", "x.s")
    steps = F.broadcast(segments.select("l", "d", "k", F.explode(F.sequence("s", F.col("s") + F.col("l") - 1)).alias("t")))  # at most 2 * lmax * n_t rows
    held = points.join(steps, "t")
    t, v, l = F.col("t").cast("double"), F.col("v"), F.col("l")
    sums = held.groupBy("cell_id", "l", "d", "k").agg(F.sum(t * v).alias("xy"), F.sum(t).alias("x"), F.sum(v).alias("y"), F.sum(t * t).alias("xx"))
    slopes = sums.select("cell_id", "l", "d", "k", F.coalesce(F.try_divide(l * F.col("xy") - F.col("x") * F.col("y"), l * F.col("xx") - F.col("x") * F.col("x")), F.lit(0.0)).alias("slope"))
    w = Window.partitionBy("cell_id", "l")
    away = slopes.withColumn("away", F.col("slope") - F.percentile("slope", F.lit(0.5)).over(w))
    vote = away.withColumn("spread", F.percentile(F.abs("away"), F.lit(0.5)).over(w)).select("cell_id", "l", "d", "k", F.when(F.abs("away") > 3 * F.col("spread"), F.signum("away")).otherwise(0.0).alias("vote"))
    total = vote.join(steps, ["l", "d", "k"]).groupBy("cell_id", "t").agg(F.sum("vote").alias("votes"), F.count(F.lit(1)).alias("n"))
    return total.select("cell_id", F.col("t").alias("t_idx"), (F.col("votes") / F.max("n").over(Window.partitionBy("cell_id"))).alias("dts"))


def moving_difference(grid: DataFrame, value: str, window: int = 10) -> DataFrame:
    """`MeanDifference` as window functions."""
    w = Window.partitionBy("cell_id").orderBy("t_idx")
    whole = Window.partitionBy("cell_id")
    before, after = w.rowsBetween(-window, -1), w.rowsBetween(0, window - 1)
    reach = F.max(value).over(whole) - F.min(value).over(whole)
    full = (F.count(value).over(before) == window) & (F.count(value).over(after) == window)
    step = F.try_divide(F.avg(value).over(after) - F.avg(value).over(before), reach)
    return grid.select("cell_id", "t_idx", F.when(full & (reach > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), step))).otherwise(0.0).alias("dts"))


def shift_summary(shifts: DataFrame, status: DataFrame) -> DataFrame:
    """One row: the least, mean and largest shift, and how many cells were used and skipped for what."""
    a = shifts.agg(F.min("dts").alias("min_shift"), F.avg("dts").alias("mean_shift"), F.max("dts").alias("max_shift"))
    count = lambda c: F.count_if(F.col(c)).alias(f"n_{c}")
    return a.crossJoin(status.agg(count("valid"), count("constant"), count("all_null"), count("gappy")))
