"""Synthetic cubes with known shifts, as column expressions."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import geodetic_to_cartesian


def _blob(lat: Column, lon: Column, at: tuple[float, float], width: tuple[float, float]) -> Column:
    """A bell over the place, periodic in longitude; 1 at its centre."""
    bell = lambda turn: F.exp(-0.5 * (((lat - at[0]) / width[0]) * ((lat - at[0]) / width[0]) + ((lon - at[1] + turn) / width[1]) * ((lon - at[1] + turn) / width[1])))
    return F.least(F.lit(1.0), bell(0.0) + bell(360.0) + bell(-360.0))


def _normal(*about: Column | int) -> Column:
    """A standard normal number that is a function of `about`."""
    even = lambda salt: (F.pmod(F.xxhash64(*[F.lit(x) if isinstance(x, int) else x for x in about], F.lit(salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return F.sqrt(-2 * F.log(even(1))) * F.cos(6.283185307179586 * even(2))


def add_shift_blob(cube: DataFrame, axis: Sequence[float], at: tuple[float, float] = (0.0, 0.0), width: tuple[float, float] = (10.0, 20.0), step: float = 50, size: float = 1.0, steepness: float = 2.0, sigma: float = 1.0, number: int = 1, seed: int = 42) -> DataFrame:
    """Adds a sigmoid step to `value` where the blob is over 0.5, in each cell at the step drawn around `step` with a spread of `sigma` steps, and 1 to `shift_label` at that step alone; `axis`: the time of each step."""
    inside = _blob(F.col("lat"), F.col("lon"), at, width) > 0.5
    drawn = F.greatest(F.lit(0), F.least(F.lit(len(axis) - 1), (step + sigma * _normal(F.col("cell_id"), seed + number)).cast("int")))
    late = F.element_at(F.array(*map(F.lit, map(float, axis))), drawn + 1)
    jump = size / (1 + F.exp(-steepness * (F.col("t") - late)))
    return cube.withColumns({"value": F.when(inside, F.col("value") + jump).otherwise(F.col("value")), "shift_label": F.when(inside & (F.col("t_idx") == drawn), 1).otherwise(F.col("shift_label"))})


def shift_parameters(n_shifts: int = 3, random_seed: int = 42) -> list[dict[str, float]]:
    """The shifts that `global_dataset` puts in: place, widths, step, steepness and size of each, drawn from the seed."""
    rng = random.Random(random_seed)
    steps = [int(20 + 50 * k / max(1, n_shifts - 1)) for k in range(n_shifts)]
    return [{"center_lat": rng.uniform(-80, 80), "center_lon": rng.uniform(-180, 180), "center_time": s, "sigma_lat": rng.uniform(10, 20), "sigma_lon": rng.uniform(15, 40), "sigma_time": 1.0, "steepness": rng.uniform(1.5, 3.0), "magnitude": rng.uniform(0.95, 1.05)} for s in steps]


def global_dataset(spark: SparkSession, lat_size: int = 90, lon_size: int = 180, time_size: int = 80, background_trend: float = 0.0, background_noise: float = 0.005, n_shifts: int = 3, random_seed: int = 42) -> DataFrame:
    """(cell_id, y_idx, x_idx, t_idx, lat, lon, t, value, shift_label): noise with a trend, and the shifts of `shift_parameters`; shift_label is 1 at the step of a cell's shift.

    All draws are functions of the cell, the step and the seed, so they don't depend on how the rows are dealt out.
    """
    n = lat_size * lon_size * time_size
    i = F.col("id")
    y, x, t = F.floor(i / (lon_size * time_size)).cast("int"), F.floor(i / time_size).cast("long") % lon_size, (i % time_size).cast("int")
    at = lambda k, size, low, high: low + k * ((high - low) / max(1, size - 1))
    base = spark.range(n).select(y.alias("y_idx"), x.cast("int").alias("x_idx"), t.alias("t_idx"), _normal(i, random_seed).alias("noise"))
    cube = base.select((F.col("y_idx").cast("long") * lon_size + F.col("x_idx")).alias("cell_id"), "y_idx", "x_idx", "t_idx", at(F.col("y_idx"), lat_size, -90.0, 90.0).alias("lat"), at(F.col("x_idx"), lon_size, -180.0, 180.0).alias("lon"), at(F.col("t_idx"), time_size, 0.0, 100.0).alias("t"), "noise")
    cube = cube.select("cell_id", "y_idx", "x_idx", "t_idx", "lat", "lon", "t", (background_trend * F.col("t") + background_noise * F.col("noise")).alias("value"), F.lit(0).alias("shift_label"))
    axis = [at(k, time_size, 0.0, 100.0) for k in range(time_size)]
    for k, p in enumerate(shift_parameters(n_shifts, random_seed)):
        cube = add_shift_blob(cube, axis, (p["center_lat"], p["center_lon"]), (p["sigma_lat"], p["sigma_lon"]), p["center_time"], p["magnitude"], p["steepness"], p["sigma_time"], k + 1, random_seed)
    return cube


def add_xyz(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds WGS84 columns x, y, z in km."""
    x, y, z = geodetic_to_cartesian(F.col(lat), F.col(lon))
    return df.withColumns({"x": x, "y": y, "z": z})
