"""Selection of shift points: thresholds and peaks of detection series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def _sign(c: Column) -> Column:
    return F.when(c < 0, -1).otherwise(1)


def directed(points: DataFrame, direction: str = "both") -> DataFrame:
    if direction not in ("both", "positive", "negative"):
        raise ValueError("shift_direction is both, positive or negative")
    return points if direction == "both" else points.where(F.col("sign") == (1 if direction == "positive" else -1))


def above(shifts: DataFrame, threshold: float, direction: str = "both") -> DataFrame:
    """(cell_id, t_idx, sign, dts): the points beyond the threshold."""
    v = F.col("dts")
    test = {"both": F.abs(v) > threshold, "positive": v > threshold, "negative": v < -threshold}.get(direction)
    if test is None:
        raise ValueError("shift_direction is both, positive or negative")
    return shifts.where(test).select("cell_id", "t_idx", _sign(v).cast("tinyint").alias("sign"), "dts")


def _middles(marked: DataFrame, keys: list[str], shifts: DataFrame) -> DataFrame:
    """Of each group of (cell_id, t_idx, size), the middle between the first and last step that come up to its largest size."""
    w = Window.partitionBy(*keys)
    top = marked.withColumn("top", F.max("size").over(w)).withColumn("start", F.min(F.when(F.col("size") == F.col("top"), F.col("t_idx"))).over(w))
    plateau = top.where((F.abs(F.col("size") - F.col("top")) <= EPS) & (F.col("t_idx") >= F.col("start")))
    peaks = plateau.groupBy(*keys).agg(F.min("start").alias("start"), F.max("t_idx").alias("end"))
    at = peaks.select("cell_id", (F.col("start") + F.floor((F.col("end") - F.col("start")) / 2)).cast("int").alias("t_idx"))
    return at.join(shifts, ["cell_id", "t_idx"]).select("cell_id", "t_idx", _sign(F.col("dts")).cast("tinyint").alias("sign"), "dts")


def local_peaks(shifts: DataFrame, threshold: float) -> DataFrame:
    """One point for each maximal run of steps beyond the threshold, whatever their signs; a missing step or value ends a run."""
    v = shifts.where(F.col("dts").isNotNull() & ~F.isnan("dts"))
    beyond = v.where(F.abs("dts") > threshold).select("cell_id", "t_idx", F.abs("dts").alias("size"))
    run = F.col("t_idx") - F.row_number().over(Window.partitionBy("cell_id").orderBy("t_idx"))
    return _middles(beyond.withColumn("run", run), ["cell_id", "run"], v)


def global_peaks(shifts: DataFrame, threshold: float) -> DataFrame:
    """One point for each cell whose largest size is beyond the threshold: the middle of the first run of it."""
    v = shifts.where(F.col("dts").isNotNull() & ~F.isnan("dts")).withColumn("size", F.abs("dts"))
    w = Window.partitionBy("cell_id")
    top = v.withColumn("top", F.max("size").over(w)).where((F.col("top") > threshold) & (F.abs(F.col("size") - F.col("top")) <= EPS))
    top = top.withColumn("first", F.min(F.when(F.col("size") == F.col("top"), F.col("t_idx"))).over(w)).where("t_idx >= first")
    run = F.col("t_idx") - F.row_number().over(w.orderBy("t_idx"))
    own = top.withColumn("run", run).withColumn("lead", F.min("run").over(w)).where("run = lead")
    return _middles(own.select("cell_id", "t_idx", "size"), ["cell_id"], v.drop("size"))


def select_points(shifts: DataFrame, threshold: float = 0.5, direction: str = "both", selection: str = "local") -> DataFrame:
    """(cell_id, t_idx, sign, dts) of the points that are clustered: `all` beyond the threshold, or `local` or `global` peaks."""
    if threshold < 0:
        raise ValueError("shift_threshold must not be negative")
    if selection == "all":
        return above(shifts, threshold, direction)
    if selection not in ("local", "global"):
        raise ValueError("shift_selection is local, global or all")
    return directed((local_peaks if selection == "local" else global_peaks)(shifts, threshold), direction)


def transition_time(shifts: DataFrame, times: DataFrame, threshold: float = 0.5, cells: DataFrame | None = None) -> DataFrame:
    """(cell_id, t_idx, t): the time of each cell's global peak; of all `cells` if given, NULL for those without one."""
    found = global_peaks(shifts, threshold).select("cell_id", "t_idx").join(F.broadcast(times), "t_idx").select("cell_id", "t_idx", "t")
    return found if cells is None else cells.select("cell_id").join(found, "cell_id", "left")


def max_shift(shifts: DataFrame) -> DataFrame:
    """(cell_id, t_idx, dts): the largest shift of each cell with its sign, the first of equal ones."""
    w = Window.partitionBy("cell_id").orderBy(F.abs("dts").desc(), "t_idx")
    return shifts.where(F.col("dts").isNotNull()).withColumn("r", F.row_number().over(w)).where("r = 1").select("cell_id", "t_idx", "dts")


def shift_histogram(shifts: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, n): the number of values in each of `bins` equal parts of [-1, 1], the last one closed; parts without any are there too."""
    at = F.least(F.floor((F.col("dts") + 1) * bins / 2), F.lit(bins - 1)).cast("int")
    n = shifts.where(F.col("dts").between(-1, 1)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = shifts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(n), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
