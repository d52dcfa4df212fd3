"""Extension: cubes that grow by time steps.

`running_cells` keeps running statistics of each cell of a stream of (cell_id, ts, v) rows in
event-time windows; `detect_batches` keeps a table of values up to date and detects anew in the cells that a micro-batch touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detect import ShiftsMethod, detect


def running_cells(stream: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(cell_id, start, n, mean, low, high) by cell and tumbling window; rows later than the watermark are left out."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "cell_id")
    return w.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high")).select("cell_id", F.col("w.start").alias("start"), "n", "mean", "low", "high")


def detect_batches(path: str, times: list[float], method: ShiftsMethod | None = None) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function for rows (cell_id, t_idx, v): appends them under `path/values` and writes the detection of the touched cells to `path/shifts/batch=N`, so that a repeated batch overwrites its own part."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/values/batch={number}")
        values = spark.read.parquet(f"{path}/values").groupBy("cell_id", "t_idx").agg(F.max_by("v", "batch").alias("v"))
        touched = spark.read.parquet(f"{path}/values").where(F.col("batch") == number).select("cell_id").distinct()
        detect(values.join(touched, "cell_id", "left_semi"), "v", times, method).write.mode("overwrite").parquet(f"{path}/shifts/batch={number}")

    return run
