"""Numeric time values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds_since_first(df: DataFrame, time: str, into: str = "t") -> DataFrame:
    """Timestamps as whole seconds since the first one; numbers stay as doubles."""
    if dict(df.dtypes)[time] in ("timestamp", "timestamp_ntz", "date"):
        first = df.agg(F.min(F.unix_seconds(F.col(time).cast("timestamp"))).alias("zero"))
        return df.crossJoin(F.broadcast(first)).withColumn(into, (F.unix_seconds(F.col(time).cast("timestamp")) - F.col("zero")).cast("double")).drop("zero")
    return df.withColumn(into, F.col(time).cast("double"))


def to_timestamp(seconds: Column, zero: Column) -> Column:
    """The timestamp of seconds since `zero`, in whole seconds."""
    return F.timestamp_seconds(F.unix_seconds(zero) + seconds.cast("long"))


def time_index(df: DataFrame, time: str = "t", into: str = "t_idx") -> DataFrame:
    """(time, index) of the distinct steps in order. The steps are a cube's time axis, which is small beside its cells."""
    steps = df.select(time).where(F.col(time).isNotNull()).distinct()
    return steps.withColumn(into, (F.row_number().over(Window.orderBy(time)) - 1).cast("int"))
