"""NetCDF files as long rows, where a reader library is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_netcdf(spark: SparkSession, path: str, variables: list[str] | None = None) -> DataFrame:
    """The variables of a file over its dimensions; needs xarray on the driver, whose memory must hold the file. Larger data belong in Parquet."""
    try:
        import xarray
    except ImportError as e:
        raise RuntimeError("reading NetCDF needs xarray; convert the file to Parquet rows and use ShiftCube.from_dataframe") from e
    with xarray.open_dataset(path) as ds:
        frame = ds[variables or list(ds.data_vars)].to_dataframe().reset_index()
    return spark.createDataFrame(frame)
