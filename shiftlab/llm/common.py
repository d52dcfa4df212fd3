"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpoint_dir, cut  # noqa: F401

_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that operators wrote inside, whose results must be read or written inside too."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any of Spark's file systems."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame) -> DataFrame:
    """Writes `df` as a Parquet table in the shared folder and reads it again. The table stays unless it is made inside `scratch`."""
    path = f"{checkpoint_dir(df.sparkSession)}/shiftlab-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the id and the text, under names that cannot clash with other columns of `docs`."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def remainder(doc_id: str, n: int) -> F.Column:
    """crc32(doc_id as text) mod n; NULL for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The connected components of the edges (a, b), as edges from each node to the smallest of its component."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = inv[: len(a)], inv[len(a) :], np.arange(len(ids))
    while True:
        lx, ly = label[x], label[y]
        apart = lx != ly
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(lx[apart], ly[apart]), np.minimum(lx[apart], ly[apart]))
        while (label != (up := label[label])).any():
            label = up
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]
