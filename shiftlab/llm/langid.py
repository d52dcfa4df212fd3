"""Language identification: multinomial naive Bayes over hashed character n-grams.

N-grams of two and three characters of the lower-cased text (runs of ASCII other than letters
count as one kind of space) are hashed to 2^16 buckets. The matrix of log-probabilities (buckets x languages,
of a size fixed by these numbers) goes to the tasks, which score whole texts in numpy: the rows of the
n-grams that occur are gathered and summed by document.

At most `max_labelled` documents are learned from (those with the smallest hash of their id).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, remainder, texts

BITS, MAX_LABELLED, MAX_LANGUAGES = 16, 20_000, 1000
#: Characters that are looked at together.
PIECE = 1 << 18
_SPACE = np.arange(128, dtype=np.uint32)
_SPACE[[i for i in range(128) if not chr(i).isalpha()]] = 32
_MIX = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917)]


def _codes(text: bytes | None) -> np.ndarray:
    c = np.frombuffer((b" " + (text or b"") + b" ").decode().lower().encode("utf-32-le"), dtype=np.uint32)
    return np.where(c < 128, _SPACE[np.minimum(c, 127)], c)


def _buckets(codes: np.ndarray) -> Iterator[np.ndarray]:
    """The buckets of the n-grams of two and of three characters, each place once, in parts for long texts."""
    for n in (2, 3):
        for begin in range(0, max(1, len(codes) - n + 1), PIECE):
            part = codes[begin : begin + PIECE + n - 1]
            h = np.full(max(0, len(part) - n + 1), n, dtype=np.uint32)
            for i in range(n):
                h = (h ^ part[i : len(part) - n + 1 + i]) * _MIX[i]
                h ^= h >> np.uint32(15)
            yield h & np.uint32((1 << BITS) - 1)


@dataclass(frozen=True)
class Languages:
    names: list[str]
    prior: np.ndarray
    log_p: np.ndarray  # buckets x languages, float32

    def predict(self, text: bytes | None) -> tuple[str, float]:
        """The likeliest language and its posterior probability; ties go to the first in order of names; ('und', 0.0) without a letter or a learned language."""
        if not text or not self.names or not any(map(str.isalpha, text.decode())):
            return "und", 0.0
        total = self.prior.copy()
        for at in _buckets(_codes(text)):
            total += self.log_p[at].sum(axis=0, dtype=np.float64)
        p = np.exp(total - total.max())
        best = int(total.argmax())
        return self.names[best], float(p[best] / p.sum())


def fit(docs: DataFrame, held_out: bool = True, max_labelled: int = MAX_LABELLED, smoothing: float = 0.5) -> Languages:
    """Learns from rows with an id, a text and a language, with `held_out` only from those with crc32(doc_id as text) mod 5 other than 0."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null and text is not null and lang is not null")
    if held_out:
        known = known.where(remainder("doc_id", 5) != 0)
    chosen = known.select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(max_labelled).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                c = counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
                seen[lang] = seen.get(lang, 0) + 1
                for at in _buckets(_codes(text)):
                    c += np.bincount(at, minlength=1 << BITS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(c[at], seen[lang]))], names=["lang", "bucket", "n"])

    rows = known.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text").mapInArrow(count, "lang string, bucket int, n long")
    table = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(table.column("lang").to_pylist()))
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"{len(names)} languages; the matrix is bounded by {MAX_LANGUAGES}")
    index = {x: i for i, x in enumerate(names)}
    at, lang, n = table.column("bucket").to_numpy(), np.array([index[x] for x in table.column("lang").to_pylist()], dtype=int), table.column("n").to_numpy()
    counts, docs_of = np.zeros((1 << BITS, len(names))), np.zeros(len(names))
    counts[at[at >= 0], lang[at >= 0]] = n[at >= 0]
    docs_of[lang[at < 0]] = n[at < 0]
    counts += smoothing
    return Languages(names, np.log(np.maximum(docs_of, 1) / max(1, docs_of.sum())), np.log(counts / counts.sum(axis=0)).astype(np.float32))


def predict(docs: DataFrame, model: Languages) -> DataFrame:
    """(doc_id, lang_pred, score) for every row; `und` and 0.0 for a text that is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(t) for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; a null id isn't held out and nothing is learned from it."""
    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs)).select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
