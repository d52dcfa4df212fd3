"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text. The weights are learned from
all preference pairs (a document labelled 1 is preferred to one labelled 0) by logistic loss on
the difference of their features. The threshold is the quantile of all training documents'
strengths that leaves as large a share below it as is labelled 0; scores are the logistic
function of the distance to it, so 0.5 is the threshold.

All labelled documents are learned from. Their features stay in a table; at each Newton step tasks add up
counts, features and products of features by label and narrow bin of strength, from which the driver sums the loss of all pairs (the two
moments of a bin leave an error below 1e-4 of the gradient). Only a sum for each bin reaches the driver, whatever the
number of documents. With `max_labelled` at most as many are learned from, and at most `max_pairs` pairs, in the driver's memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_text, remainder, texts, written

#: Pairs of `learn`.
MAX_PAIRS = 40_000
#: Width of a bin of strengths, rows of a task that adds up, steps of features when they are added up (so that sums are exact, whatever the order), rows of a quantile's last bracket.
WIDTH, TASK, STEPS, BRACKET = 1 / 16, 200_000, 1 << 12, 10_000
FEATURES = (
    "log_words", "log_chars", "word_length", "upper", "digits", "symbols", "bangs", "bars", "stops", "commas", "wide",
    "distinct", "guiraud", "repeats", "pairs_distinct", "line_words", "lines_distinct", "short_words", "long_words", "symbol_words",
)

_UPPER, _DIGIT, _SYMBOL, _WIDE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*+<=>@\\^_`{}~[]", bytes(range(128, 256))


def features(text: bytes | None) -> list[float]:
    """The features of one whole text; a null text counts as empty. All are finite, whatever the text."""
    b = text or b""
    words, lines = b.split(), b.split(b"\n")
    n, m = len(words), max(1, len(b))
    count = lambda letters: (len(b) - len(b.translate(None, letters))) / m
    held = sum(map(len, words))
    distinct, pairs = len(set(words)), len(set(zip(words, words[1:])))
    sizes = [len(w) for w in words]
    plain = b.translate(None, _SYMBOL).split()
    k = max(1, n)
    return [
        np.log1p(n), np.log1p(len(b)), held / k, count(_UPPER), count(_DIGIT), count(_SYMBOL), count(b"!"), count(b"|"), count(b"."), count(b","), count(_WIDE),
        distinct / k, distinct / np.sqrt(k), sum(map(bytes.__eq__, words, words[1:])) / k, pairs / max(1, n - 1), np.log1p(n / len(lines)), len(set(lines)) / len(lines),
        sum(x <= 3 for x in sizes) / k, sum(x >= 12 for x in sizes) / k, (n - sum(map(bytes.__eq__, words, plain)) if len(plain) == n else n) / k,
    ]


@dataclass(frozen=True)
class Ranker:
    """strength = (features - centre) / scale . weights; score = logistic(strength - threshold)."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.strengths(x) - self.threshold
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def learn(x: np.ndarray, y: np.ndarray, max_pairs: int = MAX_PAIRS, decay: float = 1e-3, rounds: int = 30, seed: int = 42) -> Ranker:
    """Newton steps on the mean logistic loss of feature differences. Without both labels every score is 0.5."""
    k = x.shape[1]
    better, worse = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(better) or not len(worse):
        return Ranker(np.zeros(k), np.ones(k), np.zeros(k), 0.0)
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1
    z, rng = np.clip((x - centre) / scale, -8, 8), np.random.default_rng(seed)
    pairs = max_pairs if len(better) * len(worse) > max_pairs else len(better) * len(worse)
    d = z[rng.choice(better, pairs)] - z[rng.choice(worse, pairs)]
    w = np.zeros(k)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # of the worse being preferred
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + decay * np.eye(k), d.T @ p / pairs - decay * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    strengths, share = z @ w, len(worse) / len(y)
    ranked = np.sort(strengths)
    cut = min(len(ranked) - 1, max(1, round(share * len(ranked))))
    return Ranker(centre, scale, w, float((ranked[cut - 1] + ranked[cut]) / 2))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t) for t in texts(b.column(2))], pa.list_(pa.float64()))], names=["label", "place", "x"])


def _by_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t) for t in texts(b.column(1))], pa.list_(pa.float64()))], names=["doc_id", "x"])


def _binned(batches: Iterator[pa.RecordBatch], centre: np.ndarray, scale: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(label, bin, sums) of one partition: the number of rows, the sums of their scaled features and of the products of these."""
    found: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        if not b.num_rows:
            continue
        label, x = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
        z = np.rint(np.clip((x - centre) / scale, -8, 8) * STEPS) / STEPS
        place = np.floor(np.clip(z @ w, -1e6, 1e6) / WIDTH).astype(np.int64)
        order = np.lexsort((place, label))
        for rows in np.split(order, np.flatnonzero((np.diff(place[order]) != 0) | (np.diff(label[order]) != 0)) + 1):
            own, key = z[rows], (int(label[rows[0]]), int(place[rows[0]]))
            sums = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
            found[key] = found[key] + sums if key in found else sums
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int64()), pa.array(list(found.values()), pa.list_(pa.float64()))], names=["label", "bin", "sums"])


def _added(table: pa.Table) -> pa.Table:
    sums = np.sum(table.column("sums").to_pylist(), axis=0)
    return pa.table({"label": table.column("label")[:1], "bin": table.column("bin")[:1], "sums": pa.array([sums.tolist()], pa.list_(pa.float64()))})


def _newton(bins: list[tuple[int, list[float]]], w: np.ndarray, decay: float) -> np.ndarray:
    """The Newton step on the mean logistic loss of all pairs of a better (label 1) and a worse document, given as sums by bin."""
    k = len(w)
    sums = {y: np.array([s for label, s in bins if label == y]) for y in (0, 1)}
    n, z, zz = ({y: part(v) for y, v in sums.items()} for part in (lambda v: v[:, 0], lambda v: v[:, 1 : k + 1], lambda v: v[:, k + 1 :].reshape(-1, k, k)))
    at = {y: z[y] @ w / n[y] for y in sums}
    # of each better bin beside each worse one, the probability of the worse being preferred, and its slope
    p = 1 / (1 + np.exp(np.clip(at[1][:, None] - at[0][None, :], -500, 500)))
    d = p * (1 - p)
    spread = {y: zz[y] @ w - z[y] * at[y][:, None] for y in sums}  # of features with strengths inside a bin
    steep = {1: d @ n[0], 0: n[1] @ d}
    pairs = n[1].sum() * n[0].sum()
    slope = (p @ n[0]) @ z[1] - steep[1] @ spread[1] - (n[1] @ p) @ z[0] - steep[0] @ spread[0]
    cross = z[1].T @ d @ z[0]
    curve = np.tensordot(steep[1], zz[1], 1) + np.tensordot(steep[0], zz[0], 1) - cross - cross.T
    return np.linalg.solve(curve / pairs + decay * np.eye(k), slope / pairs - decay * w)


def _ranked(strengths: DataFrame, rank: int) -> float:
    """The value of `s` at a rank from 0, exactly: brackets are narrowed until few values are left."""
    low, high, n = strengths.agg(F.min("s"), F.max("s"), F.count("s")).first()
    while low < high and n > BRACKET:
        own = strengths.where(F.col("s").between(low, high))
        place = F.least(F.lit(4095), F.floor((F.col("s") - low) / (high - low) * 4096))
        for _, low, high, n in sorted(map(tuple, own.groupBy(place.alias("at")).agg(F.min("s"), F.max("s"), F.count("s")).collect())):  # noqa: B020
            if rank < n:
                break
            rank -= n
    if low == high:
        return low
    return sorted(r.s for r in strengths.where(F.col("s").between(low, high)).collect())[rank]


def _learn_all(rows: DataFrame, decay: float = 1e-3, rounds: int = 30) -> Ranker:
    """The weights and the threshold from all `rows` (label, x) and all their pairs. Without both labels every score is 0.5."""
    k = len(FEATURES)
    columns = [F.col("x")[i] for i in range(k)]
    found = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("label") == 0, 1)), *map(F.avg, columns), *map(F.stddev_pop, columns)).first()
    n, worse = found[:2]
    if worse in (0, n):
        return Ranker(np.zeros(k), np.ones(k), np.zeros(k), 0.0)
    centre, scale = (np.array([float(f"{v:.9g}") for v in part]) for part in (found[2 : k + 2], found[k + 2 :]))  # the order of rows must not change the model
    scale[scale < 1e-9] = 1
    rows, w = rows.coalesce(max(1, -(-n // TASK))), np.zeros(k)
    for _ in range(rounds):
        sums = rows.mapInArrow(lambda b, w=w: _binned(b, centre, scale, w), "label int, bin long, sums array<double>").groupBy("label", "bin").applyInArrow(_added, "label int, bin long, sums array<double>")
        step = _newton([(r.label, r.sums) for r in sorted(sums.collect(), key=lambda r: (r.label, r.bin))], w, decay)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    model = Ranker(centre, scale, w, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.strengths(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)))], names=["s"])

    strengths = written(rows.mapInArrow(run, "s double"))
    cut = min(n - 1, max(1, worse))
    return Ranker(centre, scale, w, (_ranked(strengths, cut - 1) + _ranked(strengths, cut)) / 2)


def fit(docs: DataFrame, labels: DataFrame, held_out: bool = True, max_labelled: int | None = None, max_pairs: int = MAX_PAIRS) -> Ranker:
    """Learns from all labelled documents, with `held_out` only from those with crc32(doc_id as text) mod 3 other than 1.

    Rows with a null id or a quality other than 0 and 1 teach nothing. An id with several
    labels counts once for each. With `max_labelled` only as many rows are learned from, those with the smallest hash of
    their id, and of their text where ids repeat.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    if held_out:
        known = known.where(remainder("doc_id", 3) != 1)
    if max_labelled is None:
        # features before the join, so that no text is shuffled
        of = id_text(docs).where(F.col("doc_id").isNotNull() & (remainder("doc_id", 3) != 1 if held_out else F.lit(True)))
        found = of.mapInArrow(_by_id, "doc_id long, x array<double>")
        return _learn_all(written(found.join(known, "doc_id").select("label", "x")))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_labelled)
    rows = id_text(docs).join(F.broadcast(known), "doc_id").select("label", F.xxhash64("doc_id", "text").alias("place"), "text").mapInArrow(_vectors, "label int, place long, x array<double>")
    rows = rows.orderBy("place", "label", "x").limit(max_labelled).collect()  # an id may stand for many rows
    rows.sort(key=lambda r: (r.label, r.x))  # the order of rows must not change the model
    return learn(np.array([r.x for r in rows], dtype=float).reshape(len(rows), len(FEATURES)), np.array([r.label for r in rows], dtype=int), max_pairs)


def score(docs: DataFrame, model: Ranker) -> DataFrame:
    """`docs` with `quality_score` and `quality_predicted` for every row, columns of these names being replaced; other columns stay as they are."""
    docs = docs.drop("quality_score", "quality_predicted")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in texts(b.column(at))], dtype=float).reshape(b.num_rows, len(FEATURES))
            s = model.scores(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*b.schema.names, "quality_score", "quality_predicted"])

    schema = docs.select("*", F.lit(0.0).alias("quality_score"), F.lit(0).alias("quality_predicted")).schema
    return docs.mapInArrow(run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; a null id isn't held out and nothing is learned from it."""
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(id_text(docs), model).select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))
