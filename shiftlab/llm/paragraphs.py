"""Substring deduplication by MinHash banding of paragraphs.

Two kinds of paragraphs are compared, both of at least `MIN_WORDS` words: lines, and windows of
`MIN_WORDS` words that begin at anchors of the text (where a hash of three words is the least of
its neighbourhood), which also find a passage that was put into the middle of a line. A
passage of 50 words holds several anchors, the same ones in all documents; a run of one word has
one at its start and one at every `MIN_WORDS` further.

Both get MinHash signatures over shingles of five words: lines `BANDS` bands of `BAND_ROWS` minima, so that of two with
a Jaccard similarity of 0.8 all but 0.08 % agree in a band; windows, of which a passage has several, one band, in which equal ones agree always and
those at 0.8 (that is, with two of 20 shingles replaced) with a chance of one half. Where paragraphs agree, their exact Jaccard similarity
decides, and connected components of the verified links are the clusters. Of each
cluster the first place (by doc_id, then by word) stays.

Equal paragraphs are collapsed before, and only paragraphs that collide are looked at again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .banding import CHUNK, colliding, linked, mixed, multipliers, spans_bands, window_bands
from .common import documents, id_text, texts, written
from .components import connected_components

SHINGLE, SIMILARITY, BANDS, BAND_ROWS = 5, 0.8, 10, 3
MIN_WORDS, AROUND = 24, 4
_MIXES = multipliers(BANDS, BAND_ROWS)
_PLACE = np.random.default_rng(43).integers(0, 1 << 63, MIN_WORDS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Words that are looked at together.
PIECE = 1 << 18


def _hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    return mixed(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))


def _rolled(h: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of the `width` words from each place (or from those `at`)."""
    at = np.arange(max(0, len(h) - width + 1)) if at is None else at
    out = np.full(len(at), width, np.uint64)
    for k in range(width):
        out += h[at + k] * _PLACE[k]
    return mixed(out)


def anchors(h: np.ndarray) -> np.ndarray:
    """The places of a text where a window begins; a text of `MIN_WORDS` words or more without any has one at its start."""
    n = len(h) - MIN_WORDS + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    g = _rolled(h, 3)
    padded = np.concatenate([np.full(AROUND, ~np.uint64(0)), g, np.full(AROUND, ~np.uint64(0))])
    near = np.ones(len(g), bool)
    for k in range(1, AROUND + 1):
        near &= (g < padded[AROUND - k : len(padded) - AROUND - k]) & (g <= padded[AROUND + k : len(padded) - AROUND + k])
    same = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h))  # a run of one word has no least place
    runs = [np.arange(a, e - MIN_WORDS + 1, MIN_WORDS) for a, e in zip(same[:-1], same[1:]) if e - a >= MIN_WORDS] if len(same) <= len(h) - MIN_WORDS + 2 else []
    at = np.unique(np.concatenate([np.flatnonzero(near[:n]), *runs]))
    return at if len(at) else np.zeros(1, np.int64)


def _lines(text: bytes) -> np.ndarray:
    """(start, end) in words of the lines with enough words."""
    ends = np.cumsum([len(x.split()) for x in text.split(b"\n")])
    spans = np.stack([np.append(0, ends[:-1]), ends], axis=1)
    return spans[spans[:, 1] - spans[:, 0] >= MIN_WORDS]


def _bands(h: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """The band hashes of the lines."""
    return spans_bands(_rolled(h, SHINGLE), spans - [0, SHINGLE - 1], _MIXES, BANDS)


def _windows(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band, check) of the windows from each of the places."""
    return window_bands(_rolled(h, SHINGLE), at, MIN_WORDS - SHINGLE + 1, _MIXES[:BAND_ROWS]), _rolled(h, MIN_WORDS, at).astype(np.uint32).view(np.int32)


_BAND_COLUMNS = [f"b{i}" for i in range(BANDS)]
_UNITS = "doc_id long, start int, end int, hash long, check int, " + ", ".join(f"{c} long" for c in _BAND_COLUMNS)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, end, hash, check, bands) of the paragraphs. Of a line, the hash of all its words and its bands; of a window, which has one length, its one band, and a check that tells apart windows that agree in it."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        ids, starts, ends, hashes, checks, bands = (np.concatenate(x) for x in zip(*rows, strict=True))
        windows = ends == 0
        columns = [pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends.astype(np.int32), mask=windows), pa.array(hashes.view(np.int64)), pa.array(checks, mask=~windows)]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(bands[:, i].view(np.int64), mask=windows) for i in range(BANDS))], names=["doc_id", "start", "end", "hash", "check", *_BAND_COLUMNS])

    for b in batches:
        rows, held = [], 0
        for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
            h = _hashes(text)
            if len(h) < MIN_WORDS:
                continue
            at = anchors(h)
            rows.append((np.full(len(at), doc), at, np.zeros(len(at), np.int64), *_windows(h, at), np.zeros((len(at), BANDS), np.uint64)))
            spans = _lines(text)
            if len(spans):
                whole = np.array([xxhash.xxh64_intdigest(h[a:e].tobytes()) for a, e in spans], np.uint64)
                rows.append((np.full(len(spans), doc), spans[:, 0], spans[:, 1], whole, np.zeros(len(spans), np.int32), _bands(h, spans)))
            held += len(h)
            if held > PIECE:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, shingles): the distinct shingle hashes of each wanted paragraph. Only the words of these are hashed, and all windows of a text together."""
    hashed = lambda words: mixed(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
    for b in batches:
        hashes, sets = [], []
        for text, wanted in zip(texts(b.column(0)), b.column(1).to_pylist(), strict=True):
            words = text.lower().split()
            windows = [w for w in wanted if w["check"] is not None and w["end"] <= len(words)]
            if windows:
                at = np.array([w["start"] for w in windows])[:, None] + np.arange(MIN_WORDS)
                needed, place = np.unique(at, return_inverse=True)
                h = hashed([words[i] for i in needed.tolist()])[place.reshape(at.shape)]
                check = mixed((h * _PLACE).sum(axis=1, dtype=np.uint64) + np.uint64(MIN_WORDS)).astype(np.uint32).view(np.int32)
                n = MIN_WORDS - SHINGLE + 1
                s = np.sort(mixed(sum((h[:, k : k + n] * _PLACE[k] for k in range(SHINGLE)), np.full((len(h), n), SHINGLE, np.uint64))), axis=1)
                for i in np.flatnonzero(check == [w["check"] for w in windows]).tolist():
                    hashes.append(windows[i]["hash"])
                    sets.append(s[i] if (s[i, 1:] != s[i, :-1]).all() else np.unique(s[i]))
            for w in wanted:
                if w["check"] is None:
                    h = hashed(words[w["start"] : w["end"]])
                    if np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64) == w["hash"]:
                        hashes.append(w["hash"])
                        sets.append(np.unique(_rolled(h, SHINGLE)))
        ends = np.cumsum([0, *map(len, sets)])
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))], names=["hash", "shingles"])


def repeats(docs: DataFrame, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, start, end, cluster, first): the paragraphs, in words, that repeat across documents, with the cluster of each and whether it is the place that stays.

    Null, empty and shorter texts have no paragraphs. Rows without an id are left out. Rows that
    repeat an id count as one document. Empty tables give no rows.
    """
    docs = id_text(docs).where("doc_id is not null and text is not null")
    units = written(docs.mapInArrow(_units, _UNITS))
    lines = units.where("end is not null")
    windows = units.where("end is null").select("doc_id", "start", F.col("hash").alias("value"), "check")

    # windows that agree with one of another document; where all of them are equal there is nothing to verify
    repeated = windows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("value")
    agreeing = written(windows.join(repeated, "value").distinct())
    shared = agreeing.groupBy("value").agg(F.min("check").alias("low"), F.max("check").alias("high"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("value", (F.col("low") != F.col("high")).alias("mixed"))
    found = written(agreeing.join(shared, "value").select("doc_id", "start", (F.col("start") + MIN_WORDS).alias("end"), F.xxhash64("value", "check").alias("hash"), "value", "check", "mixed"))
    differing = found.where("mixed")
    distinct = lines.groupBy("hash").agg(*[F.first(c).alias(c) for c in _BAND_COLUMNS])
    met = colliding(distinct.select(F.explode(F.array(*_BAND_COLUMNS)).alias("value"), "hash")).unionByName(colliding(differing.select("value", "hash").distinct()))

    columns = ["hash", "check", "doc_id", "start", "end"]
    places = lines.select(*columns).join(met.select("hash").distinct(), "hash").unionByName(differing.select(*columns)).groupBy("hash").agg(F.min(F.struct("doc_id", "start", "end", "check")).alias("p"))
    wanted = places.groupBy("p.doc_id").agg(F.collect_list(F.struct("hash", "p.start", "p.end", "p.check")).alias("wanted"))
    # of rows that repeat an id with other texts, only those that hold the paragraph have it
    sets = written(docs.join(wanted, "doc_id").select("text", "wanted").mapInArrow(_sets, "hash long, shingles array<long>").dropDuplicates(["hash"]))
    clusters = connected_components(linked(met, sets, similarity, chunk)).select(F.col("id").alias("hash"), F.col("component").alias("cluster"))

    out = None
    for part in (found, lines):  # every paragraph belongs to the cluster of its own hash at least
        named = part.select("hash", "doc_id", "start", "end").join(clusters, "hash", "left").select("doc_id", "start", "end", F.coalesce("cluster", "hash").alias("cluster"))
        several = named.groupBy("cluster").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("other")).where("head < other").select("cluster", "head")
        members = written(named.join(several, "cluster").distinct())
        starts = members.where("doc_id = head").groupBy("cluster").agg(F.min("start").alias("from"))
        one = members.join(starts, "cluster").select("doc_id", "start", "end", "cluster", ((F.col("doc_id") == F.col("head")) & (F.col("start") == F.col("from"))).alias("first"))
        out = one if out is None else out.unionByName(one)
    return out


def _merged(spans: F.Column) -> F.Column:
    """The union of sorted (start, end) spans."""
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    joins = lambda acc, x: (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"])
    return F.aggregate(
        spans, none,
        lambda acc, x: F.when(joins(acc, x), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )


def removals(found: DataFrame) -> DataFrame:
    """(doc_id, removed, clusters, n_repeats) for each document of `repeats`: the word spans to remove, joined where they meet, and the clusters that it takes part in."""
    later = F.array_sort(F.collect_set(F.when(~F.col("first"), F.struct("start", "end"))))
    rows = found.groupBy("doc_id").agg(later.alias("spans"), F.array_sort(F.collect_set("cluster")).alias("clusters"), F.count(F.lit(1)).alias("n_repeats"))
    return rows.select("doc_id", _merged(F.col("spans")).alias("removed"), "clusters", "n_repeats")


def deduplicated(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """`docs` with the words of the removed spans, and the white space after each, cut out of `text`; rows without removals stay as they are."""
    at, columns = docs.columns.index("text"), docs.columns
    spans = removed.where(F.size("removed") > 0).select(F.col("doc_id").alias("removed_id"), F.col("removed").alias("removed_spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, cuts in zip(texts(b.column(at)), b.column(len(columns)).to_pylist(), strict=True):
                if text is not None and cuts:
                    places = [m.start() for m in _WORD.finditer(text)] + [len(text)]
                    for c in reversed(cuts):
                        text = text[: places[min(c["start"], len(places) - 1)]] + text[places[min(c["end"], len(places) - 1)] :]
                out.append(None if text is None else text.decode())
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, pa.string()), *b.columns[at + 1 : len(columns)]], names=columns)

    return docs.join(spans, F.col("doc_id") == F.col("removed_id"), "left").select(*[docs[c] for c in columns], "removed_spans").mapInArrow(run, docs.schema)


def op8_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_removed, removed, clusters, n_repeats) of the documents that share a paragraph with another."""
    found = removals(repeats(documents(spark, sf_dir)))
    words = F.aggregate("removed", F.lit(0), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", words.alias("n_removed"), "removed", "clusters", "n_repeats")
