"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two 32-bit segments. Fingerprints that differ in at most
three bits differ in at most one bit in one of the segments (else two and two make four), so
each fingerprint enters a table of each segment and looks up the ball of radius one around
its segment there; complete distances decide. Of a pair whose segments differ in one bit, the
one with the zero bit looks up the other, so that half of the ball is enough.

Buckets of many rows are counted before and dealt in chunks that meet two by two. Equal fingerprints are collapsed before, and each task returns the components of the links
that it found instead of all pairs, so a group of copies costs one row for each member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .banding import band_hashes, colliding, linked, multipliers
from .common import cut, documents, forest, id_text, texts, written
from .components import connected_components

RADIUS = 3
#: MinHash bands of `similar`, and minima of each.
BANDS, BAND_ROWS = 32, 6
CHUNK = 1 << 16
#: Rows of a bucket that meet in one task, and buckets of more rows whose numbers of chunks are broadcast, of a few dozen bytes each.
BUCKET, MAX_HOT = 1 << 13, 100_000


def hashed(words: list[bytes], width: int) -> list[int]:
    """Hashes of the shingles of `width` words in order; one of the whole line if there are no more words than that."""
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(line, 42)]
    at = [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    return [digest(line[i : j - 1], 42) for i, j in zip(at, at[width:])]


def majority(hashes: list[int]) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(np.array(hashes[i : i + CHUNK], dtype="<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The unsigned SimHash of a text's word shingles; 0 for a text without words."""
    words = (text or b"").lower().split()
    return majority(hashed(words, width)) if words else 0


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in texts(b.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Of one partition of the tables, the forest of the links."""
    parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(5)] for b in batches if b.num_rows]
    if not parts:
        return
    seg, key, pair, fp, probe = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((probe, pair, key, seg))
    seg, key, pair, fp, probe = (x[order] for x in (seg, key, pair, fp, probe))
    where = np.cumsum(np.append(0, (seg[1:] != seg[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])))
    a, b, held = [], [], 0
    at, lag = np.arange(len(fp) - 1), 1
    while len(at := at[at + lag < len(fp)]):
        at = at[where[at] == where[at + lag]]
        at = at[~probe[at]]  # rows of the table come first in their group; two lookups don't make a pair
        near = at[np.bitwise_count((fp[at] ^ fp[at + lag]).view(np.uint64)) <= radius]  # of a negative number it would count the bits of the absolute value
        a.append(fp[near])
        b.append(fp[near + lag])
        held += len(near)
        if held > 1 << 20:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], 0
        lag += 1
    if sum(map(len, a)):
        x, y = forest(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect all fingerprints `fp` within `radius` <= 3 bits; their components are those of all such pairs. Buckets of more than `bucket` rows are dealt in chunks that meet two by two."""
    if radius > 3:
        raise ValueError("two segments with balls of radius one reach three bits")
    flips = F.expr("transform(sequence(0, 31), j -> shiftleft(1L, j))")

    def table(s: int) -> F.Column:
        own = F.shiftrightunsigned("fp", 32 * s).bitwiseAND(F.lit(0xFFFFFFFF))
        row = lambda key, probe: F.struct(F.lit(s).alias("seg"), key.alias("key"), F.lit(probe).alias("probe"))
        ball = F.transform(F.filter(flips, lambda bit: own.bitwiseAND(bit) == 0), lambda bit: row(own.bitwiseOR(bit), True))
        return F.concat(F.array(row(own, False)), ball)

    rows = distinct.select("fp", F.explode(F.concat(table(0), table(1))).alias("t")).select("t.seg", "t.key", "fp", "t.probe")
    hot = cut(rows.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("seg", "key", F.ceil(F.col("n") / bucket).cast("int").alias("chunks")))
    few = F.broadcast(hot) if hot.count() <= MAX_HOT else hot  # beyond, they meet by a shuffle
    chunks = F.coalesce("chunks", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda o: F.least(o, own) * F.lit(1 << 15) + F.greatest(o, own))
    dealt = rows.join(few, ["seg", "key"], "left").select("seg", "key", F.explode(pairs).alias("pair"), "fp", "probe")
    return dealt.repartition("seg", "key", "pair").mapInArrow(lambda b: _links(b, radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat a
    doc_id each return; a null doc_id returns with the component of its fingerprint, which
    is NULL if no id is in it. An empty table gives no rows.
    """
    fps = cut(fingerprints(docs, width))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comps = connected_components(links(distinct, radius))
    named = distinct.join(comps.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    return np.unique(np.array(hashed((text or b"").lower().split(), width), np.uint64))


def _whole(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words))


def similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, bands: int = BANDS, band_rows: int = BAND_ROWS, radius: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) of near copies with more edits than `near_duplicates` reaches: the components of the pairs of texts whose sets of shingles of `width` words have that Jaccard similarity.

    At a similarity of 0.8 fingerprints differ in ten of 64 bits on average, more than balls around segments can reach,
    so candidates are texts that agree in a MinHash band; all but 0.006 % of the pairs at 0.8 do, and more above it. Their exact Jaccard
    similarity decides. With `radius` texts whose fingerprints differ in that many bits or fewer, by the same index as in `near_duplicates`,
    are linked too, and components are those of both kinds of links. Equal texts are collapsed before. Texts without words are equal. A null id takes the
    component of an equal text with an id, NULL without one.
    """
    signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
    mixes = multipliers(bands, band_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, wholes, keys = [], [], []
            for t in texts(b.column(1)):
                words = (t or b"").lower().split()
                h = np.array(hashed(words, width), np.uint64)
                fps.append(majority(h) if words else 0)
                wholes.append(_whole(words))
                keys.append(band_hashes(h, mixes, bands).view(np.int64) if words else [])
            yield pa.RecordBatch.from_arrays([b.column(0), signed(fps), signed(wholes), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "fp", "whole", "bands"])

    rows = written(id_text(docs).mapInArrow(run, "doc_id long, fp long, whole long, bands array<long>"))
    equal = cut(rows.groupBy("whole").agg(F.min("doc_id").alias("id"), F.first("fp").alias("fp"), F.first("bands").alias("bands")).where("id is not null"))
    met = colliding(equal.select(F.explode("bands").alias("value"), F.col("whole").alias("hash")))
    going = equal.join(met.select(F.col("hash").alias("whole")).distinct(), "whole").select(F.col("whole").alias("of"), F.col("id").alias("doc_id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {}
            for t, of in zip(texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                if np.uint64(_whole((t or b"").lower().split())).view(np.int64) == of:  # of rows that repeat an id with other texts, only those that have this one
                    found[of] = shingles(t, width).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["hash", "shingles"])

    held = written(id_text(docs).join(going, "doc_id").select("text", "of").mapInArrow(sets, "hash long, shingles array<long>").dropDuplicates(["hash"]))
    found = linked(met, held, similarity)
    if radius is not None:
        # of each fingerprint a text, of each component of fingerprints the texts
        fps = cut(equal.groupBy("fp").agg(F.min("whole").alias("first")))
        near = connected_components(links(fps.select("fp"), radius)).select(F.col("id").alias("fp"), "component")
        heads = fps.join(near, "fp").select("first", "component").join(fps.select(F.col("fp").alias("component"), F.col("first").alias("head")), "component").select(F.col("first").alias("a"), F.col("head").alias("b"))
        copies = equal.join(fps, "fp").where("whole != first").select(F.col("whole").alias("a"), F.col("first").alias("b"))
        found = found.unionByName(heads).unionByName(copies)
    comps = connected_components(found).withColumnRenamed("id", "whole")
    named = equal.join(comps, "whole", "left").select("whole", "id", F.coalesce("component", "whole").alias("component"))
    ids = named.join(named.groupBy("component").agg(F.min("id").alias("component_id")), "component").select("whole", "component_id")
    return rows.join(ids, "whole", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
