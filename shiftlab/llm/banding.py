"""MinHash bands of sets of shingles, and exact verification of the pairs that meet in a bucket.

Two sets meet if all minima of one band agree. The links that are found are those of all pairs
that meet, though not all pairs of a bucket are compared: first every set of a bucket is
compared with the one that meets most others, its centre, which is enough for a group of copies of one text. Then only
sets that the first step left in different components of a bucket are compared; sets that are linked to the centre don't meet each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, written
from .components import connected_components

#: Sets of a bucket that meet in one task, and shingles that are hashed together.
CHUNK, TOGETHER = 1024, 512


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def multipliers(bands: int, rows: int) -> np.ndarray:
    """Odd numbers, one for each minimum."""
    return np.random.default_rng(42).integers(0, 1 << 63, bands * rows, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def band_hashes(shingles: np.ndarray, mixes: np.ndarray, bands: int) -> np.ndarray:
    """A hash of the minima of each band of a set of hashed shingles, repeated ones being allowed."""
    return _hashed(_least(mixed(shingles), mixes)[None], bands)[0]


def _least(s: np.ndarray, mixes: np.ndarray) -> np.ndarray:
    least = np.full(len(mixes), ~np.uint64(0))
    for i in range(0, len(s), TOGETHER):
        np.minimum(least, (s[i : i + TOGETHER, None] * mixes).min(axis=0), out=least)
    return least


def _hashed(least: np.ndarray, bands: int) -> np.ndarray:
    """Of rows of minima, the hashes of their bands."""
    rows = mixed(least.reshape(len(least), bands, -1))
    places = np.arange(1, rows.shape[2] + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mixed((rows * (places | np.uint64(1))).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


def spans_bands(shingles: np.ndarray, spans: np.ndarray, mixes: np.ndarray, bands: int) -> np.ndarray:
    """The band hashes of the parts (start, end) of a row of shingles; parts are in order, none empty, and don't touch. Those within `TOGETHER` shingles are looked at together."""
    s, least, i = mixed(shingles), np.empty((len(spans), len(mixes)), np.uint64), 0
    while i < len(spans):
        a = spans[i, 0]
        j = max(i + 1, int(np.searchsorted(spans[:, 1], a + TOGETHER, "right")))
        if j == i + 1:
            least[i] = _least(s[a : spans[i, 1]], mixes)
        else:
            least[i:j] = np.minimum.reduceat(s[a : spans[j - 1, 1], None] * mixes, spans[i:j].ravel()[:-1] - a, axis=0)[::2]
        i = j
    return _hashed(least, bands)


def window_bands(shingles: np.ndarray, at: np.ndarray, width: int, mixes: np.ndarray) -> np.ndarray:
    """The one band of all `mixes` of the `width` shingles from each of the places `at`."""
    s = mixed(shingles)
    least = np.stack([np.lib.stride_tricks.sliding_window_view(s * m, width)[at].min(axis=1) for m in mixes], axis=1)
    return _hashed(least, 1)[:, 0]


def colliding(buckets: DataFrame) -> DataFrame:
    """(value, hash, size): the rows (value, hash) of buckets of more than one set. The rows must be distinct."""
    sizes = buckets.groupBy("value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return written(buckets.join(sizes, "value"))


def _verified(table: pa.Table, similarity: float) -> pa.Table:
    """Edges (a, b) that connect the sets of a group whose exact Jaccard similarity is high enough and whose labels differ."""
    table = table.sort_by("hash")
    ids = table.column("hash").to_numpy()
    own = [np.asarray(x.values) for x in table.column("shingles")]
    loose, label = table.column("loose").to_numpy(zero_copy_only=False), np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
    sizes = np.array([len(x) for x in own])
    owner, (distinct, inv) = np.repeat(np.arange(len(own)), sizes), np.unique(np.concatenate(own), return_inverse=True)
    order = np.argsort(inv, kind="stable")
    posting, at = owner[order], np.searchsorted(inv[order], np.arange(len(distinct) + 1))
    place, a, b = np.append(0, np.cumsum(sizes)), [], []
    for i in np.flatnonzero(loose):
        if (label == label[i]).all():
            continue
        held = inv[place[i] : place[i + 1]]
        lengths = at[held + 1] - at[held]
        where = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(at[held], lengths)
        shared = np.bincount(posting[where], minlength=len(own))
        for j in np.flatnonzero((shared >= similarity * (sizes + sizes[i] - shared) - 1e-9) & (label != label[i])):
            if label[j] != label[i]:
                a.append(ids[i])
                b.append(ids[j])
                label[label == label[j]] = label[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def linked(met: DataFrame, sets: DataFrame, similarity: float, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of sets that meet in a bucket of `met` and have that Jaccard similarity; `sets`: (hash, shingles), the distinct shingles as longs. Sets that are missing link with nothing."""
    weights = met.groupBy("hash").agg(F.sum("size").alias("weight"))
    centres = cut(met.join(weights, "hash").groupBy("value").agg(F.max(F.struct("weight", "hash")).alias("top")).select("value", F.col("top.hash").alias("centre")))
    stars = met.join(centres, "value").where("hash != centre").select("hash", "centre").distinct()
    other = sets.select(F.col("hash").alias("centre"), F.col("shingles").alias("others"))
    shared = F.size(F.array_intersect("shingles", "others"))
    near = stars.join(sets, "hash").join(other, "centre").where(shared >= similarity * (F.size("shingles") + F.size("others") - shared) - 1e-9)
    comps = connected_components(near.select(F.col("hash").alias("a"), F.col("centre").alias("b")))

    # what the centres left: sets of a bucket in several components
    labels = comps.select(F.col("id").alias("hash"), "component")
    named = met.select("value", "hash").join(labels, "hash", "left").select("value", "hash", F.coalesce("component", "hash").alias("label"))
    of_centre = centres.join(labels.withColumnRenamed("hash", "centre"), "centre", "left").select("value", "centre", F.coalesce("component", "centre").alias("main"))
    members = written(named.join(of_centre, "value").where("hash != centre").select("value", "hash", "label", (F.col("label") != F.col("main")).alias("loose")))
    several = members.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("loose"), True)).alias("n_loose"), F.expr("bit_xor(xxhash64(hash))").alias("x"), F.expr("bit_xor(xxhash64(hash, 1))").alias("y")).where("low != high")
    # buckets of the same sets are one
    once = several.groupBy("n", "x", "y").agg(F.min(F.struct("value", "n_loose")).alias("v")).select("v.value", F.ceil(F.col("v.n_loose") / chunk).cast("int").alias("loose_chunks"), F.ceil((F.col("n") - F.col("v.n_loose")) / chunk).cast("int").alias("main_chunks"))
    dealt = members.join(once, "value").withColumn("chunk", F.pmod(F.xxhash64("hash"), F.when(F.col("loose"), F.col("loose_chunks")).otherwise(F.col("main_chunks"))).cast("int"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col(n) - 1)), lambda o: o < F.col(n))
    loose_pairs = F.concat(F.transform(upto("loose_chunks"), lambda o: F.struct(F.least(o, F.col("chunk")).alias("i"), F.greatest(o, F.col("chunk")).alias("j"))), F.transform(upto("main_chunks"), lambda o: F.struct(F.col("chunk").alias("i"), (-1 - o).alias("j"))))
    main_pairs = F.transform(upto("loose_chunks"), lambda o: F.struct(o.alias("i"), (-1 - F.col("chunk")).alias("j")))
    pairs = dealt.withColumn("pair", F.explode(F.when(F.col("loose"), loose_pairs).otherwise(main_pairs))).select("value", "pair.i", "pair.j", "hash", "label", "loose").join(sets, "hash")
    rest = pairs.groupBy("value", "i", "j").applyInArrow(lambda t: _verified(t, similarity), "a long, b long")
    return comps.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(rest)
