"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are lower-cased (A-Z) and runs of white space become one space. An item of m bytes
occurs in a document if some part of it is within k = floor(error * m) edits of the item. Such a part shares at
least m + 1 - q * (k + 1) of the item's q-grams, and all of them on diagonals (place in the
document minus place in the item) that differ by k at most, so that one of the overlapping
bands of 2k+1 diagonals, taken at every k+1, holds them all. Bands that hold as many are retained and an
alignment confined to the band decides. The lemma holds for any q: items that are too short for `Q` (less than q * (k + 1) bytes) get the largest q
that leaves a q-gram to ask for, down to their own length, and an index of their own.

The index of the benchmark is broadcast in parts of at most `MAX_INDEX` bytes of text; each
part beyond the first is another pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_text, texts

Q, ERROR, MAX_INDEX = 8, 0.1, 4 << 20
#: Bytes of documents that are looked at together, and pairs of equal q-grams counted together.
PIECE, MAX_HITS = 4 << 20, 1 << 21
_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: bytes | None) -> bytes:
    return b" ".join((text or b"").lower().split())


def _grams(line: bytes, q: int) -> np.ndarray:
    """The q-gram at each byte of `line` as an integer, 8 bytes being read and the highest cut off."""
    n = len(line) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.ndarray((n,), "<u8", line + b"\0" * 8, 0, (1,)) & np.uint64((1 << 8 * q) - 1)


@dataclass
class Index:
    ids: list[int]
    items: list[bytes]
    budget: np.ndarray
    needed: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    marked: np.ndarray
    q: int


def build(rows: list[tuple[int, bytes]], q: int = Q, error: float = ERROR) -> list[Index]:
    """The indexes of the items, one for each q that some of them need, all with the budget that their length gives. An item without a word is left out."""
    by_q: dict[int, list[tuple[int, bytes]]] = {}
    for i, text in rows:
        if line := normalised(text):
            budget = int(error * len(line))
            fits = min(q, len(line) // (budget + 1))
            if not fits:
                raise ValueError("an error of one edit for each byte leaves no q-gram")
            by_q.setdefault(fits, []).append((i, line))
    return [_index(sorted(kept), own, error) for own, kept in sorted(by_q.items())]


def _index(kept: list[tuple[int, bytes]], q: int, error: float) -> Index:
    ids, items = [i for i, _ in kept], [x for _, x in kept]
    size = np.array([len(x) for x in items], dtype=np.int64)
    budget = (error * size).astype(np.int64)
    needed = size + 1 - q * (budget + 1)
    g = [_grams(x, q) for x in items]
    grams = np.concatenate(g) if g else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(g)), [len(x) for x in g]) if g else np.zeros(0, int)
    place = np.concatenate([np.arange(len(x)) for x in g]) if g else np.zeros(0, int)
    order = np.argsort(grams, kind="stable")
    grams, item, place = grams[order], item[order], place[order]
    distinct, first = np.unique(grams, return_index=True)
    marked = np.zeros(1 << _BITS, bool)
    marked[(distinct * _MIX) >> np.uint64(64 - _BITS)] = True
    return Index(ids, items, budget, needed, distinct, np.append(first, len(grams)), item.astype(np.int64), place.astype(np.int64), marked, q)


def align(item: bytes, text: bytes, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """The best (start, end, edits) of a part of `text` within `budget` edits of `item`, on diagonals from `low` to `high`; of equal ones the first to end.

    Only cells in the band are filled; the part may start anywhere in it.
    """
    p, width, never = np.frombuffer(item, np.uint8), high - low + 1, len(item) + len(text) + 1
    t = np.full(len(item) + width + 1, -1, np.int16)  # the byte before diagonal low + c in row i stands at i + c
    at = np.arange(low - 1, low - 1 + len(t))
    inside = (at >= 0) & (at < len(text))
    t[inside] = np.frombuffer(text, np.uint8)[at[inside]]
    steps = np.arange(width)
    ends = low + steps
    row = np.where((ends >= 0) & (ends <= len(text)), 0, never)
    start = ends.copy()
    for i in range(1, len(item) + 1):
        ends = low + i + steps
        ok = (ends >= 0) & (ends <= len(text))
        best, origin = row + (t[i : i + width] != p[i - 1]), start
        up = np.append(row[1:], never) + 1
        better = up < best
        best, origin = np.where(better, up, best), np.where(better, np.append(start[1:], 0), origin)
        best = np.where(ok, best, never)
        slid = np.minimum.accumulate(best - steps)  # bytes of the text that the item doesn't have
        source = np.maximum.accumulate(np.where(best - steps == slid, steps, 0))
        row, start = np.where(ok, slid + steps, never), origin[source]
    c = int(row.argmin())
    return (int(start[c]), int(low + len(item) + c), int(row[c])) if row[c] <= budget else None


def _retained(lines: list[bytes], index: Index) -> list[tuple[int, int, int]]:
    """(line, item, band) of the bands that hold enough q-grams; `lines` hold at most 2^16 texts of `PIECE` bytes together, or one text."""
    if not len(index.grams):
        return []
    reach = 2 * max(map(len, index.items))  # more than any part within an item's budget
    if len(lines) == 1 and len(lines[0]) > PIECE + reach:  # windows that overlap by as much
        line, out = lines[0], set()
        for begin in range(0, len(line) - reach, PIECE):
            out.update(_banded([line[begin : begin + PIECE + reach]], index, begin))
        return sorted(out)
    return _banded(lines, index, 0)


def _banded(lines: list[bytes], index: Index, begin: int) -> list[tuple[int, int, int]]:
    """As `_retained`, for a text without its first `begin` bytes."""
    starts = np.cumsum([0] + [len(x) + index.q for x in lines])
    g = _grams((b"\0" * index.q).join(lines), index.q)
    at = np.flatnonzero(index.marked[(g * _MIX) >> np.uint64(64 - _BITS)])
    found = np.searchsorted(index.grams, g[at])
    found[found == len(index.grams)] = 0
    same = index.grams[found] == g[at]
    at, found = at[same], found[same]
    line = np.searchsorted(starts, at, "right") - 1
    diagonal = at - starts[line] + begin
    count = index.first[found + 1] - index.first[found]
    total, n_items = np.cumsum(count), len(index.items)
    most = max(map(len, index.items))
    bands = begin + int(starts[-1]) + 2 * most + 4
    keys, held, cut = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while cut < len(at):
        stop = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + MAX_HITS, "right")))
        n = count[cut:stop]
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index.first[found[cut:stop]], n)
        item = index.item[entry]
        band = (np.repeat(diagonal[cut:stop], n) - index.place[entry]) // (index.budget[item] + 1)
        key = (np.repeat(line[cut:stop], n) * n_items + item) * bands + band + most + 1
        for k in (key, key - 1):  # band b holds the diagonals from b * (k + 1) to (b + 2) * (k + 1) - 1
            distinct, times = np.unique(k, return_counts=True)
            keys.append(distinct)
            held.append(times)
        cut = stop
    distinct, inv = np.unique(np.concatenate(keys), return_inverse=True)
    pair, band = distinct // bands, distinct % bands - most - 1
    enough = np.bincount(inv, np.concatenate(held)) >= index.needed[pair % n_items] if len(distinct) else np.zeros(0, bool)
    return [(int(p) // n_items, int(p) % n_items, int(b)) for p, b in zip(pair[enough], band[enough], strict=True)]


def matches(lines: list[bytes], indexes: list[Index]) -> list[tuple[int, int, int, int, int]]:
    """(line, item id, start, end, edits): of each item the best place in each normalised text that holds it, the first of equal ones."""
    return sorted(x for index in indexes for x in _matches(lines, index))


def _matches(lines: list[bytes], index: Index) -> list[tuple[int, int, int, int, int]]:
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    whole: dict[tuple[int, int], int] = {}
    for i, item, band in _retained(lines, index):
        text, p, k = lines[i], index.items[item], int(index.budget[item])
        if (i, item) not in whole:
            whole[i, item] = text.find(p)
        if (at := whole[i, item]) >= 0:  # no edits: no alignment can be better
            best[i, item] = (0, at, at + len(p))
            continue
        low = band * (k + 1) - k  # a path may leave the band of its q-grams by its edits
        region = text[max(0, low) : max(0, low + 4 * k + 1 + len(p))]
        if np.isin(_grams(p, index.q), _grams(region, index.q)).sum() < index.needed[item]:  # the same count, but of the item's places rather than of pairs
            continue
        if found := align(p, text, low, low + 4 * k + 1, k):
            start, end, edits = found
            best[i, item] = min(best.get((i, item), (edits, start, end)), (edits, start, end))
    return [(i, index.ids[item], start, end, edits) for (i, item), (edits, start, end) in best.items()]


def _parts(benchmark: DataFrame, max_index: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in parts of about `max_index` bytes; one row of sizes and one part at a time reach the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // max_index)
    for part in range(n):
        yield [(r[0], bytes(r[1])) for r in (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == part)).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, error: float = ERROR, max_index: int = MAX_INDEX) -> DataFrame:
    """(doc_id, item_id, start, end, edits) for each pair of a document and an item that it holds; start and end count bytes of the normalised text.

    Null and empty texts and rows without an id hold nothing; null items and items
    without a word aren't found. A doc_id or item_id that repeats gives a row for each text
    that matches. An empty table on either side gives no rows.
    """
    spark, rows = docs.sparkSession, id_text(docs).where("doc_id is not null and text is not null")
    schema = "doc_id long, item_id long, start long, end long, edits int"
    out = None
    for part in _parts(benchmark, max_index):
        index = spark.sparkContext.broadcast(build(part, q, error))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, held, size, found = b.column(0).to_pylist(), [], 0, []
                for j, text in enumerate([*texts(b.column(1)), None]):
                    if held and (text is None or size + len(text) > PIECE or len(held) == 1 << 16):
                        found += [(ids[held[i][0]], *rest) for i, *rest in matches([x for _, x in held], index.value)]
                        held, size = [], 0
                    if text is not None:
                        held.append((j, line := normalised(text)))
                        size += len(line)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found), [pa.int64()] * 4 + [pa.int32()])], names=["doc_id", "item_id", "start", "end", "edits"])

        one = rows.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], schema) if out is None else out


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
