"""Minimum spanning trees of mutual reachability distances, for points that no single task holds.

Points are dealt into blocks of about `BLOCK` along a space-filling curve. An edge of the tree of all points
is in the tree of any part of the points that holds both its ends, so the trees of all pairs of
blocks together hold it, and the tree of their edges is the one of all points. Edges are in one order
(by distance, then by their ends), so the tree is the same however points are dealt. Pairs of blocks that lie farther apart than the longest edge
of a first tree over neighbouring blocks can't hold an edge and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut

BLOCK, EDGES, CURVE = 1000, 1 << 20, 8
_EDGE = "a long, b long, w double"


def spanning_tree(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a, b, weight), a < b, of the tree of the points, a row of distances at a time; of equal weights those with the smaller ends come first."""
    n = len(x)
    best, source, open_, index = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool), np.arange(n)
    a, b, w, at = [], [], [], 0
    for _ in range(n - 1):
        open_[at] = False
        reach = np.maximum(np.maximum(core[at], core), np.sqrt(((x - x[at]) ** 2).sum(axis=1)))
        ends = lambda other, own=index: np.minimum(other, own) * n + np.maximum(other, own)
        nearer = open_ & ((reach < best) | (reach == best) & (ends(at) < ends(source)))
        best[nearer], source[nearer] = reach[nearer], at
        left = np.flatnonzero(open_)
        ties = left[best[left] == best[left].min()]
        at = int(ties[np.argmin(ends(source[ties], ties))])
        a.append(min(source[at], at))
        b.append(max(source[at], at))
        w.append(best[at])
    return np.array(a, int), np.array(b, int), np.array(w, float)


def forest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The places of the edges that are in the minimum spanning forest."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, up, kept = ends[: len(a)].tolist(), ends[len(a) :].tolist(), list(range(len(ids))), []
    for e in np.lexsort((b, a, w)).tolist():
        i, j = x[e], y[e]
        while up[i] != i:
            up[i] = i = up[up[i]]
        while up[j] != j:
            up[j] = j = up[up[j]]
        if i != j:
            up[i] = j
            kept.append(e)
    return np.array(kept, int)


def core_distances(x: np.ndarray, others: Iterator[np.ndarray], k: int) -> np.ndarray:
    """Of each point the distance to its k-th nearest among itself and the others; infinite if there are fewer."""
    least = np.full((len(x), k), np.inf)
    for y in others:
        d = np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))
        least = np.partition(np.hstack([least, d]), k - 1, axis=1)[:, :k]
    return least.max(axis=1)


def _unpacked(row: dict, dims: int, side: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    core = row.get(f"{side}core")
    return np.frombuffer(row[f"{side}ids"], np.int64), np.frombuffer(row[f"{side}x"], float).reshape(-1, dims), None if core is None else np.frombuffer(core, float)


def _blocks(points: DataFrame, axes: list[str], block: int) -> DataFrame:
    """(blk, ids, x, low, high): the points of each block, packed, and the corners of their box."""
    one = points.agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{name}_{a}") for a in axes for name, f in (("low", F.min), ("high", F.max))]).first()
    number = max(1, -(-one["n"] // block))
    cells = [F.when(F.lit(one[f"high_{a}"] > one[f"low_{a}"]), F.least(F.floor((F.col(a) - one[f"low_{a}"]) / (max(one[f"high_{a}"] - one[f"low_{a}"], 5e-324)) * (1 << CURVE)), F.lit((1 << CURVE) - 1))).otherwise(F.lit(0)).cast("long") for a in axes]
    place = F.lit(0).cast("long")
    for bit in range(CURVE):
        for i, c in enumerate(cells):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(c, bit).bitwiseAND(1), bit * len(axes) + i))
    # points of one place are dealt by a hash; 52 bits are exact as doubles
    placed = cut(points.select("id", F.array(*[F.col(a).cast("double") for a in axes]).alias("v"), (place * (1 << 20) + F.pmod(F.xxhash64("id"), F.lit(1 << 20))).cast("double").alias("at")))
    ends = placed.approxQuantile("at", [i / number for i in range(1, number)], 0.1 / number) if number > 1 else []
    bounds = np.unique(ends)  # points of the data, so that no block but the first is empty
    dims = len(axes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, b.column(2).to_numpy(), "right").astype(np.int32)), b.column(0), b.column(1)], names=["blk", "id", "v"])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = np.array(table.column("v").to_pylist(), float).reshape(-1, dims)
        return pa.table({"blk": table.column("blk").slice(0, 1), "ids": pa.array([table.column("id").to_numpy().tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary()), "low": pa.array([x.min(axis=0)], pa.list_(pa.float64())), "high": pa.array([x.max(axis=0)], pa.list_(pa.float64()))})

    return cut(placed.mapInArrow(deal, "blk int, id long, v array<double>").groupBy("blk").applyInArrow(pack, "blk int, ids binary, x binary, low array<double>, high array<double>"))


def _meeting(left: DataFrame, right: DataFrame, corners: DataFrame, number: int, every: bool, reach: F.Column) -> DataFrame:
    """The pairs of blocks, all others with `every` or those that come later, whose boxes are at most `reach` apart; `corners`: (blk, low, high)."""
    begin = F.lit(0) if every else F.col("blk")
    box = corners.withColumnsRenamed({"blk": "other", "low": "o_low", "high": "o_high"})
    gap = F.zip_with(F.zip_with("low", "o_high", lambda p, q: p - q), F.zip_with("o_low", "high", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    apart = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g))
    pairs = left.select(*[c for c in left.columns if c not in ("ids", "x", "core")], F.explode(F.sequence(begin, F.lit(number - 1))).alias("other")).join(box, "other")
    kept = pairs.where(apart <= reach * (1 + 1e-9)).select("blk", "other")
    return kept.join(left.select("blk", "ids", "x", *[c for c in ("core",) if c in left.columns]), "blk").join(right, "other")


def mutual_tree(points: DataFrame, axes: list[str], k: int, block: int = BLOCK) -> DataFrame:
    """(a, b, w): the minimum spanning tree of the points (id, axes) by mutual reachability distances with the k-th nearest neighbour, a point being its own first."""
    dims, blocks = len(axes), _blocks(points, axes, block)
    number = (blocks.agg(F.max("blk")).first()[0] or 0) + 1
    corners = blocks.select("blk", "low", "high")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            far = [float(core_distances(x, iter([x]), k).max()) for _, x, _ in (_unpacked(r, dims) for r in rows)]
            yield pa.RecordBatch.from_arrays([pa.array([r["blk"] for r in rows], pa.int32()), pa.array(far)], names=["blk", "far"])

    reached = blocks.join(blocks.mapInArrow(own, "blk int, far double"), "blk")
    other = blocks.select(F.col("blk").alias("other"), F.col("ids").alias("o_ids"), F.col("x").alias("o_x"))

    def cores(table: pa.Table) -> pa.Table:
        rows = table.sort_by("other").to_pylist()
        ids, x, _ = _unpacked(rows[0], dims)
        core = core_distances(x, (_unpacked(r, dims, "o_")[1] for r in rows), k)
        return pa.table({"blk": table.column("blk").slice(0, 1), "core": pa.array([core.tobytes()], pa.binary()), "least": pa.array([float(core.min())])})

    # the k-th distance within a block bounds how far its points' neighbours are
    met = _meeting(reached, other, corners, number, True, F.col("far")).groupBy("blk").applyInArrow(cores, "blk int, core binary, least double")
    full = cut(blocks.join(met, "blk"))
    other = full.select(F.col("blk").alias("other"), F.col("ids").alias("o_ids"), F.col("x").alias("o_x"), F.col("core").alias("o_core"))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, x, core = _unpacked(r, dims)
                if r["blk"] != r["other"]:
                    more = _unpacked(r, dims, "o_")
                    ids, x, core = (np.concatenate(z) for z in zip((ids, x, core), more, strict=True))
                order = np.argsort(ids)
                ids = ids[order]
                i, j, w = spanning_tree(x[order], core[order])
                yield pa.RecordBatch.from_arrays([pa.array(ids[i], pa.int64()), pa.array(ids[j], pa.int64()), pa.array(w, pa.float64())], names=["a", "b", "w"])

    chain = full.select("blk", "ids", "x", "core", F.explode(F.array_distinct(F.array("blk", F.least(F.col("blk") + 1, F.lit(number - 1))))).alias("other")).join(other, "other")
    first = reduced(chain.mapInArrow(trees, _EDGE))
    longest = first.agg(F.max("w")).first()[0]
    if number <= 2 or longest is None:
        return first
    rest = _meeting(full, other, corners, number, False, F.lit(longest)).where("other > blk + 1")
    return reduced(first.unionByName(rest.mapInArrow(trees, _EDGE)))


def reduced(edges: DataFrame) -> DataFrame:
    """The edges of the minimum spanning forest: parts of about `EDGES` edges are reduced to their forests until one part is left. The last one holds no more than an edge for each point and part."""

    def kept(table: pa.Table) -> pa.Table:
        return table.select(["a", "b", "w"]).take(pa.array(forest(*(table.column(c).to_numpy() for c in "abw"))))

    edges, before = cut(edges.distinct()), None
    while True:
        n = edges.count()
        parts = -(-n // EDGES) if before is None or n < 0.9 * before else 1
        edges = cut(edges.withColumn("part", F.pmod(F.xxhash64("a", "b"), F.lit(max(1, parts))).cast("int")).groupBy("part").applyInArrow(kept, _EDGE))
        if parts <= 1:
            return edges
        before = n
