"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine >= c have a squared distance of at most t = 2 - 2c. A rotation (signs
and Walsh-Hadamard transforms, so that it is the same to the last bit in every task) spreads
each vector over blocks of eight dimensions; in one of the blocks the squared distance of such
a pair is within the block's share of t. Each block is range-joined under that budget on a
grid over its first three dimensions: a vector is at home in its own cell and a guest in each
later cell that its range touches. The union of the candidates is verified by the exact cosine
in double precision; of the blocks that find a pair, the first one counts it.

Equal vectors are collapsed before. Tasks return for each vector how many it was linked to and
one edge towards the smallest of its component there, never pairs, so that a group of near
copies costs a row for each member.

Vectors are dealt in one of two ways, whichever moves fewer bytes by the counts taken before. By
cells: a task gets the vectors at home or guests in one cell of one block. Whole: a task gets two
chunks of all vectors and joins them in every block, which is less where cells hardly
prune. Chunks, and those of cells with many vectors, meet two by two. Vectors are moved in passes
of about their own size, whose shuffles are deleted before the next, so that disk doesn't grow faster than the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, forest, written
from .components import connected_components

COSINE, BLOCK, GRID, ROWS = 0.95, 8, 3, 256
#: Vectors of a chunk: at most, and at least where there are few vectors.
CHUNK, SMALL = 32768, 8192
#: Cells of many vectors whose numbers of chunks are broadcast, of a few dozen bytes each.
MAX_HOT = 100_000
#: Bytes of a pass at least, and beside its components those of a row.
PASS, ROW = 64 << 20, 48
#: Added to budgets, in double and in single precision: far above rounding and far below what would let in many more candidates.
SLACK, ROUGH = 1e-9, 1e-5
_WIDTH = 1 << 10  # cells in each dimension of the grid, more than a unit vector can reach


def rotated(x: np.ndarray) -> np.ndarray:
    """Unit vectors of the rows of `x`, padded to a power of two of at least `BLOCK` dimensions and rotated. A row's result doesn't depend on other rows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    size = max(BLOCK, 1 << (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng(42)
    for _ in range(2):
        y *= rng.choice([-1.0, 1.0], size)
        step = 1
        while step < size:
            z = y.reshape(len(y), -1, 2, step)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(y), size)
            step *= 2
        y /= np.sqrt(size)
        y = y[:, rng.permutation(size)]
    return y


def _scaled(x: np.ndarray) -> np.ndarray:
    """Doubles whose squares neither overflow nor vanish: each row times a power of two, which changes no cosine."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _budget(size: int, cosine: float) -> float:
    return (2 - 2 * cosine) * BLOCK / size + SLACK


def _cells(y: np.ndarray, block: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) for one block."""
    reach = np.sqrt(_budget(y.shape[1], cosine))
    width = 2 * reach
    p = y[:, block * BLOCK : block * BLOCK + GRID]
    code = lambda c: ((c[:, 0] * _WIDTH + c[:, 1]) * _WIDTH + c[:, 2]) + (block << 32)
    half = _WIDTH // 2
    at, low, high = (np.clip(np.floor(q / width).astype(np.int64) + half, 0, _WIDTH - 1) for q in (p, p - reach, p + reach))
    home = code(at)
    rows, cells, homes = [np.arange(len(y))], [home], [np.ones(len(y), bool)]
    for shift in np.ndindex(3, 3, 3):
        c = low + np.array(shift)
        guest = np.flatnonzero((c <= high).all(axis=1) & (code(c) > home))
        rows.append(guest)
        cells.append(code(c[guest]))
        homes.append(np.zeros(len(guest), bool))
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(homes)


def _arrays(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The components of a column of lists one after another, and where each list ends."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False), np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)


def _spread(batches: Iterator[pa.RecordBatch], cosine: float, kind: str, part: tuple[int, int] | None, hot: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(size, cell, home, id, n, e) for the cells in which each vector is at home or a guest, of one pass (`part`: its number, their number) and of cells in `hot` (None: all); without `part`, (size, cell, rows) alone."""
    for whole in batches:
        for i in range(0, whole.num_rows, ROWS):
            b = whole.slice(i, ROWS)
            flat, ends = _arrays(b.column(2), kind)
            sizes = np.diff(ends)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                y = rotated(flat[(ends[own][:, None] + np.arange(size))])
                for block in range(y.shape[1] // BLOCK):
                    row, cell, home = _cells(y, block, cosine)
                    if part is None:
                        cells, rows = np.unique(cell, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), size, np.int32)), pa.array(cells), pa.array(rows)], names=["size", "cell", "rows"])
                        continue
                    mine = (cell * 0x9E3779B1 >> 12) % part[1] == part[0]
                    if hot is not None:
                        mine |= np.isin(cell, hot)
                        row, cell, home = row[mine], cell[mine], home[mine]
                    at = pa.array(own[row])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), size, np.int32)), pa.array(cell), pa.array(home), b.column(0).take(at), b.column(1).take(at), b.column(2).take(at)], names=["size", "cell", "home", "id", "n", "e"])


def _met(a: np.ndarray, b: np.ndarray | None, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of `a` and `b` (None: of `a`, each once), parts of vectors in one block, whose squared distance is about `budget` or less; no pair within it is left out."""
    reach = np.sqrt(budget) + SLACK

    several = len(a) > 2 * ROWS

    def placed(x: np.ndarray) -> tuple[np.ndarray, ...]:
        # partners aren't farther off than the reach in any dimension: strips along one, in order of another within a strip
        strip = np.floor(x[:, GRID + 1] / reach).astype(np.int64) if several else np.zeros(len(x), np.int64)
        order = np.lexsort((x[:, GRID], strip))
        f = x[order].astype(np.float32)
        return order, strip[order], x[order, GRID], f, (f * f).sum(axis=1, keepdims=True)

    order, strip, along, f, squares = placed(a)
    other = (order, strip, along, f, squares) if b is None else placed(b)
    one = lambda x: np.ones((len(x), 1), np.float32)
    left, right = np.hstack([f * np.float32(-2), squares, one(f)]), np.ascontiguousarray(np.hstack([other[3], one(other[3]), other[4]]).T)
    for s in np.unique(strip):
        first, last = np.searchsorted(strip, [s, s + 1])
        spans = [np.searchsorted(other[1], [t, t + 1]) for t in ([s, s + 1] if b is None else [s - 1, s, s + 1])]
        for k in range(first, last, ROWS):
            end = min(k + ROWS, last)
            for m, (low, high) in enumerate(spans):
                same = b is None and m == 0
                start, stop = low + np.searchsorted(other[2][low:high], along[k] - reach), low + np.searchsorted(other[2][low:high], along[end - 1] + reach, "right")
                start = max(start, k) if same else start
                if start >= stop:
                    continue
                p, q = np.divmod(np.flatnonzero(left[k:end] @ right[:, start:stop] <= np.float32(budget + ROUGH)), stop - start)
                p, q = p + k, q + start
                if same:
                    p, q = p[q > p], q[q > p]
                yield order[p], other[0][q]


def _linked(table: pa.Table, cosine: float, kind: str) -> pa.Table:
    """(id, links, root) of the vectors of one cell (-1: all of them, in every block), or of two chunks, that are linked there."""
    empty = pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    first, second, cell = table.column("i")[0].as_py(), table.column("j")[0].as_py(), table.column("cell")[0].as_py()
    table = table.combine_chunks()
    ids, n, home, chunk = (table.column(c).to_numpy() for c in ("id", "n", "home", "chunk"))
    if len(ids) < 2 or not home.any():
        return empty
    x = np.concatenate([_arrays(c, kind)[0] for c in table.column("e").chunks]).reshape(len(ids), -1)
    y, x = np.concatenate([rotated(x[i : i + (1 << 12)]) for i in range(0, len(x), 1 << 12)]), _scaled(x)
    norms, budget, blocks = np.sqrt((x * x).sum(axis=1)), _budget(y.shape[1], cosine), y.shape[1] // BLOCK
    one, two = (np.arange(len(ids)), None) if first == second else (np.flatnonzero(chunk == first), np.flatnonzero(chunk == second))
    links, ends = np.zeros(len(ids), np.int64), []

    def verified(p: np.ndarray, q: np.ndarray, block: int) -> None:
        near = ((y[p] - y[q]) ** 2).reshape(len(p), blocks, BLOCK).sum(axis=2) <= budget
        mine = near[:, block] & ~near[:, :block].any(axis=1)
        p, q = p[mine], q[mine]
        close = np.einsum("ij,ij->i", x[p], x[q]) / (norms[p] * norms[q]) >= cosine
        p, q = p[close], q[close]
        np.add.at(links, p, n[q])
        np.add.at(links, q, n[p])
        if len(p):
            ends.append(forest(ids[p], ids[q]))

    for block in range(blocks) if cell < 0 else [cell >> 32]:
        part, waiting, held = y[:, block * BLOCK : (block + 1) * BLOCK], [], 0
        for a, b in _met(part[one], None if two is None else part[two], budget):
            a, b = one[a], (one if two is None else two)[b]
            apart = home[a] | home[b]
            waiting.append((a[apart], b[apart]))
            held += len(waiting[-1][0])
            if held >= 1 << 14:
                for k in range(0, held, 1 << 15):
                    p, q = (np.concatenate(z)[k : k + (1 << 15)] for z in zip(*waiting, strict=True))
                    verified(p, q, block)
                waiting, held = [], 0
            if len(ends) > 64:
                ends[:] = [forest(*(np.concatenate(e) for e in zip(*ends, strict=True)))]
        if held:
            verified(*(np.concatenate(z) for z in zip(*waiting, strict=True)), block)
    root = ids.copy()
    if ends:
        node, up = forest(*(np.concatenate(e) for e in zip(*ends, strict=True)))
        at = np.argsort(ids)
        root[at[np.searchsorted(ids[at], node)]] = up
    found = links > 0
    return pa.table({"id": ids[found], "links": links[found], "root": root[found]})


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffles of queries that are made and run inside are deleted when these end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _passes(vectors: DataFrame, cosine: float, kind: str, chunk: int, whole: bool | None, least: int) -> DataFrame:
    """(id, links, root) of `vectors` (id, n, e), found pass by pass. `whole`: deal them whole or by cells, None: whichever moves fewer bytes; `least`: bytes of a pass at least."""
    width = 4 if kind == "<f4" else 8
    counts = cut(vectors.groupBy(F.size("e").alias("size")).agg(F.count(F.lit(1)).alias("rows")))
    chunk = min(chunk, max(SMALL, -(-(counts.agg(F.max("rows")).first()[0] or 0) // 16)))
    in_chunks = lambda df: df.withColumn("chunks", F.ceil(F.col("rows") / chunk).cast("int"))
    counts, cells = in_chunks(counts), cut(in_chunks(vectors.mapInArrow(lambda b: _spread(b, cosine, kind, None, None), "size int, cell long, rows long").groupBy("size", "cell").agg(F.sum("rows").alias("rows"))))
    moved = lambda df, times: df.agg(F.sum(F.col("rows").cast("double") * times * (F.col("size") * width + ROW))).first()[0] or 0.0
    own, all_whole, by_cells = moved(counts, 1), moved(counts, F.col("chunks")), moved(cells, F.col("chunks"))
    if whole is None:
        whole = all_whole <= by_cells
    passes = max(1, int(-(-(all_whole if whole else by_cells) // max(least, own))))
    columns = ["size", "cell", "pair.i", "pair.j", "chunk", "home", "id", "n", "e"]
    if whole:
        placed = vectors.withColumn("size", F.size("e")).join(F.broadcast(counts), "size").select("size", F.lit(-1).cast("long").alias("cell"), F.lit(True).alias("home"), "id", "n", "e", "chunks")
    else:
        hot = cut(cells.where("chunks > 1").select("size", "cell", "chunks"))
        few = hot.count() <= MAX_HOT  # beyond, they meet by a shuffle
        codes = np.array(sorted({r.cell for r in hot.select("cell").collect()}), np.int64) if few else None
        hot = F.broadcast(hot) if few else hot
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(o, F.col("chunk")).alias("i"), F.greatest(o, F.col("chunk")).alias("j")))
    out = None
    for k in range(passes):
        split = placed if whole else vectors.mapInArrow(lambda b, k=k: _spread(b, cosine, kind, (k, passes), codes), "size int, cell long, home boolean, id long, n long, e " + vectors.schema["e"].dataType.simpleString()).join(hot, ["size", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        dealt = split.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        mine = lambda pair: F.pmod(F.xxhash64("size", "cell", pair["i"], pair["j"]), F.lit(passes)) == k  # noqa: B023, E731
        if whole or not few:
            wanted = F.filter(pairs, mine)
        else:  # of cells that aren't cut, those of this pass alone were spread
            wanted = F.when(F.col("chunks") > 1, F.filter(pairs, mine)).otherwise(pairs)
        dealt = dealt.withColumn("pair", F.explode(wanted)).select(*columns)
        found = written(dealt.groupBy("size", "cell", "i", "j").applyInArrow(lambda t: _linked(t, cosine, kind), "id long, links long, root long"))
        out = found if out is None else out.unionByName(found)
    return out


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, chunk: int = CHUNK, whole: bool | None = None, least: int = PASS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors` (vec_id, embedding).

    A vector that is null, empty, zero or holds a null or non-finite component, or whose id is
    null, links with nothing and is its own component; so do vectors of different lengths with
    each other. Rows that repeat an id are vectors of their own that share it. An empty table gives no rows.
    `chunk`, `whole` and `least` change how vectors are dealt, never the result.
    """
    kind = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("e"))
    fit = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("e", lambda v: v != 0)
    ok = F.coalesce(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & fit, F.lit(False))
    valid, rest = rows.where(ok), rows.where(~ok)
    key = [F.xxhash64("e").alias("key"), F.xxhash64(F.lit(1), "e").alias("check")]  # 128 bits name a vector where it needn't be moved itself
    with _shuffles_deleted(vectors.sparkSession):
        # a number for each distinct vector, fixed by being written, as ids may repeat
        distinct = written(valid.groupBy("e").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()))
        found = _passes(distinct.select("id", "n", "e"), cosine, kind, chunk, whole, least)
        comps = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = distinct.select("id", "n", "least", *key).join(links, "id", "left").join(comps, "id", "left").select("key", "check", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("key", "check", "n_links", "component_id")
    linked = valid.select("vec_id", *key).join(named, ["key", "check"]).select("vec_id", "n_links", "component_id")
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
