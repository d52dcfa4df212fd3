"""Language-model scores by prediction by partial matching over bytes.

A text is its lower-cased (A-Z) words, each coded byte by byte and ended by a space, and then one
end symbol. The context of a byte is what stands before it, words before included, up to `ACROSS` bytes, with a space in
front of the text. The trie of contexts holds the counts of all training documents. A byte
that its longest known context has seen gets its share of that context's counts; else an escape is
coded (by the number of distinct symbols seen there) and the next shorter context asked, without the symbols that the longer one has seen;
in the end come all bytes alike. The score of a text is the sum over its bytes and its end.

A variant, which op3 doesn't use, ends contexts of `ORDER` bytes at the word's start and sets two contexts of whole tokens above the trie,
blended by their escape estimates (symbols seen over symbols and counts): the counts of training tokens, whose escape is to spell the word, and the
document's own tokens before, which make the model adaptive, whose escape is to the former. All
tokens' probabilities sum to one at each place.

Neither the words nor the trie are gathered in one place. Documents are put into batches of about
`BATCH` bytes. A batch asks the shards of the words' hashes for the counts of its distinct words, and the shards of the
trie (all contexts that share their last two bytes) for the log-probabilities of its distinct
contexts with symbol, sending its own counts along; each shard adds up what it gets and answers each batch.
Only the counts of pairs of bytes, 65,536 at most, pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, remainder, texts, written

ORDER, BATCH, SHARDS, FOLDS = 4, 8 << 20, 512, 10
#: Bytes of a context that runs on across words.
ACROSS = 5
#: How many times a distinct token counts in the escape of a document's own tokens, which are few.
OWN_ESCAPE = 8
TOGETHER = 1 << 17
_SPACE, _END = 0x20, 0x0A
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _coded(word: bytes) -> bytes:
    """The bytes that spell a word: without zero bytes, which mark the places before a word, and different for each word."""
    return word.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1")


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): pairs of bytes in training texts; -1 for all bytes, -2 for training tokens, -3 for training documents."""
    counts, total, tokens, docs = np.zeros(1 << 16, np.int64), 0, 0, 0
    for b in batches:
        for text, train in zip(texts(b.column(0)), b.column(1).to_pylist(), strict=True):
            total += len(text or b"")
            if train:
                w = _words(text)
                s = np.frombuffer(b" " + _coded(b" ".join(w)) + b" " * bool(w), np.uint8).astype(np.int32)
                counts += np.bincount(s[:-1] << 8 | s[1:], minlength=1 << 16)
                tokens += len(w) + 1
                docs += 1
    counts[_SPACE << 8 | _END] += docs
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2, -3]).astype(np.int32)), pa.array(np.append(counts[at], [total, tokens, docs]))], names=["pair", "n"])


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys * _MIX) >> np.uint64(33)).astype(np.int64) % shards


class Batch:
    """The distinct words of some texts, and the distinct contexts with symbol: in the words, or with `across` in the whole texts."""

    def __init__(self, docs: list[bytes | None], train: np.ndarray, order: int = ORDER, across: bool = False):
        words = [_words(t) for t in docs]
        flat = [w for d in words for w in (*d, b"\n")]
        coded = pa.array(flat, pa.large_binary()).dictionary_encode()
        index = coded.dictionary.to_pylist()
        self.sizes = np.array([len(d) + 1 for d in words], np.int64)
        self.tokens = coded.indices.to_numpy().astype(np.int64)
        self.counts = np.bincount(self.tokens, np.repeat(train, self.sizes), minlength=len(index)).astype(np.int64)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))
        # the longest context of each byte of each word or text, and the byte: the last byte of the context beside the symbol
        if across:
            own, times = [_coded(b" ".join(d)) + b" " * bool(d) + b"\n" for d in words], train.astype(np.uint8)
        else:
            own, times = [w if w == b"\n" else _coded(w) + b" " for w in index], self.counts
        size = np.array([len(x) for x in own], np.int64)
        self.first = np.append(0, np.cumsum(size))[:-1]
        front = b"\0" * (order - 1) + b" "  # zero bytes mark the places before
        keys = np.frombuffer(front + front.join(own), np.uint8).astype(np.uint64)
        mine = np.ones(len(keys), bool)
        mine[((self.first + np.arange(len(own)) * order)[:, None] + np.arange(order)).ravel()] = False
        del own, words, flat
        held = 1  # bytes that are in a key
        while held <= order:
            more = min(held, order + 1 - held)
            low = keys[:-held] & np.uint64((1 << 8 * more) - 1)
            low <<= np.uint64(8 * held)
            keys[held:] |= low
            held += more
        del low
        keys = keys[mine]
        coded = pa.array(keys).dictionary_encode()
        del keys
        distinct = coded.dictionary.to_numpy()
        sort = np.argsort(distinct)
        rank = np.empty(len(sort), np.int32)
        rank[sort] = np.arange(len(sort), dtype=np.int32)
        distinct, self.at = distinct[sort], rank[coded.indices.to_numpy()]
        del coded
        weights, times = np.zeros(len(distinct), np.int64), np.repeat(times, size)
        for i in range(0, len(times), 1 << 20):
            weights += np.bincount(self.at[i : i + (1 << 20)], times[i : i + (1 << 20)], minlength=len(distinct)).astype(np.int64)
        self.asked = [(hashes, self.counts), (distinct, weights)]

    def orders(self, shards: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For words and for contexts: how to sort them by shard and key, and where each shard ends."""
        out = []
        for kind, (keys, _) in enumerate(self.asked):
            shard = _shard(keys if kind == 0 else keys >> np.uint64(8) & np.uint64(0xFFFF), shards)
            order = np.lexsort((keys, shard))
            out.append((order, np.searchsorted(shard[order], np.arange(shards + 1))))
        return out

    def requests(self, shards: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(kind, shard, keys, counts)."""
        press = zstandard.ZstdCompressor(level=1)
        for kind, ((keys, counts), (order, ends)) in enumerate(zip(self.asked, self.orders(shards), strict=True)):
            keys, counts = keys[order], counts[order]
            for s in np.flatnonzero(np.diff(ends)):
                part = slice(ends[s], ends[s + 1])
                # bytes of one rank together, and differences of sorted keys, can be compressed
                yield kind, int(s), press.compress(np.diff(keys[part], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()), press.compress(counts[part].view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes())


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of the wanted keys, 0 for those that aren't among the sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def log_probabilities(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, longest: int = ORDER) -> np.ndarray:
    """log10 of the probability of each symbol in its context. The keys are sorted and distinct and hold all contexts that share their last two bytes with any of them; `pairs`: counts of (byte, next byte)."""
    symbol = (keys & np.uint64(255)).astype(np.int64)
    last = (keys >> np.uint64(8) & np.uint64(255)).astype(np.int64)
    depth = sum(((keys >> np.uint64(8 * k) & np.uint64(255)) > 0).astype(np.int64) for k in range(1, longest + 1))
    singles = pairs.sum(axis=0)
    # by order: sorted keys with counts, sorted contexts with totals and numbers of symbols
    tables: dict[int, tuple[np.ndarray, ...]] = {}
    for k in range(2, longest + 1):
        mask = np.uint64((1 << 8 * (k + 1)) - 1)
        seen = (counts > 0) & (depth >= k)
        own, inv = np.unique(keys[seen] & mask, return_inverse=True)
        n = np.bincount(inv, counts[seen], minlength=len(own)).astype(np.int64)
        context, first = np.unique(own >> np.uint64(8), return_index=True)
        tables[k] = own, n, context, np.add.reduceat(n, first) if len(n) else n, np.diff(np.append(first, len(own))), first
    of = lambda k, wanted: pairs[(wanted >> np.uint64(8) & np.uint64(255)).astype(np.int64), (wanted & np.uint64(255)).astype(np.int64)] if k == 1 else _found(tables[k][0], tables[k][1], wanted & np.uint64((1 << 8 * (k + 1)) - 1))
    taken = {}  # by order: of each context, the counts that its symbols have in the next shorter one
    for k in range(2, longest + 1):
        own, _, context, _, _, first = tables[k]
        taken[k] = np.add.reduceat(of(k - 1, own), first) if len(own) else np.zeros(0, np.int64)
    out, done = np.zeros(len(keys)), np.zeros(len(keys), bool)
    less, fewer = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)  # counts and symbols that the longer context takes away
    for k in range(longest, -1, -1):
        if k >= 2:
            _, _, context, totals, kinds, _ = tables[k]
            mine = keys >> np.uint64(8) & np.uint64((1 << 8 * k) - 1)
            total, kind, n, gone = _found(context, totals, mine), _found(context, kinds, mine), of(k, keys), _found(context, taken[k], mine)
        elif k == 1:
            total, kind, n = pairs.sum(axis=1)[last], (pairs > 0).sum(axis=1)[last], pairs[last, symbol]
            gone = ((pairs > 0) * singles).sum(axis=1)[last]
        else:
            total, kind, n, gone = np.full(len(keys), singles.sum()), np.full(len(keys), (singles > 0).sum()), singles[symbol], 0
        here = ~done & (depth >= k) & (total > 0)
        rest = total - less + kind - fewer  # all that can follow here, the escape being as many as there are new symbols
        hit = here & (n > 0)
        out[hit] += np.log10(n[hit] / rest[hit])
        done |= hit
        miss = here & ~hit & (kind > fewer)
        out[miss] += np.log10((kind - fewer)[miss] / rest[miss])
        less, fewer = np.where(here, gone, less), np.where(here, kind, fewer)
    return np.where(done, out, out - np.log10(np.maximum(1, 256 - fewer)))


def _answers(table: pa.Table, pairs: np.ndarray, order: int = ORDER) -> pa.Table:
    """Of one shard, the answer to each batch: counts of words, or log-probabilities; a batch of -1 holds the number of distinct training words."""
    kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
    asked = [_cumulated(x) for x in table.column("keys").to_pylist()]
    counts = [_unpacked(x, np.int64) for x in table.column("counts").to_pylist()]
    keys, inv = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(inv, np.concatenate(counts), minlength=len(keys)).astype(np.int64)
    values = total if kind == 0 else log_probabilities(keys, total, pairs, order).astype(np.float32)
    ends = np.cumsum([len(x) for x in asked])
    batches, blobs = table.column("batch").to_pylist(), [_packed(values[part]) for part in np.split(inv, ends[:-1])]
    if kind == 0:
        batches.append(-1)
        blobs.append(int((total > 0).sum()).to_bytes(8, "little"))
    n = len(batches)
    return pa.table({"kind": pa.array([kind] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()), "batch": pa.array(batches, pa.int32()), "answer": pa.array(blobs, pa.binary())})


def _cumulated(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(blob, np.uint64), dtype=np.uint64)


def _ask(table: pa.Table, shards: int, order: int = ORDER, across: bool = False) -> pa.Table:
    b = Batch(texts(table.column("text").combine_chunks()), table.column("train").to_numpy().astype(np.int64), order, across)
    number = table.column("batch")[0].as_py()
    rows = list(b.requests(shards))
    return pa.table({"kind": pa.array([r[0] for r in rows], pa.int32()), "shard": pa.array([r[1] for r in rows], pa.int32()), "batch": pa.array([number] * len(rows), pa.int32()), "keys": pa.array([r[2] for r in rows], pa.binary()), "counts": pa.array([r[3] for r in rows], pa.binary())})


def adaptive(tokens: np.ndarray, sizes: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Of each document the sum of log10 of its tokens' probabilities, the tokens before being blended with `logs`, the log10 probability of each distinct token. Whole documents of about `TOGETHER` tokens are looked at together."""
    ends, out, begin = np.cumsum(sizes), [], 0
    while begin < len(sizes):
        at = int(ends[begin - 1]) if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, at + TOGETHER, "right")))
        own = sizes[begin:stop]
        out.append(np.add.reduceat(_blended(tokens[at : int(ends[stop - 1])], own, logs), np.append(0, np.cumsum(own))[:-1]))
        begin = stop
    return np.concatenate(out)


def _blended(tokens: np.ndarray, sizes: np.ndarray, logs: np.ndarray) -> np.ndarray:
    first = np.append(0, np.cumsum(sizes))[:-1]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((tokens, doc))  # stable, so that equal tokens of a document stay in order
    new = np.append(True, (tokens[order][1:] != tokens[order][:-1]) | (doc[order][1:] != doc[order][:-1]))[: len(order)]
    starts = np.flatnonzero(new)
    seen = np.empty(len(tokens), np.int64)
    seen[order] = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    place = np.arange(len(tokens)) - np.repeat(first, sizes)
    kinds = np.cumsum(seen == 0) - (seen == 0)
    kinds = kinds - np.repeat(kinds[first], sizes)  # distinct tokens before
    own = np.log10(np.maximum(seen, 1e-300))
    with np.errstate(divide="ignore"):
        other = np.log10(OWN_ESCAPE * kinds) + logs[tokens]
    high, low = np.maximum(own, other), np.minimum(own, other)
    blended = high + np.log1p(10.0 ** (low - high)) / np.log(10) - np.log10(np.maximum(1, place + OWN_ESCAPE * kinds))
    return np.where(place == 0, logs[tokens], blended)


def _scored(docs: pa.Table, answers: pa.Table, shards: int, total: int, distinct: int, order: int = ORDER, across: bool = False) -> pa.Table:
    """(doc_id, held_out, n_tokens, n_known, base, score): base without the size of the training texts."""
    b = Batch(texts(docs.column("text").combine_chunks()), docs.column("train").to_numpy().astype(np.int64), order, across)
    given = {(k, s): a for k, s, a in zip(*(answers.column(c).to_pylist() for c in ("kind", "shard", "answer")), strict=True)}
    values = []
    for kind, (place, ends) in enumerate(b.orders(shards)):
        x = np.zeros(len(place))
        for s in np.flatnonzero(np.diff(ends)):
            x[place[ends[s] : ends[s + 1]]] = _unpacked(given[kind, int(s)], np.int64 if kind == 0 else np.float32)
        values.append(x)
    known = values[0]
    lengths = np.add.reduceat(values[1][b.at], b.first)
    first = np.append(0, np.cumsum(b.sizes))[:-1]
    summed = lambda x: np.add.reduceat(x, first)
    if across:
        score = lengths
    else:
        spelled = lengths + np.log10(max(1, distinct))
        whole = np.log10(np.maximum(known, 1e-300))
        high, low = np.maximum(whole, spelled), np.minimum(whole, spelled)
        score = adaptive(b.tokens, b.sizes, high + np.log1p(10.0 ** (low - high)) / np.log(10) - np.log10(total + distinct) if distinct else lengths)
    return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(b.sizes), "n_known": pa.array(summed((known > 0).astype(np.int64)[b.tokens])), "base": pa.array(summed(np.log10(known + 0.1)[b.tokens])), "score": pa.array(score)})


def scored(docs: DataFrame, batch: int = BATCH, shards: int = SHARDS, across: bool = False) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs`.

    A null text is an empty one: one token, its end. A row with a null id is learned from and
    not held out. Rows that repeat an id are texts of their own. With nothing to learn from,
    base_score is 0 and all bytes are alike. An empty table gives no rows.

    With `across` the score is that of prediction by partial matching over the bytes of the whole text
    and nothing else; without, contexts end at the word's start and tokens are blended above them.
    """
    order = ACROSS if across else ORDER
    held = F.coalesce(remainder("doc_id", FOLDS) == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held)
    counted = {r.pair: r.n for r in rows.select("text", (~F.col("held_out")).alias("train")).mapInArrow(_pair_counts, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    pairs = np.zeros(1 << 16, np.int64)
    for pair, n in counted.items():
        if pair >= 0:
            pairs[pair] = n
    pairs = pairs.reshape(256, 256)
    batches = max(1, -(-counted.get(-1, 0) // batch))
    shards = max(1, min(shards, batches))
    where = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int")
    dealt = rows.select(where.alias("batch"), "doc_id", "held_out", (~F.col("held_out")).alias("train"), "text")
    asked = dealt.groupBy("batch").applyInArrow(lambda t: _ask(t, shards, order, across), "kind int, shard int, batch int, keys binary, counts binary")
    answers = written(asked.groupBy("kind", "shard").applyInArrow(lambda t: _answers(t, pairs, order), "kind int, shard int, batch int, answer binary"))
    distinct = sum(int.from_bytes(r.answer, "little") for r in answers.where("batch = -1").select("answer").collect())
    tokens = counted.get(-2, 0)
    done = dealt.groupBy("batch").cogroup(answers.where("batch >= 0").groupBy("batch")).applyInArrow(lambda d, a: _scored(d, a, shards, tokens, distinct, order, across), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    size = float(np.log10(tokens + 0.1 * (distinct + 1)))
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(size)).alias("base_score"), "score")


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), across=True)
