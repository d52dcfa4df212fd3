"""SentencePiece encoding and decoding by a streaming Viterbi search over pieces.

The search goes over a text once and holds, of each place that a later piece can begin at (a window of the longest piece), the
last piece of the surviving path to it. Whenever the backpointers from all of these meet at one boundary, the ids before it
are committed. No more is kept than lies after that boundary.

With a unigram model the surviving path to a place is the one of the best score, of equal ones the one with the longest last piece.

A model whose pieces are made by merges doesn't choose by the sum of scores. Its segmentation of a text is the one path of
pieces in which every two neighbours are stable: merging the characters of both, best score
first and leftmost first, gives the two pieces again. Of the pieces that end at a place, exactly
one is stable after the last piece of the path to where it begins, and that path survives. An
automaton over the text tells the longest piece that ends at each place and how far back a piece
that ends later can begin.

Where no piece of the model can cross a place (before a white space that follows another
character) all paths meet, so words are searched one by one and repeated words looked up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

SPACE = "▁"
#: Words that a worker remembers, and the longest of them; pairs of pieces, and steps of the automaton.
MEMORY, LONGEST, PAIRS, STEPS = 300_000, 64, 2_000_000, 2_000_000
#: What an unknown character's score is below the least, as the library has it.
UNKNOWN = 10.0


def model_bytes(path: str | None = None) -> bytes:
    """The model file at `path`, on the driver; by default the 32k-piece model of the module `public_tokenizers`, which is needed for that alone."""
    if path is None:
        from public_tokenizers import path as place

        path = place("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


class Model:
    """The pieces of a model that doesn't normalise. Characters that no piece has are spelled in bytes, or are the unknown piece (one for several in a row) where the model has no bytes."""

    def __init__(self, proto):
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that don't normalise are supported")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.score = {x.piece: x.score for x in proto.pieces if x.type == x.NORMAL}
        self.byte_ids, self.unknown = [0] * 256, next((i for i, x in enumerate(proto.pieces) if x.type == x.UNKNOWN), 0)
        self.bytes = any(x.type == x.BYTE for x in proto.pieces)
        self.raw: list[bytes] = []
        self.ids = ids = {}
        for i, x in enumerate(proto.pieces):
            if x.type == x.BYTE:
                self.byte_ids[int(x.piece[3:5], 16)] = i
                self.raw.append(bytes([int(x.piece[3:5], 16)]))
            elif x.type == x.NORMAL:
                ids[x.piece] = i
                self.raw.append(x.piece.replace(SPACE, " ").encode())
            else:
                self.raw.append(b"")
        self.text = [x.piece for x in proto.pieces]
        self.crosses = any(SPACE in x.lstrip(SPACE) for x in ids)
        self.longest = max(map(len, ids), default=1)
        self.words: dict[str, bytes] = {}

    def search(self, s: str) -> Iterator[list[int]]:
        raise NotImplementedError

    def _unknown(self, c: str) -> list[int]:
        return [self.byte_ids[x] for x in c.encode()] if self.bytes else [self.unknown]

    def _word(self, w: str) -> bytes:
        """The ids of one word with the space before it, as 32-bit integers."""
        found = np.array([i for part in self.search(w) for i in part], dtype="<i4").tobytes()
        if len(w) <= LONGEST:
            if len(self.words) >= MEMORY:
                self.words.clear()
            self.words[w] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text; none for an empty one."""
        if not text:
            return np.zeros(0, "<i4")
        s = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        words = [s] if self.crosses else re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", s)
        get, word = self.words.get, self._word
        ids = np.frombuffer(b"".join([x if (x := get(w)) is not None else word(w) for w in words]), dtype="<i4")
        return ids if self.bytes else ids[np.append(True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown))[: len(ids)]]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; control pieces and the unknown piece have none. Bytes that aren't UTF-8 become U+FFFD."""
        raw = self.raw
        b = b"".join([raw[i] for i in ids])
        return (b[1:] if self.prefix and b[:1] == b" " else b).decode("utf-8", "replace")


class Unigram(Model):
    """The pieces of a unigram model."""

    def __init__(self, proto):
        super().__init__(proto)
        self.low = min(self.score.values(), default=0.0) - UNKNOWN

    def search(self, s: str) -> Iterator[list[int]]:
        """The ids of `s`, in parts as they are committed."""
        score, longest, low = self.score.get, self.longest, self.low
        base, best, size = 0, [0.0], [0]  # the last boundary; of each place from there on the score of its path and the length of its last piece
        for end in range(1, len(s) + 1):
            top, own = -np.inf, 1
            for n in range(min(longest, end - base), 0, -1):
                x = score(s[end - n : end])
                if x is None:
                    if n > 1:
                        continue
                    x = low
                if best[end - n - base] + x > top:
                    top, own = best[end - n - base] + x, n
            best.append(top)
            size.append(own)
            if end % longest == 0:
                alive = {*range(max(base, end + 1 - longest), end + 1)}
                while len(alive) > 1:
                    k = max(alive)
                    alive.remove(k)
                    alive.add(k - size[k - base])
                met = alive.pop()
                if met > base:
                    yield self._path(s, base, met, size)
                    best, size, base = best[met - base :], size[met - base :], met
        yield self._path(s, base, len(s), size)

    def _path(self, s: str, base: int, end: int, size: list[int]) -> list[int]:
        out = []
        while end > base:
            begin = end - size[end - base]
            i = self.ids.get(s[begin:end])
            out += self._unknown(s[begin])[::-1] if i is None else [i]
            end = begin
        return out[::-1]


class Pieces(Model):
    """The pieces of a model of the merging kind."""

    def __init__(self, proto):
        super().__init__(proto)
        ids = self.ids
        made = {x: i for x, i in ids.items() if len(x) == 1 or self.merged(x) == [x]}  # merging never makes the others
        # states of the automaton: the beginnings of pieces
        self.states = {x: i for i, x in enumerate({"": 0} | {x[:n]: 0 for x in ids for n in range(1, len(x) + 1)})}
        self.depth = [len(x) for x in self.states]
        self.named = list(self.states)
        longest = lambda x: next((made[x[i:]] for i in range(len(x)) if x[i:] in made), -1)
        self.ends = [longest(x) for x in self.named]  # the longest piece that ends in a state
        self.shorter = [longest(x[1:]) if x in made else -1 for x in self.text]  # the next longest that ends a piece
        self.size = [len(x) for x in self.text]
        self.next: list[dict[str, int]] = [{} for _ in self.named]
        self.stable: list[dict[int, bool]] = [{} for _ in self.text]
        self.pairs = self.steps = 0

    def merged(self, s: str) -> list[str]:
        """The pieces of a short string by merging pair after pair."""
        parts = list(s)
        while len(parts) > 1:
            best, at = max(((self.score.get(parts[i] + parts[i + 1], -np.inf), -i) for i in range(len(parts) - 1)))
            if best == -np.inf:
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def _stable(self, a: int, b: int) -> bool:
        self.pairs += 1
        if self.pairs > PAIRS:
            self.pairs = 1
            for x in self.stable:
                x.clear()
        x, y = self.text[a], self.text[b]
        self.stable[a][b] = ok = self.merged(x + y) == [x, y]
        return ok

    def _next(self, state: int, c: str) -> int:
        """The longest end of the state's string and `c` that begins a piece."""
        x = self.named[state] + c
        while x not in self.states:
            x = x[1:]
        self.steps += 1
        if self.steps > STEPS:
            self.steps = 1
            for known in self.next:
                known.clear()
        self.next[state][c] = found = self.states[x]
        return found

    def search(self, s: str) -> Iterator[list[int]]:
        """The ids of `s`, in parts as they are committed."""
        ends, shorter, size, onward, stable = self.ends, self.shorter, self.size, self.next, self.stable
        last = [-1]  # of each place after the last commit, the last piece of the path to it
        state = 0
        for c in s:
            to = onward[state].get(c)
            state = to if to is not None else self._next(state, c)
            t = ends[state]
            if t < 0:  # a character that no piece has; every path ends before it
                yield self._path(last, len(last) - 1) + self._unknown(c)
                last = [-1]
                continue
            at = len(last)
            while True:
                before = last[at - size[t]]
                if before < 0:
                    break
                ok = stable[before].get(t)
                if ok if ok is not None else self._stable(before, t):
                    break
                t = shorter[t]
            last.append(t)
            if at % self.longest == 0:
                alive = {*range(at - min(at, self.depth[state]), at + 1)}
                while len(alive) > 1:
                    k = max(alive)
                    alive.remove(k)
                    alive.add(k - size[last[k]] if k else 0)
                if met := alive.pop():
                    yield self._path(last, met)
                    last = last[met:]
        yield self._path(last, len(last) - 1)

    def _path(self, last: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= self.size[last[end]]
        return out[::-1]


@lru_cache(2)
def pieces(serialised: bytes) -> Model:
    """The pieces of a serialised model."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(serialised)
    kinds = {proto.trainer_spec.UNIGRAM: Unigram, proto.trainer_spec.BPE: Pieces}
    if proto.trainer_spec.model_type not in kinds:
        raise ValueError("only unigram and merging models are supported")
    return kinds[proto.trainer_spec.model_type](proto)


def encoded(docs: DataFrame, model: bytes | None = None, text: str = "text", verify: bool = True) -> DataFrame:
    """`docs` with `piece_ids` and, with `verify`, `round_trip`: whether decoding gives the text again (it doesn't for a text with U+2581, which is decoded to a space).

    Columns of these names are replaced, others stay. A null text has null in both; an empty one no ids and true.
    """
    docs = docs.drop("piece_ids", "round_trip").withColumn(text, F.col(f"`{text}`").cast("string"))
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model or model_bytes())
    added = {"piece_ids": "array<int>", **({"round_trip": "boolean"} if verify else {})}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(shared.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                given = b.column(at).to_pylist()
                ids = [None if t is None else model.encode(t) for t in given]
                more = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(0 if x is None else len(x) for x in ids)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, "<i4"), *(x for x in ids if x is not None)])), mask=pa.array([x is None for x in ids]))]
                if verify:
                    more.append(pa.array([None if t is None else model.decode(x.tolist()) == t for t, x in zip(given, ids, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *added])

    return docs.mapInArrow(run, docs.select("*", *[F.expr(f"cast(null as {kind})").alias(name) for name, kind in added.items()]).schema)


def decoded(encodings: DataFrame, model: bytes | None = None, ids: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """`encodings` with the text of `ids` in the column `into`; null ids give null, and null among ids nothing."""
    encodings = encodings.drop(into)
    at = encodings.columns.index(ids)
    shared = encodings.sparkSession.sparkContext.broadcast(model or model_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(shared.value)
        for b in batches:
            found = [None if x is None else model.decode([i for i in x if i is not None]) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*b.schema.names, into])

    return encodings.mapInArrow(run, encodings.select("*", F.lit(None).cast("string").alias(into)).schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids, round_trip) of every document."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return encoded(docs).select("doc_id", F.coalesce(F.size("piece_ids"), F.lit(0)).alias("n_ids"), F.col("piece_ids").alias("ids"), "round_trip")
