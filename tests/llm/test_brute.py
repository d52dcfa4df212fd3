"""Each operator against a brute-force version, a round trip or held-out accuracy on small tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash

from shiftlab.llm import decontaminate, embedding_join, html_text, langid, paragraphs, pii, piece_model, ppm, quality, simhash
from shiftlab.llm.common import forest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def frame():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def smallest(ids, pairs):
    """The smallest id that each id reaches by the pairs."""
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_forest():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 300, (2, 220))
    x, y = forest(a, b)
    want = smallest(range(300), zip(a, b))
    got = dict(zip(x.tolist(), y.tolist()))
    assert all(got.get(i, i) == want[i] for i in range(300))


def test_op5(spark, frame):
    got = simhash.op5_simhash(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)

    def fingerprint(text):
        w = text.encode().lower().split()
        parts = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        ones = [0] * 64
        for p in parts:
            h = xxhash.xxh64_intdigest(p, 42)
            for i in range(64):
                ones[i] += h >> i & 1
        return sum(1 << i for i in range(64) if 2 * ones[i] > len(parts))

    some = frame.index[::7]
    assert [f"{fingerprint(frame.text[i]):016x}" for i in some] == got.fingerprint[some].tolist()
    fp = np.array([int(x, 16) for x in got.fingerprint], dtype=np.uint64)
    near = np.argwhere(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    want = smallest(got.doc_id, ((got.doc_id[a], got.doc_id[b]) for a, b in near if a < b))
    assert [want[i] for i in got.doc_id] == got.component_id.tolist()


def test_op5_every_distance(spark):
    """Fingerprints at each number of bits, in either segment and across, the highest bit included."""
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = base + [b ^ sum(1 << i for i in rng.sample(range(64), k % 6)) for k, b in enumerate(base)] + [b ^ (1 << 63) ^ (1 << 31) ^ (1 << 0) for b in base]
    signed = [f - (1 << 64) if f >> 63 else f for f in dict.fromkeys(fps)]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    close = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    assert smallest(signed, ((r.a, r.b) for r in got)) == smallest(signed, close)


def test_op1(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    x = np.concatenate([c + s * rng.normal(size=(12, 24)) for c, s in zip(centres, rng.uniform(0.02, 0.3, 40))] + [centres, centres]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    for chunk in (8192, 7):
        got = embedding_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), chunk=chunk).toPandas().sort_values("vec_id")
        d = x.astype(float)
        n = np.sqrt((d * d).sum(axis=1))
        s = d @ d.T / np.outer(n, n) >= 0.95
        np.fill_diagonal(s, False)
        want = smallest(range(len(x)), map(tuple, np.argwhere(s)))
        assert got.n_links.tolist() == s.sum(axis=1).tolist()
        assert got.component_id.tolist() == [want[i] for i in range(len(x))]


def test_op7(spark, frame):
    rng = random.Random(2)

    def edits(p, t):
        row = [0] * (len(t) + 1)
        for i in range(1, len(p) + 1):
            new = [i]
            for j in range(1, len(t) + 1):
                new.append(min(row[j - 1] + (p[i - 1] != t[j - 1]), row[j] + 1, new[j - 1] + 1))
            row = new
        return min(row)

    letters = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    hits = 0
    for _ in range(120):
        p = letters(rng.randint(40, 90))
        q = list(p)
        for _ in range(rng.randint(0, len(p) // 8)):
            k = rng.randrange(len(q))
            q[k : k + rng.randint(0, 1)] = letters(rng.randint(0, 1))
        t = letters(rng.randint(0, 60)) + bytes(q) + letters(rng.randint(0, 60))
        index = decontaminate.build([(7, p)])
        d, got = edits(p, t), decontaminate.matches([b"other text", t], index)
        assert bool(got) == (d <= int(index[0].budget[0])) and (not got or got[0][4] == d)
        hits += bool(got)
    assert hits > 60
    got = {(r.doc_id, r.item_id) for r in decontaminate.op7_decontaminate(spark, SF).collect()}
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    plain = lambda t: " ".join(t.lower().split())
    whole = {(d, i) for d, t in zip(frame.doc_id, map(plain, frame.text)) for i, p in zip(items.item_id, map(plain, items.text)) if p in t}
    assert whole and whole <= got and len(got - whole) <= 0.1 * len(whole) + 1


def test_op7_parts_and_long_texts(spark, monkeypatch):
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 9))) for _ in range(n))
    items = [(i, words(30)) for i in range(12)]
    monkeypatch.setattr(decontaminate, "PIECE", 5000)
    index = decontaminate.build([(i, t.encode()) for i, t in items])
    text = decontaminate.normalised((words(3000) + " " + items[4][1] + " " + words(700) + " " + items[9][1]).encode())
    assert [m[1] for m in decontaminate.matches([text], index)] == [4, 9]
    docs = spark.createDataFrame([(1, words(50) + " " + items[3][1]), (2, words(80))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, max_index=400).collect()] == [(1, 3)]


def test_op4():
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    model, rng = piece_model.pieces(piece_model.model_bytes()), random.Random(4)
    parts = ["a", " ", "  ", "▁", "th", "é", "日", "\n", "\t", "er", "x", "ing", "the", "   ", "😀", ".", " of ", " hello ", "0", "12", "\0"]
    for _ in range(1500):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        ids = model.encode(s).tolist()
        assert ids == lib.encode(s)
        assert "▁" in s or model.decode(ids) == s
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    parts = list(model.search(long))
    assert len(parts) > 100 and [i for p in parts for i in p] == lib.encode(" " + long)[1:] or model.encode(long).tolist() == lib.encode(long)


def test_op4_table(spark, frame):
    got = piece_model.op4_sentencepiece(spark, SF).toPandas()
    assert got.round_trip.all() and len(got) == len(frame) and (got.n_ids == got.ids.map(len)).all()


def test_op6():
    assert len({pii.among(i, 1000, b"k", "x") for i in range(1000)}) == 1000
    assert len({pii.spelled(a + b, b"k", "x") for a in "abcdefgh" for b in "ijklmnop"}) == 64
    text = 'Write to Jo.Doe@Mail.example.org or jo.doe@mail.example.org, call +1 (017) 555-7713 or +1 017 555 7713, card 4845168114407329 not 9807915762804490, from 10.1.2.3, token = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72". Mr. John Smith and Mrs. Anna Smith, 123-45-6789. Version 4.0.'
    new, found = pii.replaced(text)
    kinds = Counter(k for k, *_ in found)
    assert kinds == {"email": 2, "phone": 2, "card": 1, "ip": 1, "secret": 1, "name": 2, "ssn": 1}
    assert all(text[a:b] not in new for _, a, b, _ in found) and "9807915762804490" in new and "Version 4.0." in new
    by = defaultdict(list)
    for k, a, b, s in found:
        by[k].append(s)
    assert by["email"][0].lower() == by["email"][1] and pii.luhn(by["card"][0]) % 10 == 0 and by["ip"][0].startswith("10.")
    digits = lambda s: "".join(filter(str.isdigit, s))
    assert digits(by["phone"][0]) == digits(by["phone"][1]) and by["name"][0].split()[1] == by["name"][1].split()[1]
    assert by["name"][0].split()[0] in pii.GIVEN["latin", "m"] and by["name"][1].split()[0] in pii.GIVEN["latin", "f"]
    assert pii.replaced(text)[0] == new and pii.replaced("nothing here")[0] == "nothing here"


def test_op6_table(spark, frame):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert pii.collisions(docs).count() == 0
    got = pii.op6_pii(spark, SF).toPandas().set_index("doc_id")
    for d, t in zip(frame.doc_id, frame.text):
        if "@" not in t and not any(c.isdigit() for c in t):
            assert got.text[d] == t


def test_op8(spark, frame):
    found = paragraphs.op8_paragraphs(spark, SF).toPandas()
    held = defaultdict(set)
    for d, t in zip(frame.doc_id, frame.text):
        w = t.lower().split()
        for i in range(len(w) - 49):
            held[" ".join(w[i : i + 50])].add(d)
    shared = {d for s in held.values() if len(s) > 1 for d in s}
    assert shared and shared <= set(found.doc_id)
    alone = {d for d, t in zip(frame.doc_id, frame.text) if len(t.split()) < paragraphs.MIN_WORDS}
    assert not alone & set(found.doc_id)


def test_op8_lines(spark):
    """Lines with a Jaccard similarity of 0.8 are clustered, others aren't; later ones are removed."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    lines = [[word() for _ in range(60)] for _ in range(12)]
    docs, truth = [], []
    for i, line in enumerate(lines):
        for k in range(3):
            own = list(line)
            if k:
                for _ in range(k * (i % 4)):
                    own[rng.randrange(len(own))] = word()
            docs.append((len(docs), f"{word()} {word()}\n{' '.join(own)}"))
            truth.append(own)
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in truth]
    near = [(a, b) for a in range(len(docs)) for b in range(a) if len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) >= 0.8]
    want = smallest(range(len(docs)), near)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for chunk in (2048, 2):
        rows = [r for r in paragraphs.repeats(table, chunk=chunk).collect() if r.end - r.start == 60]
        groups = defaultdict(set)
        for r in rows:
            groups[r.cluster].add(r.doc_id)
        for members in groups.values():
            assert len({want[d] for d in members}) == 1
        assert {d for g in groups.values() for d in g} == {d for d in want if sum(v == want[d] for v in want.values()) > 1}
    removed = paragraphs.removals(paragraphs.repeats(table))
    kept = {r.doc_id: r.text for r in paragraphs.deduplicated(table, removed).collect()}
    assert kept[0] == docs[0][1] and len(kept[1].split()) < len(docs[1][1].split())


def test_op2_repeats():
    streams = [[f"w{i}" for i in range(30)], ["x", *[f"w{i}" for i in range(5, 25)], "y"], ["z"] * 40, []]
    got = [set(np.flatnonzero(c)) for c in html_text.repeated(streams, 16)]
    assert got == [set(range(5, 25)), set(range(1, 21)), set(), set()]
    menu = "".join(f"<li>{w}</li>" for w in "home news sport about us contact terms of use privacy and more of the same".split())
    page = lambda text: f"<body><ul>{menu}</ul><div><p>{text}</p></div></body>"
    assert html_text.main_texts([page("first words"), page("second thing"), page("third")]) == ["first words", "second thing", "third"]


def test_op2_table(spark):
    import html as entities
    import re

    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id")
    got = html_text.op2_html(spark, SF).toPandas()
    for p, t, n in zip(got.page_id, got.text, got.n_chars):
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", pages.html[p], re.S)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br|div)[^>]*>", " ", inner))
        assert t == " ".join(entities.unescape(plain).split()) and n == len(t)


def test_op3(spark, frame):
    got = ppm.scored(spark.read.parquet(f"{SF}/documents.parquet"), batch=1 << 20).toPandas().sort_values("doc_id").reset_index(drop=True)
    held = [zlib.crc32(str(d).encode()) % 10 == 0 for d in frame.doc_id]
    tokens = [t.encode().lower().split() + [b"\n"] for t in frame.text]
    c = Counter(w for x, h in zip(tokens, held) if not h for w in x)
    n, v = sum(c.values()), len(c)
    assert got.held_out.tolist() == held and set(got.train_tokens) == {n}
    assert got.n_tokens.tolist() == [len(x) for x in tokens] and got.n_known.tolist() == [sum(w in c for w in x) for x in tokens]
    base = [sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x) for x in tokens]
    assert np.allclose(base, got.base_score, rtol=1e-9)
    trie: dict[bytes, Counter] = defaultdict(Counter)
    coded = lambda w: w if w == b"\n" else w + b" "
    for w, k in c.items():
        s, full = coded(w), b" " + coded(w)
        for i in range(len(s)):
            for j in range(max(0, i + 1 - ppm.ORDER), i + 2):
                trie[full[j : i + 1]][s[i]] += k
    known: dict[bytes, float] = {}

    def length(w):
        if w not in known:
            s, full, total = coded(w), b" " + coded(w), 0.0
            for i in range(len(s)):
                gone: set[int] = set()
                for j in range(max(0, i + 1 - ppm.ORDER), i + 2):
                    left = {y: m for y, m in trie[full[j : i + 1]].items() if y not in gone}
                    whole = sum(left.values()) + len(left)
                    if s[i] in left:
                        total += np.log10(left[s[i]] / whole)
                        break
                    if left:
                        total += np.log10(len(left) / whole)
                    gone |= set(trie[full[j : i + 1]])
                else:
                    total -= np.log10(256 - len(gone))
            known[w] = total
        return known[w]

    def score(x):
        before, out = Counter(), 0.0
        for i, w in enumerate(x):
            g = (c[w] + v * 10 ** length(w)) / (n + v)
            out += np.log10((before[w] + ppm.OWN_ESCAPE * len(before) * g) / (i + ppm.OWN_ESCAPE * len(before)) if i else g)
            before[w] += 1
        return out

    some = range(0, len(tokens), 5)
    assert np.allclose([score(tokens[i]) for i in some], got.score[list(some)], rtol=1e-6)
    assert got.score[~got.held_out].sum() > got.base_score[~got.held_out].sum()


def test_op9(spark):
    got = quality.op9_quality(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert set(held.doc_id) == {d for d in got.doc_id if zlib.crc32(str(d).encode()) % 3 == 1}
    assert (held.predicted == held.quality).mean() > 0.95


def test_op10(spark, frame):
    got = langid.op10_langid(spark, SF).toPandas().merge(frame, on="doc_id")
    held = got[got.held_out]
    assert set(held.doc_id) == {d for d in got.doc_id if zlib.crc32(str(d).encode()) % 5 == 0}
    assert (held.lang_pred == held.lang).mean() > 0.97
