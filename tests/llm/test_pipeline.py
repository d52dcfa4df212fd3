"""The pipeline against stages written plainly in pandas, each over what its predecessor kept."""

import random

import pandas as pd

import corpus_pipeline
from shiftlab.llm import banding, decontaminate, pii, piece_model, quality, simhash
from shiftlab.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def test_stage_names_and_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII surrogates", "SentencePiece"]


def test_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), held_out=False)
    left = docs.toPandas().sort_values("doc_id")
    left = left[[model.scores(pd.DataFrame([quality.features(t.encode())]).to_numpy())[0] >= 0.5 for t in left.text]]
    left = left[corpus_brute(left)]
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    index = decontaminate.build([(i, t.encode()) for i, t in zip(items.item_id, items.text)])
    left = left[[not decontaminate.matches([decontaminate.normalised(t.encode())], index) for t in left.text]]
    pieces = piece_model.pieces(piece_model.model_bytes())
    want = {d: pieces.encode(pii.replaced(t)[0]).tolist() for d, t in zip(left.doc_id, left.text)}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < docs.count()


def corpus_brute(left):
    up = jaccard_brute([set(simhash.shingles(t.encode(), 5).tolist()) for t in left.text])
    return [u == i for i, u in enumerate(up)]


def test_near_copies_with_edits(spark):
    """Copies with an edit in every 125 words are linked; texts that share a passage aren't."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 9)))
    rows, truth, passage = [], [], [word() for _ in range(60)]
    for k in range(60):
        base = [word() for _ in range(rng.randint(120, 400))] + passage * (k % 2)
        for c in range(3):
            own = list(base)
            for _ in range(c * len(own) // 250):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
            truth.append(3 * k)
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] >= truth[i] for i in got)  # no two texts are joined
    assert sum(got[i] == truth[i] for i in got) >= 0.97 * len(got)


def jaccard_brute(sets, similarity=0.8):
    """Of each set, the first of its component, by Jaccard similarity alone."""
    up = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9 and up[i] != up[j]:
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    return up


def test_all_pairs_at_the_similarity(spark):
    """Pairs just above and below 0.8 are told apart whatever the distance of their fingerprints."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 9)))
    texts = []
    for _ in range(300):
        base = [word() for _ in range(rng.randint(60, 150))]
        for cut in (0, len(base) // 5 - rng.randint(0, 4)):  # as many words replaced in front
            texts.append(" ".join([word() for _ in range(cut // 2)] + base[cut // 2 :]))
    sets = [set(simhash.shingles(t.encode(), 5).tolist()) for t in texts]
    far = sum((simhash.fingerprint(a.encode(), 5) ^ simhash.fingerprint(b.encode(), 5)).bit_count() > 13 and len(x & y) >= 0.8 * len(x | y) for a, b, x, y in zip(texts[::2], texts[1::2], sets[::2], sets[1::2]))
    want = jaccard_brute(sets)
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want and far > 0


def test_fingerprints_link_in_the_pipeline(spark):
    """The stage keeps one of texts whose fingerprints differ in three bits or fewer, even where their Jaccard similarity is below 0.8, and equal ones."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 9)))
    texts = []
    while len(texts) < 6:
        phrase, tail = [word() for _ in range(5)], [word() for _ in range(6)]
        # one long run of a repeated phrase decides about the bits, distinct shingles at the end about the similarity
        a, b = (" ".join(phrase * 60 + tail[: 6 - k] + [word() for _ in range(k + 6)]) for k in (0, 6))
        x, y = (set(simhash.shingles(t.encode(), 5).tolist()) for t in (a, b))
        if (simhash.fingerprint(a.encode(), 5) ^ simhash.fingerprint(b.encode(), 5)).bit_count() <= 3 and len(x & y) < 0.8 * len(x | y):
            texts += [a, b]
    texts += [" ".join(word() for _ in range(50)) for _ in range(4)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, SF).collect())
    assert got == [0, 2, 4, 6, 7, 8, 9]


def test_short_near_copies(spark):
    """Short texts with words appended, put in front or substituted are linked exactly where the similarity is 0.8."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 9)))
    texts = []
    for n in (5, 8, 15, 20, 30, 40, 60):
        for _ in range(6):
            base = [word() for _ in range(n)]
            more = [word() for _ in range((n - 4) // 4 + rng.randint(0, 1))]
            at = rng.randrange(n)
            texts += [" ".join(x) for x in (base, base + more, more + base, base[:at] + [word()] + base[at + 1 :])]
    want = jaccard_brute([set(simhash.shingles(t.encode(), 5).tolist()) for t in texts])
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) < 0.7 * len(want)


def test_linked_beyond_the_centre(spark):
    """Chains of sets in one bucket, of which the centre is near to a few only, and groups of copies, whatever the chunks."""
    rng = random.Random(3)
    sets, value = [], []
    for bucket, n in enumerate((2, 3, 30, 60)):
        fresh = iter(rng.sample(range(1 << 40), 2000))
        own = [next(fresh) for _ in range(40)]
        for _ in range(n):
            sets.append(list(own))
            value.append(bucket)
            for at in rng.sample(range(40), rng.choice((1, 3, 5, 8))):
                own[at] = next(fresh)
    order = list(range(len(sets)))
    rng.shuffle(order)
    held = spark.createDataFrame([(i, sorted(sets[i])) for i in order], "hash long, shingles array<long>")
    rows = [(value[i], i) for i in order] + [(100 + value[i], i) for i in order if i % 2]
    met = banding.colliding(spark.createDataFrame(rows, "value long, hash long"))
    edges = [{*x} for x in sets]
    up = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if value[i] == value[j] and len(edges[i] & edges[j]) >= 0.8 * len(edges[i] | edges[j]) - 1e-9 and up[i] != up[j]:
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    assert len(set(up)) < len(up)
    for chunk in (1024, 7):
        found = {r.id: r.component for r in connected_components(banding.linked(met, held, 0.8, chunk)).collect()}
        assert [found.get(i, i) for i in range(len(sets))] == up
