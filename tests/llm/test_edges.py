"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import json

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from shiftlab.llm import decontaminate, embedding_join, html_text, langid, paragraphs, pii, piece_model, ppm, quality, simhash

LONG = " ".join(f"word{i % 997}x{i % 13}" for i in range(60_000))
PROSE = "The quick brown fox jumps over the lazy dog while the sun sets behind the old stone bridge near the quiet river bank"
ROWS = [
    (1, PROSE, "en", "s", 10), (2, PROSE, "en", "s", 10), (3, None, None, None, None), (4, "", "en", None, 0), (5, LONG, "en", "s", 1), (6, "   \n\t ", "de", "s", 1),
    (None, PROSE, "en", "s", 1), (None, None, None, None, None), (7, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich", "de", "s", 1), (7, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich", "de", "s", 1),
    (8, "!!! 123", "de", "s", 1), (9, "mail a.b@example.com now", "en", "s", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def extra(docs):
    names = ["fp", "hash", "start", "end", "cluster", "component", "id", "n", "batch", "train", "key", "removed", "piece", "label", "x"]
    return docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PROSE), (2, None), (None, "x" * 50), (3, ""), (4, "abc")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, 1, 0), (8, 0, 1), (None, 1, 0), (2, None, 0), (9, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")


def operators(docs, benchmark, labels):
    yield "simhash", simhash.near_duplicates(docs)
    yield "decontaminate", decontaminate.contaminated(docs, benchmark)
    yield "pii", pii.surrogates(docs)
    yield "pieces", piece_model.encoded(docs)
    yield "paragraphs", paragraphs.repeats(docs)
    yield "removals", paragraphs.removals(paragraphs.repeats(docs))
    yield "quality", quality.score(docs, quality.fit(docs, labels))
    yield "langid", langid.predict(docs, langid.fit(docs))
    yield "ppm", ppm.scored(docs, batch=1 << 12)


PER_ROW = {"simhash", "pii", "pieces", "quality", "langid", "ppm"}


def test_odd_rows(docs, extra, benchmark, labels):
    for table in (docs, extra):
        for name, out in operators(table, benchmark, labels):
            rows = out.collect()
            if name in PER_ROW:
                assert len(rows) == len(ROWS), name


def test_empty_tables(spark, docs, extra, benchmark, labels):
    for name, out in operators(docs.limit(0), benchmark.limit(0), labels.limit(0)):
        assert out.count() == 0, name
    for name, out in operators(extra.limit(0), benchmark, labels):
        assert out.count() == 0, name


def test_simhash_defined(docs):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    zero = {(d, c) for d, f, c in got if f == "0" * 16}
    assert zero == {(3, 3), (4, 3), (6, 3), (None, 3)}
    assert {c for d, _, c in got if d in (1, 2)} == {1} and sum(d is None for d, _, _ in got) == 2


def test_decontaminate_defined(docs, benchmark):
    got = sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(docs, benchmark).collect())
    assert got == [(1, 1, 0), (2, 1, 0)]


def test_langid_defined(docs):
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.fit(docs.where("doc_id != 5"), held_out=False)).collect()}
    assert got[3] == got[4] == got[6] == got[8] == ("und", 0.0) and got[1][0] == "en" and got[7][0] == "de"


def test_quality_without_labels(docs, labels):
    got = quality.score(docs, quality.fit(docs, labels.limit(0))).collect()
    assert {r.quality_score for r in got} == {0.5}
    assert all(0 <= r.quality_score <= 1 for r in quality.score(docs, quality.fit(docs, labels, held_out=False)).collect())


def test_ppm_defined(docs):
    got = ppm.scored(docs.where("doc_id = 4 or doc_id is null and text is null or doc_id = 3")).collect()
    assert {(r.n_tokens, r.held_out) for r in got if r.doc_id != 3 and r.doc_id != 4} == {(1, False)}
    assert all(r.n_tokens == 1 and r.score <= 0 for r in got)


def test_pieces_defined(docs):
    got = {r.doc_id: (r.piece_ids, r.round_trip) for r in piece_model.encoded(docs.where("doc_id is not null")).collect()}
    assert got[3] == (None, None) and got[4] == ([], True) and got[5][1] and got[6][1]
    back = {r.doc_id: (r.text, r.decoded) for r in piece_model.decoded(piece_model.encoded(docs.where("doc_id is not null"))).collect()}
    assert all(a == b for a, b in back.values())


def test_embeddings_odd(spark):
    unit = [0.6, 0.8, 0.0]
    rows = [(1, unit), (2, [1.2, 1.6, 0.0]), (3, None), (4, [0.0] * 3), (5, [float("nan"), 1.0, 0.0]), (6, [None, 1.0, 0.0]), (7, [float("inf"), 1.0, 0.0]), (8, []), (9, unit), (None, unit), (10, unit + [0.0]), (11, [0.0, 0.0, -1.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("e", F.lit(1)).withColumn("n", F.lit(1))).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[9] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 10, 11)) and got[None][0] == 0
    assert embedding_join.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pages_odd(spark):
    page = "<html><body><nav>menu</nav><article><h1>Title &amp; more</h1><p>One<br>two</p></article><footer>f</footer></body></html>"
    rows = [(1, "http://a.example/x", page), (2, None, page), (3, "nonsense", None), (4, "http://a.example/y", ""), (None, "http://a.example/x", page), (1, "http://a.example/x", page), (5, "http://A.example", "<p>" * 5000 + "deep"), (6, "http://b.example", "a < b & c <"), (7, "http://b.example", "<!-- x <p>hid</p>")]
    got = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("h")).withColumn("part", F.lit(1))).collect()
    assert len(got) == len(rows)
    assert {r.text for r in got if r.page_id in (1, 2, None)} == {"Title & more One two"}
    by = {r.page_id: r for r in got}
    assert by[3].text == by[4].text == by[7].text == "" and by[5].text == "deep" and by[3].n_chars == 0
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, docs, benchmark, labels, tmp_path, empty):
    d = str(tmp_path)
    cut = (lambda x: x.limit(0)) if empty else (lambda x: x)
    benchmark.write.parquet(f"{d}/benchmark.parquet")
    cut(labels).write.parquet(f"{d}/labels.parquet")
    cut(docs).write.parquet(f"{d}/documents.parquet")
    table = spark.read.parquet(f"{d}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, d)
        rows = out.collect()
        assert not empty or not rows
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == table.columns
    json.dumps([str(r) for r in corpus_pipeline.run(spark, d).collect()])


def test_names_of_any_number_of_words():
    """One surname before a lower-case word, and three words or more, are replaced; the surname alike in all."""
    new, found = pii.replaced("Mr. Smith said hello. Dr. Anna Maria Smith agreed, as Mr. John Smith did, but Mr. speaker and Miss out did not.")
    assert [kind for kind, *_ in found] == ["name"] * 3 and [len(x.split()) for *_, x in found] == [1, 3, 2]
    assert "Smith" not in new and len({x.split()[-1] for *_, x in found}) == 1
    assert new.startswith("Mr. ") and " said hello. Dr. " in new and new.endswith(" did, but Mr. speaker and Miss out did not.")


def test_secrets_however_written():
    """Letter case, spacing and quotes of the keyword don't matter, nor whether the text has a digit elsewhere."""
    for text in ('TOKEN = "9233A8BC17"', 'Password="correcthorse"', "api_key  :'abcdefghij'", '{"secret": "abcdefgh"}', 'x token: "qwertyuiop" y', 'API_KEY\t=\t"abcdefgh"'):
        new, found = pii.replaced(text)
        [(kind, start, end, surrogate)] = found
        assert kind == "secret" and text[start - 1] == text[end] and text[start - 1] in "\"'" and len(surrogate) == end - start and surrogate != text[start:end]
        assert new == text[:start] + surrogate + text[end:] and surrogate.isupper() == text[start:end].isupper()
    assert pii.replaced("the token = short and a password of letters")[1] == []


def test_html_large_hosts(spark):
    """A notice on a few pages of a host is found whatever the number of its groups, also where only one of the pages has no article."""
    notice = " ".join(f"notice{i}" for i in range(30))
    page = lambda i, more: f"<html><body><p>{' '.join(f'w{i}x{j}' for j in range(40))}</p>{more}</body></html>"
    rows = [(i, "http://a.example/", page(i, f"<p>{notice}</p>" if i in (3, 17) else "")) for i in range(40)]
    rows += [(40 + i, "http://b.example/", page(i, f"<p>{notice}</p>") if i == 5 else f"<article><p>{notice}</p></article>" if i == 9 else page(i, "")) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole, parts = ({r.page_id: r.text for r in html_text.extracted(pages, g).collect()} for g in (256, 2))
    assert whole == parts and [i for i, t in parts.items() if "notice3" in t] == [49]
