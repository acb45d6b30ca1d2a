"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from layerlens.llm import dedup, html, jaccard, licenses, packing, pii, quality, secrets, subwords, toxicity
from layerlens.llm.components import components
from layerlens.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, kept boolean, secrets string, licenses string, pieces string, score string, label string, token string, `key` string"
LONG = "word and other words that go on, " * 20_000
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "same text here for two of them"), (6, "same text here for two of them"), (7, "a"), (7, "a"), (None, "no id at all"), (8, "x" * 100_000), (9, "1" * 50_000), (10, "\U0001f600 é \x00 end")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *["x" if k else True for k in range(8)]) for i, t in ROWS], SCHEMA)


RUNS = {
    "packing": lambda d: packing.pack_documents(d, vocabulary("word_bpe_49k.json")),
    "secrets": lambda d: secrets.scan_secrets(d),
    "subwords": lambda d: subwords.encode(d, vocabulary("piece_bpe_32k.model")),
    "jaccard": lambda d: jaccard.jaccard_classes(d, bits=12),
    "pii": lambda d: pii.find_pii(d),
    "html": lambda d: html.extract(d, "text"),
    "quality": lambda d: quality.quality_verdicts(d, metrics=tuple(quality.MEASURES)),
    "licenses": lambda d: licenses.license_scan(d),
    "dedup": lambda d: dedup.exact_dedup(d),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_a_row_for_each_row(docs, name):
    got = RUNS[name](docs).collect()
    if name == "packing":
        assert len({(r.doc_id, r.ids_crc32) for r in got if r.piece == 0}) >= len(ROWS) - 2
    else:
        assert len(got) == len(ROWS)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_empty_table(docs, name):
    assert RUNS[name](docs.limit(0)).count() == 0


def test_dedup_of_nulls_and_repeats(docs):
    got = {(r.doc_id, r.keep_id): (r.group_size, r.kept) for r in dedup.exact_dedup(docs).collect()}
    assert got[1, 1] == (2, True) and got[2, 1] == (2, False) and got[3, 3] == (1, True)
    assert got[6, 5] == (2, False) and got[7, 7] == (2, True) and got[None, None] == (1, True)


def test_jaccard_of_nulls_and_repeats(docs):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs, bits=12).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 4, 5), (6, 4, 5), (7, 1, 7), (None, 1, None)} <= got


def test_sanitise_keeps_columns(docs):
    assert pii.sanitise(docs).columns == docs.columns and pii.sanitise(docs).count() == len(ROWS)


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert {r.score for r in model.score(docs).collect()} == {0.0}


def test_toxicity_learns(spark):
    rows = [(i, f"you are a stupid idiot number {i}" if i % 2 else f"a calm walk along the river {i}", i % 2) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scored = toxicity.fit(d, d.select("doc_id", "toxic"), trees=3).score(d.select("doc_id", "text")).collect()
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in scored)


def test_toxicity_scores_odd_rows(spark):
    rows = [(i, f"you are a stupid idiot number {i}" if i % 2 else f"a calm walk along the river {i}", i % 2) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(d, d.select("doc_id", "toxic"), trees=3)
    names = ["__x", "__features", "__raw", "__probability", "__score", "__row", "score", "label"]
    odd = spark.createDataFrame([(i, t, *range(len(names))) for i, t in ROWS], f"doc_id long, text string, {', '.join(f'{c} int' for c in names)}")
    got = model.score(odd)
    assert sorted(got.columns) == sorted(odd.columns) and got.count() == len(ROWS)
    assert all(0 <= r.score <= 1 for r in got.collect()) and len({r.score for r in got.where("doc_id = 7").collect()}) == 1
    assert model.score(odd.limit(0)).count() == 0


LARGE = [((1 << 60) + 1, "one text of a large id and more"), ((1 << 60) + 3, "another text of its own here, long enough"), (None, "a third text that has no id at all")]


def test_large_ids_beside_a_null(spark):
    rows = spark.createDataFrame(LARGE, "doc_id long, text string").coalesce(1)
    want = {i for i, _ in LARGE}
    assert {r.doc_id for r in packing.pack_documents(rows, vocabulary("word_bpe_49k.json")).collect()} == want
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_classes(rows, bits=12).collect()} == {(i, i) for i in want}


PIPE = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_keeps_texts_under_one_id(spark, sf):
    import corpus_pipeline as p

    rows = [(1, "a text", "b", "x", 6), (1, "b text", "b", "x", 6), (1, "a  text", "a", "x", 7), (2, "c", "b", "x", 1), (3, "a text", "b", "x", 6), (None, "c", "b", "x", 1), (None, "d", "b", "x", 1), (None, "d", "a", "x", 1)]
    got = p.exact_copies(spark, spark.createDataFrame(rows, PIPE), sf).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "d"), (1, "a  text"), (1, "b text"), (2, "c")]
    near = [(1, "one two three four five", "b", "x", 1), (1, "quite another text of five", "b", "x", 1), (2, "one two three four five", "b", "x", 1), (None, "One two three four five", "b", "x", 1), (None, None, "b", "x", 1)]
    got = p.near_copies(spark, spark.createDataFrame(near, PIPE), sf).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (1, "one two three four five"), (1, "quite another text of five")]


def test_pipeline_stages_on_nothing_and_on_odd_rows(spark, sf):
    import corpus_pipeline as p

    odd = [(i, t, None, None, None) for i, t in ROWS]
    for name, stage in p.STAGES:
        assert stage(spark, spark.createDataFrame([], PIPE), sf).count() == 0, name
        got = stage(spark, spark.createDataFrame(odd, PIPE), sf)
        assert got.count() > 0 or name == "quality rules"
        if name != "best-fit packing":
            assert got.columns == [f.split()[0] for f in PIPE.split(", ")]


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long")).count() == 0
