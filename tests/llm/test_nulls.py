"""Null ids, null columns and clashing names, for every operator."""

import pytest

import corpus_pipeline
from strandflow.llm import decontaminate, exact_dedup, html_text, language_id, licenses, minhash, packing, phrases, quality, simhash, spelling, toxicity, url_filter

EXTRA = "rep long, fp string, key string, digest string, label string, score string, bucket string, kept string"
TEXTS = [None, "", "bar baba abra", "bar baba abra", "lele ell elle", "Released under the MIT License.", "a b c d e f g h i j k l"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 4 else None, t, "aa" if i % 2 else None, None, None, *[None] * 8) for i, t in enumerate(TEXTS)] * 2
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


def test_all_operators_take_nulls_and_clashing_names(spark, docs):
    n = docs.count()
    bench = spark.createDataFrame([(None, "x y z"), (1, None), (2, "a b c d e f g h i j k l")], "item_id long, text string")
    labels = spark.createDataFrame([(None, None, None), (2, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    pages = docs.select(docs.doc_id.alias("page_id"), docs.text.alias("url"), docs.text.alias("html"), docs.score.alias("host"), docs.label.alias("rule"))
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    assert url_filter.judge_urls(pages, rules).count() == n
    kept = exact_dedup.dedup_batch(docs, exact_dedup.half(docs.doc_id)).collect()
    assert len(kept) == n and all(r.kept is not None for r in kept)
    assert toxicity.score_documents(docs, toxicity.fit(docs, labels)).count() == n
    assert quality.score_documents(docs, quality.fit(docs, labels)).count() == n
    assert packing.pack_documents(docs).count() == n
    groups = simhash.simhash_groups(docs).collect()
    assert len(groups) == n and {r.component_id for r in groups if r.doc_id in (2, 3)} == {2}
    known = spark.createDataFrame(licenses.KNOWN, "license string, text string")
    assert {r.doc_id for r in licenses.scan_licenses(docs, known).collect()} == {5}
    assert language_id.identify(docs, language_id.learn(docs)).count() == n
    assert html_text.extract_text(pages, html_text.default_extractor(40)).count() == n
    assert {r.doc_id for r in decontaminate.find_overlaps(docs, bench).collect() if r.contaminated} == {6}
    sets = minhash.minhash_groups(docs).collect()
    assert len(sets) == n and sum(r.kept for r in sets) == len(TEXTS) - 2 - 1 + 4  # each wordless row stays by itself
    assert {(r.lang, r.phrase) for r in phrases.mine(docs, 3, 2).collect()} >= {("aa", "bar baba abra")}
    assert spelling.variants(spelling.word_counts(docs, 4, 2)).count() > 0
    for name, stage in corpus_pipeline.STAGES[1:3]:
        assert stage(spark, docs, "").columns == docs.columns, name
