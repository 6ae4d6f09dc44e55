import random

import corpus_pipeline
from strandflow.llm import packing

from .test_decontaminate import brute as best_overlap
from .test_exact_dedup import brute as brute_dedup
from .test_similar_text import slow_roots

SPEECH = {"aa": ["bar", "baba", "abra", "rab", "ra"], "ee": ["lele", "ell", "elle", "tel", "le"]}


def corpus():
    rng = random.Random(8)

    def text(lang, n):
        return " ".join(rng.choice(SPEECH[lang]) + rng.choice(["", "s", "t", "n", "m"]) for _ in range(n))

    items = [text("aa", 20), text("ee", 30)]
    docs = [text(lang, rng.randint(20, 200)) for lang in SPEECH for _ in range(40)]
    docs += [None, "", "12 34", "?!"]
    docs += [docs[3], docs[3] + " ", docs[50].replace(" ", "\n", 3), docs[3]]
    long = text("ee", 900)
    docs += [long] + [" ".join(w if i != k else "zel" for i, w in enumerate(long.split())) for k in (7, 300, 899)]
    docs += [text("aa", 40) + " " + items[0] + " " + text("aa", 9), text("ee", 60) + "\n" + items[1]]
    langs = ["aa"] * 40 + ["ee"] * 40 + [None] * (len(docs) - 80)
    return [(i, t, x, "s", len(t or "")) for i, (t, x) in enumerate(zip(docs, langs))], items


def test_pipeline_matches_brute_force(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = [(i, t) for i, t, *_ in docs if t and any(c.isalpha() for c in t)]
    left = [(i, t) for i, t in left if i in {r[0] for r in brute_dedup(left) if r[3]}]
    root = slow_roots(dict(left))
    left = [(i, t) for i, t in left if root[i] == i]
    left = [(i, t) for i, t in left if all(best_overlap(t, item) < 10 for item in items)]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(t.split()) for i, t in left}
    lengths = sorted({len(t.split()) for _, t in left})
    counts = [sum(len(t.split()) == n for _, t in left) for n in lengths]
    tops = packing.optimal_buckets(lengths, counts, 16)
    assert all(r.padded_to == min(t for t in tops if t >= r.n_tokens) for r in got)


def test_stages_keep_the_columns_and_empty_tables(spark, tmp_path):
    docs, items = corpus()
    frame = spark.createDataFrame(docs[:0], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns and out.collect() == []
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_rows_are_told_apart_by_more_than_their_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (5, b), (None, c), (None, c.replace(" ", "  ", 2)), (None, a), (7, b + " tail"), (None, c + " tail"), (8, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n long")
    stages = dict(corpus_pipeline.STAGES)
    distinct = stages["exact_dedup"](spark, docs, "")
    assert distinct.columns == docs.columns
    got = sorted(((r.doc_id or 0, " ".join(r.text.split())) for r in distinct.collect()))
    assert got == [(0, c), (0, c + " tail"), (3, a), (5, b), (7, b + " tail"), (8, "")]
    assert sorted((r.doc_id or 0, r.text[:1]) for r in stages["simhash"](spark, distinct, "").collect()) == [(0, "c"), (3, "a"), (5, "b"), (8, "")]
