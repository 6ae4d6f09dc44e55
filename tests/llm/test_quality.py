import random
import zlib

import numpy as np

from strandflow.llm import quality as ql


def sample(n, seed):
    rng = random.Random(seed)
    words = ["stone", "river", "walks", "under", "light", "green", "often", "hills"]
    rows = []
    for i in range(n):
        ws = [rng.choice(words) for _ in range(rng.randint(12, 120))]
        kind = i % 4
        text = " ".join(ws).capitalize() + "."
        if kind == 1:
            text = " ".join(w + rng.choice(["$$$", "%%%"]) for w in ws)
        if kind == 2:
            text = " ".join([rng.choice(words)] * len(ws))
        rows.append((text, int(kind in (0, 3))))
    return rows


def test_held_out_accuracy():
    data, held = sample(200, 1), sample(120, 2)
    space = ql.fit_space([t for t, _ in data], [y for _, y in data], dimensions=16)
    score = ql.vote([t for t, _ in held], space, block=50)
    y = np.array([y for _, y in held], bool)
    assert (score[y] >= 0.7).mean() > 0.97 and (score[~y] >= 0.7).mean() < 0.03


def test_votes_match_brute_force():
    data = sample(60, 3)
    space = ql.fit_space([t for t, _ in data], [y for _, y in data], dimensions=8, k=5)
    texts = [t for t, _ in sample(20, 4)]
    got = ql.vote(texts, space)
    for text, value in zip(texts, got):
        v = ql.weighted([text.encode()], space.idf)[0] @ space.axes
        cos = sorted(((float(v @ u / np.linalg.norm(v)), y) for u, y in zip(space.vectors, space.labels)), reverse=True)[:5]
        w = [max(c, 0) for c, _ in cos]
        assert abs(value - sum(a * y for a, (_, y) in zip(w, cos)) / sum(w)) < 1e-3


def test_odd_texts_and_sampling(spark):
    data = sample(80, 5)
    texts = [None, "", " ", "a", "ab", "stone " * 50_000, "\U0001f600"]
    rows = [(i, t, 0) for i, (t, _) in enumerate(data)] + [(500 + i, t, 0) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(i, y, None) for i, (_, y) in enumerate(data)] + [(None, 1, None), (501, None, None), (3, 1, None)], "doc_id long, quality int, text string")
    used = ql.labelled_texts(docs, labels, "quality", 4, 2, 15)
    assert (used.groupby("label").size() <= 15).all() and used["label"].nunique() == 2
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i in used["doc_id"])
    got = ql.score_documents(docs, ql.fit(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert ql.score_documents(docs.limit(0), ql.fit(docs, labels.limit(0))).collect() == []
    assert {r.score for r in ql.score_documents(docs, ql.fit(docs, labels.limit(0))).collect()} == {0.5}
