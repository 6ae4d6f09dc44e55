import random
from itertools import combinations

from strandflow.llm import packing as pk


def padding(lengths, counts, tops):
    return sum(c * (min(t for t in tops if t >= x) - x) for x, c in zip(lengths, counts))


def test_dynamic_program_is_optimal():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 9)
        lengths, counts = sorted(rng.sample(range(40), n)), [rng.randint(1, 50) for _ in range(n)]
        for k in range(1, 5):
            tops = pk.optimal_buckets(lengths, counts, k)
            assert len(tops) <= k and tops[-1] == lengths[-1]
            best = min(padding(lengths, counts, [*c, lengths[-1]]) for m in range(k) for c in combinations(lengths, m))
            assert padding(lengths, counts, tops) == best
    assert pk.optimal_buckets([], [], 3) == []


def test_batches(spark, monkeypatch):
    monkeypatch.setattr(pk, "SHARD_ROWS", 40)
    rng = random.Random(4)
    texts = [None, "", " \n", "a"] + ["w " * rng.choice([3, 3, 3, 9, 20, 57, 99]) for _ in range(400)] + ["x " * 150] * 3
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(7, "q", 1)], "doc_id long, text string, bucket int")
    rows = pk.pack_documents(docs, budget=100, n_buckets=3).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted([(i, len((t or "").split())) for i, t in enumerate(texts)] + [(7, 1)])
    batches, lengths = {}, {}
    for r in rows:
        batches.setdefault((r.bucket, r.batch), []).append(r)
        lengths.setdefault(r.bucket, set()).add(r.padded_to)
        assert r.n_tokens <= r.padded_to
    for (bucket, n), own in batches.items():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert len(own) == 1 or len(own) * own[0].padded_to <= 100
        last = n == max(b for k, b in batches if k == bucket)
        assert last or len(own) == max(1, 100 // max(own[0].padded_to, 1))
    assert len([r for r in rows if r.n_tokens == 150 and r.bucket == 3]) == 3
    assert pk.pack_documents(docs.limit(0)).collect() == []
