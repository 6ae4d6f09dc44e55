import random

import numpy as np

from strandflow.llm import decontaminate as dc


def brute(text, item):
    """Most agreeing tokens of any gapless alignment's best stretch."""
    a, b, best = dc.tokens(text), dc.tokens(item), 0
    for shift in range(-len(b), len(a)):
        score = got = 0
        for j in range(max(0, -shift), min(len(b), len(a) - shift)):
            same = a[j + shift] == b[j]
            score, got = (score + 1, got + 1) if same else (score - 3, got)
            if score <= 0:
                score = got = 0
            best = max(best, got if same else 0)
    return best


def test_best_stretch():
    assert dc.best_stretch(np.array([1, 1, 0, 1, 1, 1, 1, 0, 0, 1], bool)) in [(0, 7), (3, 7)]
    assert dc.best_stretch(np.zeros(4, bool)) [0] == dc.best_stretch(np.zeros(4, bool))[1]


def test_overlaps_match_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (15, 18, 30, 60, 120, 8, 6, 5, 3)] + ["", None, "Été à Paris, où l'on chante toujours de vieux airs"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs, planted, inserted = [None, "", " ", "clean words only"], {}, set()
    for i, item in enumerate(items):
        for kind in range(6):
            body = [rng.choice(words) for _ in range(80)]
            w = (item or "").split()
            if kind == 1:
                w = [x.upper() + "," for x in w]
            if kind == 2:
                w = [x if j % 7 != 5 else "zzz" for j, x in enumerate(w)]
            if kind == 3:
                w = w[len(w) // 3 :]
            at = rng.randint(0, 80)
            if kind < 4:
                body[at:at] = w
                inserted.add((len(docs), i))
                if item and (len(w) >= 12 or (kind < 2 and len(w) >= 5)):
                    planted[len(docs)] = i
            docs.append(" ".join(body))
    docs.append(" ".join(rng.choice(words) for _ in range(60_000)) + " " + items[3])
    planted[len(docs) - 1] = 3
    inserted.add((len(docs) - 1, 3))
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    for tokens in (dc.SLICE_TOKENS, 40):
        got = dc.find_overlaps(frame, bench, slice_tokens=tokens).collect()
        found = {(r.doc_id, r.item_id) for r in got if r.contaminated}
        assert set(planted.items()) <= found <= inserted
        for r in got:
            assert r.best <= r.matched <= r.item_tokens
            if len(docs[r.doc_id]) < 5000 and r.contaminated:
                assert r.best >= min(brute(docs[r.doc_id], items[r.item_id]), r.item_tokens) - 3
    kept = {r.doc_id for r in dc.drop_contaminated(frame, bench).collect()}
    assert kept == set(range(len(docs))) - {d for d, _ in found}


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    assert dc.find_overlaps(docs, bench).collect() == [] and dc.find_overlaps(some, bench).collect() == []
    assert dc.drop_contaminated(some, bench).count() == 1


def slow_overlap(text, item):
    """Covered item tokens and the best stretch over all gapless alignments."""
    a, b, covered, best = dc.tokens(text), dc.tokens(item), set(), (0, 0, 0)
    for shift in range(1 - len(b), len(a)):
        low = max(0, -shift)
        same = np.array([a[j + shift] == b[j] for j in range(low, min(len(b), len(a) - shift))], bool)
        for first, end in dc.stretches(same, min(dc.LEAST, len(b))):
            covered |= {low + first + k for k in range(end - first) if same[first + k]}
            best = max(best, (int(same[first:end].sum()), -(low + first + shift), -(low + first)))
    return len(covered), best[0], -best[1], -best[2]


def test_repeated_tokens_match_brute_force(monkeypatch):
    monkeypatch.setattr(dc, "PAIRS", 300)
    monkeypatch.setattr(dc, "TRIED", 5)
    rng = random.Random(4)
    for _ in range(60):
        words = "abc"[: rng.randint(1, 3)]
        item, text = (" ".join(rng.choice(words) for _ in range(rng.randint(8, n))) for n in (40, 400))
        got = dc.overlaps([None, "q", text], dc.build_slice([7], [item]), 10, 0.8)
        want = slow_overlap(text, item)
        assert [(r[0], r[2], *r[4:7]) for r in got] == ([(2, *want)] if want[1] else [])


def test_a_run_of_one_token_takes_little_memory():
    import tracemalloc

    part = dc.build_slice([1, 2], ["a " * 1000, "b " * 300])
    tracemalloc.start()
    got = dc.overlaps(["a " * 100_000, "b " * 16_000], part, 10, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(0, 1, 1000, 1000, 1000, 0, 0, True), (1, 2, 300, 300, 300, 0, 0, True)] and peak < 250e6


def test_stretches_of_an_alignment_add_up():
    item = [f"w{i}" for i in range(21)]
    copy = item[:9] + ["x", "y", "z"] + item[12:]
    part = dc.build_slice([4], [" ".join(item)])
    assert dc.overlaps(["a b " + " ".join(copy) + " c"], part, 10, 0.8) == [(0, 4, 18, 21, 9, 2, 0, True)]
    assert dc.overlaps([" ".join(item[:9])], part, 10, 0.8) == [(0, 4, 9, 21, 9, 0, 0, False)]
