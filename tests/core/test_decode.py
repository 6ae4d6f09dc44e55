from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.operators import decode as dc
from strandflow.operators.topology import NEXT
from strandflow.plans import annotate


def legal_paths(length):
    def grow(path):
        if len(path) == length:
            yield path
        else:
            for s in NEXT[path[-1]]:
                yield from grow([*path, s])

    for s in range(20):
        yield from grow([s])


def test_transitions_are_a_chain():
    t = dc.transitions()
    assert np.allclose(t.sum(axis=1), 1)
    assert {(a, b) for a, b in np.argwhere(t > 0)} == {(a, b) for a, bs in NEXT.items() for b in bs}


def test_viterbi_and_posterior_match_enumeration():
    rng = np.random.default_rng(0)
    steps, first = rng.normal(size=(3, 3)), rng.normal(size=3)
    scores = rng.normal(size=(2, 5, 3))
    got, post = dc.viterbi(scores, steps, first), dc.posterior(scores, steps, first)
    for b in range(2):
        value = {p: first[p[0]] + sum(scores[b, i, s] for i, s in enumerate(p)) + sum(steps[x, y] for x, y in zip(p, p[1:])) for p in product(range(3), repeat=5)}
        assert tuple(got[b]) == max(value, key=value.get)
        z = sum(np.exp(v) for v in value.values())
        for i, s in product(range(5), range(3)):
            assert np.isclose(post[b, i, s], sum(np.exp(v) for p, v in value.items() if p[i] == s) / z)


def test_ties_and_late_evidence():
    assert dc.viterbi(np.zeros((1, 6, 4)), np.zeros((4, 4)), np.zeros(4)).tolist() == [[0] * 6]
    n = 100_000
    scores = np.zeros((1, n, 2), np.float32)
    scores[0, -1000:, 1] = 2
    steps = np.where(np.eye(2, dtype=bool), 0, -1000).astype(np.float32)
    assert dc.viterbi(scores, steps, np.zeros(2, np.float32)).all()


@pytest.mark.parametrize("seed", range(6))
def test_constrained_decoding_matches_enumeration(seed):
    rng = np.random.default_rng(seed)
    length = 6
    bases = "".join(rng.choice(list("TAGN"), length, p=[0.4, 0.35, 0.2, 0.05]))
    scores = rng.normal(0, 3, (length, 20)).astype(np.float32)
    logs = dc.log_or_absent(dc.transitions())
    best = max((p for p in legal_paths(length) if dc.is_legal(np.array(p), bases)), key=lambda p: scores[0, p[0]] + sum(scores[i, s] + logs[r, s] for i, (r, s) in enumerate(zip(p, p[1:]), 1)))
    got = dc.constrained_viterbi(scores, bases)
    assert got.tolist() == best and dc.is_legal(got, bases)


def test_stop_codons_across_introns_and_utr_sides():
    def legal(path, bases):
        return dc.is_legal(np.array(path), bases)

    assert not legal([4, 5, 6], "TAA") and legal([4, 5, 6], "TAC") and legal([4, 5, 6], "TNA") and legal([4, 5, 14], "TAA")
    assert not legal([10, 3, 3, 13, 6], "TCCAG") and legal([10, 3, 3, 13, 6], "CCCAG")
    assert not legal([4, 8, 1, 1, 11], "TACCG") and legal([4, 8, 1, 1, 11], "TGCCG")
    assert legal([15, 17, 18, 19, 15], "AAAAA") and not legal([15, 17, 18, 19, 16], "AAAAA")
    assert not legal([0, 5], "AA") and legal([18, 19, 16], "AAA")


def test_anchors_and_impossible_windows():
    scores = np.zeros((4, 20), np.float32)
    assert dc.constrained_viterbi(scores, "ACGT", {0: 15, 3: 15})[[0, 3]].tolist() == [15, 15]
    with pytest.raises(ValueError):
        dc.constrained_viterbi(scores, "ACGT", {0: 0, 1: 18})


def test_windows_are_decoded_and_repaired(spark):
    def row(path, bases):
        p = np.full((len(path), 20), 0.001)
        p[range(len(path)), path] = 0.981
        return ("w", p.tolist(), bases)

    truth = [0, 0, 7, 5, 6, 4, 5, 6, 4, 5, 14, 0, 0]
    df = spark.createDataFrame([row(truth, "CCATGGCTTAACC"), row(truth, "CCATGTAATAACC"), ("e", None, None), ("e", [], "")], "k string, p array<array<double>>, bases string")
    got = dc.decode_windows(df, "k string", use_bases=False).collect()
    assert got[0].states == truth and not got[0].repaired
    assert got[1].repaired and dc.is_legal(np.array(got[1].states), "CCATGTAATAACC")
    assert got[2].states == got[3].states == []


def dense_viterbi(scores, steps, first):
    """The plain recursion over all steps, absent ones included."""
    v, back = first + scores[0], []
    for row in scores[1:]:
        v = v - v.max()
        reach = v[:, None] + steps
        back.append(reach.argmax(axis=0))
        v = reach.max(axis=0) + row
    path = [int(v.argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("spread", [1.0, 400.0])
def test_absent_steps_count_like_in_the_plain_recursion(spread):
    rng = np.random.default_rng(int(spread))
    scores = rng.normal(0, spread, (9, 60, 20)).astype(np.float32)
    steps, first = dc.log_or_absent(dc.transitions()), np.full(20, -np.log(20), np.float32)
    assert dc.viterbi(scores, steps, first).tolist() == [dense_viterbi(s, steps, first) for s in scores]


def test_windows_side_by_side_match_windows_alone():
    rng = np.random.default_rng(7)
    scores = rng.normal(0, 3, (12, 40, 20)).astype(np.float32)
    bases = ["".join(rng.choice(list("TAGCN"), 40, p=[0.3, 0.3, 0.2, 0.15, 0.05])) for _ in scores]
    codes = np.stack([dc.base_codes(b, 40) for b in bases])
    paths, found = dc.constrained_paths(scores, codes)
    assert found.all() and dc.legal_paths(paths, codes).all()
    assert paths.tolist() == [dc.constrained_viterbi(s, b).tolist() for s, b in zip(scores, bases)]
    random_paths = np.stack([np.array(p) for p in list(legal_paths(3))[::40]])
    codes = rng.integers(0, 5, random_paths.shape)
    assert dc.legal_paths(random_paths, codes).tolist() == [dc.is_legal(p, "".join("ACGTN"[c] for c in row)) for p, row in zip(random_paths, codes)]


def test_codon_terms_count_unknown_bases_as_quarters():
    for text in ("ATGNTAAGNNTGA", "nnn", "A"):
        terms = dc.codon_terms(dc.base_codes(text, len(text)))
        padded = "NN" + text.upper() + "NN"
        weight = lambda table, at: np.mean([table.get(a + b + c, 0) for a, b, c in product(*["ACGT" if x == "N" else x for x in padded[at : at + 3]])])  # noqa: E731, B023
        for i in range(len(text)):
            assert np.isclose(terms[i, 7], weight(dc.START, i + 2)) and np.isclose(terms[i, 14], weight(dc.STOP, i))
            assert np.isclose(terms[i, 6], (1 - weight(dict.fromkeys(dc.STOP, 1), i)) / 61) and terms[i, 0] == 1 / 64


def test_short_frames_lose_to_a_spliced_non_coding_reading():
    frame = [7, 5, 6, *[4, 5, 6] * 4, 4, 5, 14]
    path = np.array([0] * 3 + frame + [0] * 3)
    bases = "CCC" + "ATG" + "CCC" * 4 + "TAA" + "CCC"
    codes = dc.base_codes(bases, len(path))[None]
    scores = np.full((1, len(path), 20), -6.0, np.float32)
    scores[0, range(len(path)), path] = -1
    assert dc.repaired_paths(scores, codes)[0].tolist() == path.tolist()
    n = len(frame)
    reading = [15, 17, *[18] * (n - 4), 19, 16]
    scores[0, range(3, 3 + n), reading] = -0.01
    assert dc.constrained_paths(scores, codes)[0][0].max() > 0
    again = dc.repaired_paths(scores, codes)[0]
    strict = dc.constrained_paths(scores, codes)[0][0]
    frames = list(dc.coding_frames(strict))
    assert (again == (np.zeros(len(path)) if any(short for *_, short in frames) else strict)).all()
    long = np.array([0] * 3 + [7, 5, 6, *[4, 5, 6] * 30, 4, 5, 14] + [0] * 3)
    fixed = np.where(long > 0, long, -1)[None]
    kept, found = dc.constrained_paths(np.zeros((1, len(long), 20), np.float32), np.full((1, len(long)), 1), fixed, silent=True)
    assert found[0] and (kept[0][fixed[0] >= 0] == fixed[0][fixed[0] >= 0]).all()


def test_prefilter_leaves_windows_without_signal_intergenic():
    probs = np.full((3, 300, 20), 0.001)
    probs[0, :, 0] = probs[1, :, 0] = probs[2, :150, 0] = 0.9
    probs[1, 50:260, 4:15] = 0.09
    probs[2, 150:, 4:15] = 0.09  # 150 positions of signal are less than a frame
    assert dc.has_coding_signal(probs).tolist() == [False, True, False]
    assert dc.has_coding_signal(probs[2:, 150:]).tolist() == [True]
    paths, _ = dc.decoded(probs, None, prefilter=True)
    assert not paths[0].any() and not paths[2].any()


def test_whole_sequences_decode_alike_in_any_chunks(spark):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for name, n, size in (("a", 230, 50), ("b", 50, 50), ("c", 301, 100), ("d", 7, 3)):
        p = rng.dirichlet(np.full(20, 0.05), n)
        want[name] = dc.viterbi(dc.emissions(p, None)[None], dc.log_or_absent(dc.transitions()), np.full(20, -np.log(20), np.float32))[0].tolist()
        rows += [(name, k, p[i : i + size].tolist(), None) for k, i in enumerate(range(0, n, size))]
    rows.append(("e", 0, [], ""))
    df = spark.createDataFrame(rows, "seq_name string, chunk int, p array<array<double>>, bases string")
    for most in (dc.BROADCAST_CHUNKS, 0):
        dc.BROADCAST_CHUNKS = most
        got = {}
        for r in sorted(dc.decode_sequences(df.repartition(5)).collect(), key=lambda r: (r.seq_name, r.chunk)):
            got.setdefault(r.seq_name, []).extend(r.states)
        assert got == want | {"e": []}
    dc.BROADCAST_CHUNKS = 1_000_000


def test_posterior_windows(spark):
    p = np.random.default_rng(3).dirichlet(np.ones(20), 30)
    df = spark.createDataFrame([("k", p.tolist(), "ACGTT" * 6), ("e", None, None)], "k string, p array<array<double>>, bases string")
    got, empty = dc.posterior_windows(df, "k string").collect()
    post = dc.posterior(dc.emissions(p, "ACGTT" * 6)[None], dc.log_or_absent(dc.transitions()), np.full(20, -np.log(20), np.float32))[0]
    assert got.states == post.argmax(axis=1).tolist() and np.allclose(got.confidence, post.max(axis=1)) and empty.states == []


def test_likely_genic_stretches_are_decoded_by_themselves():
    rng = np.random.default_rng(12)
    for _ in range(30):
        n = int(rng.integers(1, 900))
        genic = np.repeat(rng.choice([0.0, 0.05, 0.3, 0.9], n // 40 + 1), 40)[:n]
        probs = np.zeros((n, 20))
        probs[:, 0], probs[:, 5] = 1 - genic, genic
        means = [genic[i : i + 50].mean() >= 0.1 for i in range(0, n, 50)]
        want, start = [], None
        for k, on in enumerate([*means, None]):
            if start is None and on:
                start = k
            if start is not None and not on:
                a, b = start * 50, min(n, (k + (on is not None)) * 50)
                if (genic[a:b] > 0.5).sum() >= 50:
                    want.append((max(0, a - 100), min(n, b + 100)))
                start = None
        merged = []
        for a, b in want:
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        assert dc.genic_slices(probs) == (merged or [(0, n)])
    gene = [15] * 30 + [7, 5, 6, *[4, 5, 6] * 20, 4, 5, 14] + [16] * 30
    probs = np.full((2, 800, 20), 0.0001)
    probs[..., 0] = 1 - 0.0019
    probs[0, 400 : 400 + len(gene), 0], probs[0, range(400, 400 + len(gene)), gene] = 0.0001, 1 - 0.0019
    paths, _ = dc.decoded(probs, None, regions=True)
    assert paths[0, 400 : 400 + len(gene)].tolist() == gene and (paths[0] > 0).sum() == len(gene) and not paths[1].any()


def test_shared_probabilities_are_those_of_each_row(spark):
    from strandflow import queries

    rows = spark.createDataFrame([("0",), ("19",), ("20",), ("4711",), ("-3",), ("-2000",), (None,)], "seq_name string")
    number = F.col("seq_name").cast("int")
    each = F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(19)), lambda s: F.when(s == (i * 7 + number) % 20, 0.6).otherwise(0.4 / 19)))
    got = queries._with_p(rows).withColumn("want", each)
    assert got.count() == 7 and got.where("p <> want OR p IS NULL").count() == 0


def test_chunks_move_without_probabilities(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f"s{i}", c, "A" * 12, rng.dirichlet(np.ones(20), 12).tolist()) for i in range(3) for c in range(4)]
    held = spark.createDataFrame(rows, "seq_name string, chunk long, bases string, p array<array<double>>")
    want = {(r.seq_name, r.chunk): list(r.states) for r in dc.decode_sequences(held).collect()}
    monkeypatch.setattr(dc, "BROADCAST_CHUNKS", 0)
    late = dc.decode_sequences(held.drop("p"), probabilities=lambda df: df.join(F.broadcast(held.select("seq_name", "chunk", "p")), ["seq_name", "chunk"]))
    assert {(r.seq_name, r.chunk): list(r.states) for r in late.collect()} == want


def test_scores_by_context_decode_as_probabilities_do():
    rng = np.random.default_rng(9)
    for length in (1, 2, 3, 40, 700):
        codes = rng.choice(5, (30, length), p=[0.3, 0.2, 0.2, 0.25, 0.05]).astype(np.uint8)
        codes[:10, length // 2 :] = 4  # padded windows
        for repair in (True, False):
            want = dc.decoded(dc.motif_scorer(codes), codes, repair)
            assert all(map(np.array_equal, dc.decoded_by_context(codes, dc.motif_scorer, repair), want))


def test_legal_walks_are_those_of_the_automaton():
    """Paths are legal if and only if some node of the automaton is left when all of them are kept side by side."""
    labels, initial, sources, weights, _, _ = dc.graph()
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 5, (400, 12))
    paths = np.empty_like(codes)
    paths[:, 0] = rng.integers(0, 20, 400)
    for t in range(1, 12):
        paths[:, t] = [rng.choice(NEXT[s]) if rng.random() < 0.99 else rng.integers(0, 20) for s in paths[:, t - 1]]
    want = []
    for path, bases in zip(paths, codes, strict=True):
        live = np.append(initial[bases[0]] & (labels == path[0]), False)
        for s, base in zip(path[1:], bases[1:], strict=True):
            came = (live[sources] & np.isfinite(weights[base])).any(axis=1)
            live = np.append(came & (labels == s), False)
        want.append(bool(live.any()))
    assert dc.legal_paths(paths, codes).tolist() == want
    assert 0 < sum(want) < 400


def test_states_do_not_leave_the_task_that_decodes_them(spark):
    windows = spark.createDataFrame([("a", s, 1, 7, "GATGCAT") for s in "+-"], "seq_name string, strand string, core_start long, core_end long, bases string")
    runs = annotate.window_runs(windows, scorer=dc.motif_scorer)
    assert runs._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    keys = "seq_name string, strand string, core_start long, core_end long"
    apart = annotate.path_runs(dc.decode_windows(windows, keys, scorer=dc.motif_scorer))
    assert sorted(map(tuple, runs.collect())) == sorted(map(tuple, apart.collect())) != []


def test_short_sequences_decode_as_a_whole_in_one_pass(spark, monkeypatch):
    """A group and a matrix for every short sequence took most of the time of the query."""
    rng = np.random.default_rng(21)
    tables = [rng.dirichlet(np.full(20, 0.05), 12).tolist() for _ in range(3)]
    own = rng.dirichlet(np.full(20, 0.05), 5).tolist()
    rows = [(s, c, (s + c) % 3, None, "ACGTACGTACGT") for s in range(9) for c in range(1 + s % 4)]
    rows += [(20, 0, None, own, "ACGTA"), (20, 1, 2, None, "ACGTACGTACGT"), (20, 2, None, None, None), (21, 1, 0, own, None), (21, 3, 1, None, None), (22, 0, None, [], None)]
    chunks = spark.createDataFrame(rows, "seq_name long, chunk long, like long, p array<array<double>>, bases string")
    shared = spark.createDataFrame(list(enumerate(tables)), "like long, p array<array<double>>")
    steps, want = dc.log_or_absent(dc.transitions()).astype(np.float64), {}
    for name in {r[0] for r in rows}:
        parts = [(c, p if p is not None else [] if like is None else tables[like]) for s, c, like, p, _ in rows if s == name]
        path, free = [], 0.0 if parts[0][0] == 0 and parts[0][1] else steps.max(axis=0)
        if any(p for _, p in parts):
            scores = np.concatenate([dc.emissions(np.array(p), None) for _, p in parts if p]).astype(np.float64)
            path = dc.viterbi(scores[None], steps, np.broadcast_to(free, 20))[0].tolist()
        for c, p in parts:
            want[name, c], path = path[: len(p)], path[len(p) :]
    once = dc.decode_sequences(chunks.repartition(5), shared=shared)
    shown = once._jdf.queryExecution().executedPlan().toString()
    assert shown.count("MapInArrow") == 1 and "MapInPandas" not in shown and "FlatMapGroups" not in shown
    assert {(r.seq_name, r.chunk): list(r.states) for r in once.collect()} == want
    each = chunks.join(shared.withColumnRenamed("p", "_p"), "like", "left").withColumn("p", F.coalesce("p", "_p"))
    for most in (dc.WHOLE, 30, 0):
        monkeypatch.setattr(dc, "WHOLE", most)
        for df, options in ((chunks, {"shared": shared}), (each, {})):
            assert {(r.seq_name, r.chunk): list(r.states) for r in dc.decode_sequences(df.repartition(5), **options).collect()} == want, (most, options)


def test_rows_that_end_at_different_positions_decode_as_by_themselves():
    rng = np.random.default_rng(22)
    steps, first = dc.log_or_absent(dc.transitions()), np.full(20, -np.log(20), np.float32)
    lengths = np.array([40, 40, 23, 22, 3, 1, 1])
    for spread in (1.0, 400.0):
        scores = rng.normal(0, spread, (len(lengths), 40, 20)).astype(np.float32)
        live = [(lengths > t).sum() for t in range(40)]
        paths = dc.best_paths(lambda t: scores[: live[t], t].T, (len(lengths), 40), steps, first, scores.dtype, lengths)  # noqa: B023
        for path, own, n in zip(paths, scores, lengths, strict=True):
            assert path[:n].tolist() == dc.viterbi(own[None, :n], steps, first)[0].tolist() and not path[n:].any()
