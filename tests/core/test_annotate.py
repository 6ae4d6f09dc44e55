"""The plans from windows to models: runs instead of positions, contexts folded apart, packs lifted back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.operators import decode as dc
from strandflow.operators import evaluate, stitch
from strandflow.operators.topology import CONTEXT, FEATURES, NEXT
from strandflow.plans import annotate, predict


def random_path(rng, n):
    """Mostly legal, with jumps."""
    s, out = int(rng.integers(20)), []
    for _ in range(n):
        out.append(s)
        s = int(rng.integers(20)) if rng.random() < 0.02 else int(rng.choice(NEXT[s]))
    return out


def tiles(rng, names=6, size=17):
    rows = []
    for i in range(names):
        path = random_path(rng, 160)
        for strand in "+-":
            for k in range(0, 160, size):
                own = path[k : k + size]
                rows.append((f"s{i}", strand, k + 1, k + len(own), (own if strand == "+" else own[::-1])))
    return rows


def test_runs_say_what_positions_say(spark):
    df = spark.createDataFrame(tiles(np.random.default_rng(5)), "seq_name string, strand string, core_start long, core_end long, states array<int>")
    runs = {tuple(r) for r in annotate.path_runs(df.repartition(3)).collect()}
    want = set()
    for r in df.collect():
        path = list(r.states if r.strand == "+" else r.states[::-1])
        a = 0
        for b in range(1, len(path) + 1):
            if b == len(path) or FEATURES[path[b]] != FEATURES[path[a]]:
                own = path[a:b]
                steps = zip(own, own[1:]) if r.strand == "+" else zip(own[1:], own)
                want.add((r.seq_name, r.strand, r.core_start, FEATURES[path[a]], r.core_start + a, r.core_start + b - 1, own[0], own[-1], own.count(7), own.count(14), all(y in NEXT[x] for x, y in steps)))
                a = b
    assert runs == want
    flanked = df.withColumn("states", F.concat(F.array(F.lit(3), F.lit(4)), "states", F.array(F.lit(5), F.lit(6))))
    assert {tuple(r) for r in annotate.path_runs(flanked, 2).collect()} == want


def test_models_from_runs_and_from_positions(spark):
    coding = [7, 5, 6, *[4, 5, 6] * 9, 4, 5, 14]
    rng = np.random.default_rng(2)
    rows = []
    for i in range(8):
        path = []
        while len(path) < 300:
            path += [0] * int(rng.integers(1, 30)) + [15] * 4 + (coding if rng.random() < 0.8 else coding[:-9]) + [16] * 5
        for strand in "+-":
            own = path if strand == "+" else path[::-1]
            rows += [(f"s{i}", strand, k + 1, k + len(own[k : k + 50]), own[k : k + 50] if strand == "+" else own[k : k + 50][::-1]) for k in range(0, len(own), 50) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "seq_name string, strand string, core_start long, core_end long, states array<int>").cache()
    got = {tuple(r) for r in annotate.models_from_runs(annotate.path_runs(df)).collect()}
    assert got == {tuple(r) for r in annotate.models_from_paths(annotate.genomic_paths(df)).collect()} and got


def test_contexts_are_cut_as_in_one_fold_over_the_block(spark):
    """Against a fold over all windows of a block in order."""
    rng = np.random.default_rng(4)
    kinds, rows = ["5UTR", "3UTR", "intron", "UTR_EI", "CDS", "intergenic"], []
    for block in range(40):
        at = 1
        for w in range(12):
            start, end = at, at + 9
            while at <= end:
                stop = min(end, at + int(rng.integers(1, 8)))
                rows.append(("s", "+", block, start, str(rng.choice(kinds, p=[0.25, 0.25, 0.3, 0.1, 0.05, 0.05])), at, stop))
                at = stop + 1
    df = spark.createDataFrame(rows, "seq string, strand string, block int, win_start long, kind string, start long, end long")

    def context(ranges, at, step):
        for kind, a, b in ranges:
            if kind not in CONTEXT or (b if step < 0 else a) != at:
                return
            yield kind
            at = (a if step < 0 else b) + step

    want = set()
    for block in range(40):
        own = [r for r in rows if r[2] == block]
        current = []
        for w in sorted({r[3] for r in own}):
            mine = [r[4:] for r in own if r[3] == w]
            if current:
                left, right = list(context(current[::-1], current[-1][2], -1)), list(context(mine, mine[0][1], 1))
                sides = {k for k in left + right if k.endswith("UTR")}
                if left and right and len(sides) > 1 and any(not k.endswith("UTR") for k in left + right):
                    want.add((block, w))
                    current = []
            current += mine
    assert {(r.block, r.at) for r in stitch.context_cuts(df).collect()} == want and len(want) > 20


def test_genes_match_as_in_one_greedy_pass(spark):
    rng = np.random.default_rng(6)
    for width in (1, 3):
        side = lambda n: sorted({(int(rng.integers(40)), f"o{rng.integers(12)}") for _ in range(n)} if width > 1 else {(g, f"o{rng.integers(6)}") for g in range(n)})  # noqa: E731, B023
        ref, pred = side(50), side(45)
        r = spark.createDataFrame([(g, o, f"t{k}") for k, (g, o) in enumerate(ref)], "gene long, orf string, first_tx string")
        p = spark.createDataFrame([(g, o, f"t{k:03}") for k, (g, o) in enumerate(pred)], "gene long, orf string, first_tx string")
        taken, want = set(), []
        for gene in sorted({g for g, _ in pred}):
            for g, o in pred:
                free = [x for x, y in ref if y == o and x not in taken]
                if g == gene and free:
                    want.append((gene, min(free)))
                    taken.add(min(free))
                    break
        assert sorted((m.pred_gene, m.ref_gene) for m in evaluate.match_genes(r, p).collect()) == sorted(want)


def test_report(spark, tmp_path):
    cds = spark.createDataFrame([("a", "t", "c", "+", 1, 9), ("b", "u", "c", "+", 21, 29)], "gene string, tx string, chrom string, strand string, start long, end long")
    tables = evaluate.report(cds, cds.where("gene = 'a'"))
    assert tables["summary"].first().asDict() == {"matched": 1, "predicted": 1, "reference": 2, "precision": 1.0, "recall": 0.5}
    evaluate.write_report(tables, str(tmp_path / "r"))
    assert [r.gene for r in spark.read.csv(str(tmp_path / "r/unmatched_reference"), header=True).collect()] == ["b"]


GENE = "ATG" + "GCC" * 40 + "TAA"


def sure_scorer(codes):
    """Sure of one frame, wherever the sequence of GENE stands, and of intergenic elsewhere, on the strand that it is given."""
    own = dc.base_codes(GENE, len(GENE))
    out = np.full((*codes.shape, 20), 0.001)
    out[..., 0] = 0.98
    states = [7, 5, 6, *[4, 5, 6] * 40, 4, 5, 14]
    for row, probs in zip(codes, out):
        for a in range(1 - len(own), len(row)):
            lo, hi = max(a, 0), min(a + len(own), len(row))
            if hi - lo > 30 and (row[lo:hi] == own[lo - a : hi - a]).all() and (row[lo:hi] != 1).any():
                probs[lo:hi] = 0.001
                probs[range(lo, hi), states[lo - a : hi - a]] = 0.98
    return out


@pytest.mark.parametrize(("core", "flank"), [(400, 0), (100, 0), (100, 40)])
def test_genes_are_found_packed_or_not(spark, core, flank):
    other = str.maketrans("ACGT", "TGCA")
    seqs = [("plus", "T" * 50 + GENE + "T" * 30), ("minus", "T" * 21 + GENE[::-1].translate(other) + "T" * 44), ("long", "T" * 600 + GENE + "T" * 300), ("none", "T" * 90), ("empty", "")]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(seqs)], "ord long, seq_name string, seq string")
    want = {("plus", "+", 51, 176), ("minus", "-", 22, 147), ("long", "+", 601, 726)}
    plain = {(r.chrom, r.strand, r.start, r.end) for r in predict.predict(df, core, flank, sure_scorer).collect()}
    packed = predict.predict_packed(df, core, 500, 20, 1000, flank=flank, scorer=sure_scorer)
    models = predict.finished(packed, df)
    assert plain == want == {(r.chrom, r.strand, r.start, r.end) for r in packed.collect()} == {(r.chrom, r.strand, r.start, r.end) for r in models.collect()}
    assert predict.finished(packed, df, least=200).count() == predict.finished(packed, df, "none", least_coding=127).count() == 0
    assert predict.finished(packed, df, "none").count() == 3


UTR = [15] * 30 + [17] + [18] * 60 + [19] + [16] * 30


def utr_windows(spark, size, p_sure=0.9):
    """Windows whose own best paths give an intron between a 5' and a 3' UTR, on both strands."""
    path = [0] * 70 + UTR + [0] * 75
    rows = []
    for strand in "+-":
        own = path if strand == "+" else path[::-1]
        for k in range(0, len(own), size):
            part = own[k : k + size] if strand == "+" else own[k : k + size][::-1]
            p = np.full((size, 20), (1 - p_sure) / 19)
            padded = part + [0] * (size - len(part)) if strand == "+" else [0] * (size - len(part)) + part
            p[range(size), padded] = p_sure
            rows.append(("s", strand, k + 1, min(k + size, len(own)), "C" * size, p.tolist()))
    return spark.createDataFrame(rows, "seq_name string, strand string, core_start long, core_end long, bases string, p array<array<double>>"), len(path)


@pytest.mark.parametrize("size", [45, 60])
def test_utr_contexts_over_windows_are_repaired(spark, size):
    windows, n = utr_windows(spark, size)
    runs = annotate.path_runs(dc.decode_windows(windows, predict.KEYS, use_bases=False)).cache()
    near = stitch.conflict_windows(predict.window_ends(runs), runs)
    assert near.count() >= 6
    fixed, audit = predict.utr_repaired(runs, windows, use_bases=False)
    done = {(r.strand, r.status) for r in audit.collect()}
    assert done == {("+", "repaired"), ("-", "repaired")}
    spans = sorted((r.strand, r.start, r.end) for r in fixed.collect())
    for strand in "+-":
        own = [(a, b) for s, a, b in spans if s == strand]
        assert own[0][0] == 1 and own[-1][1] == n and all(b + 1 == c for (_, b), (c, _) in zip(own, own[1:]))
    assert stitch.conflict_windows(predict.window_ends(fixed), fixed).count() == 0
    whole = {}
    for r in sorted(fixed.collect(), key=lambda r: (r.strand, r.start)):
        whole.setdefault(r.strand, []).append((r.kind, r.end - r.start + 1))
    assert [k for k, _ in whole["+"]] != [] and sum(x for _, x in whole["-"]) == n


def test_windows_that_do_not_fit_are_predicted_as_one(spark):
    """The pair's path replaces both windows' paths, on either strand."""
    path = [0] * 40 + [7, 5, 6, *[4, 5, 6] * 15, 4, 5, 14] + [0] * 29
    rows = []
    for strand in "+-":
        own = path if strand == "+" else path[::-1]
        for k in range(0, 120, 60):
            part = own[k : k + 60] if strand == "+" else own[k : k + 60][::-1]
            p = np.full((60, 20), 0.002)
            p[range(60), part] = 0.96
            rows.append(("s", strand, k + 1, k + 60, "C" * 60, p.tolist()))
    windows = spark.createDataFrame(rows, "seq_name string, strand string, core_start long, core_end long, bases string, p array<array<double>>")
    broken = dc.decode_windows(windows, predict.KEYS, use_bases=False).withColumn("states", F.when(F.col("core_start") == 1, F.array_repeat(F.lit(0), 60)).otherwise(F.col("states")))
    runs = annotate.path_runs(broken)
    fixed, known = predict.rejoined(runs, windows, 60, use_bases=False)
    assert known.count() == 4
    models = {(r.strand, r.feature, r.start, r.end) for r in annotate.models_from_runs(fixed.cache()).collect()}
    assert models == {("+", "CDS", 41, 91), ("-", "CDS", 30, 80)}


def slow_packs(rows, threshold, spacer, target, prefix):
    used, out, number, at, name = {n for n, _ in rows if n.startswith(prefix)}, [], 0, 0, None
    for own, n in rows:
        if n >= threshold:
            name = None
            out.append((own, own, 1, n, n))
            continue
        if name is None or at + spacer + n > target:
            number, at, again = number + 1, 0, 1
            base = name = f"{prefix}{number:06d}"
            while name in used:
                again += 1
                name = f"{base}_{again}"
        start = at + spacer + 1 if at else 1
        at = start + n - 1
        out.append((name, own, start, at, n))
    return out


def test_packs_of_stretches_are_numbered_on(spark):
    rng = np.random.default_rng(8)
    names = [f"n{i}" for i in range(300)]
    names[5], names[50], names[51], names[52] = "p_000001", "p_000002", "p_000002_2", "p_000002_4"
    names[60], names[61] = "p_x", "p_000003_2"
    for share in (0.0, 0.1, 0.9):
        rows = [(n, int(rng.integers(500, 900)) if rng.random() < share else int(rng.integers(0, 120))) for n in names]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, name string, length long")
        assert [tuple(r) for r in predict.planning.pack(df.repartition(7), 300, 10, 400, "p_").collect()] == slow_packs(rows, 300, 10, 400, "p_")
    assert predict.planning.pack(df.limit(0), 300).collect() == []


def test_from_fasta_to_gff3(spark, tmp_path):
    path, out = tmp_path / "g.fa", str(tmp_path / "out.gff3")
    path.write_text(f">one first\n{'T' * 50 + GENE + 'T' * 30}\n>two\n{'T' * 300}\n")
    assert not predict.predict_file(spark, str(path), out, 400, 500, most_records=1)
    assert predict.predict_file(spark, str(path), out, 400, 500, scorer=sure_scorer)
    rows = predict.features.read_features(spark, out).collect()
    assert {(r.seqid, r.feature, r.start, r.end) for r in rows} == {("one", f, 51, 176) for f in ("gene", "mRNA", "exon", "CDS")}
    assert spark.read.schema("status string").json(out + ".repair.json").count() == 0
    path.write_text(">a\nAC\n>a\nGT\n")
    with pytest.raises(ValueError, match="more than one record: a"):
        predict.predict_file(spark, str(path), out)
