import gzip

import numpy as np
import pytest

from strandflow.operators import annotation
from strandflow.plans import annotate
from strandflow.sources import fasta, features, vectors


def test_fasta_round_trip(spark, tmp_path):
    path = tmp_path / "g.fa"
    path.write_text("\n>a first one\r\nAC\n\ngt\n>b\nNN\n>c  x\n")
    rows = {r.seq_name: r for r in fasta.read_fasta(spark, str(path)).collect()}
    assert {k: (r.description, r.seq, r.length) for k, r in rows.items()} == {"a": ("first one", "ACGT", 4), "b": ("", "NN", 2), "c": ("x", "", 0)}
    assert fasta.read_fasta(spark, str(path), upper=False, min_length=3).first().seq == "ACgt"
    assert fasta.count_records(spark, str(path)) == 3 and fasta.too_many_records(spark, str(path), 2) and not fasta.too_many_records(spark, str(path), 0)
    out = str(tmp_path / "o.fa")
    fasta.write_fasta(fasta.read_fasta(spark, str(path)), out)
    assert sorted(map(tuple, fasta.read_fasta(spark, out).collect())) == sorted(map(tuple, fasta.read_fasta(spark, str(path)).collect()))
    with gzip.open(tmp_path / "z.fa.gz", "wt") as f:
        f.write(">a\nAC\n>a\nGT\n")
    assert fasta.duplicate_names(fasta.read_fasta(spark, str(tmp_path / "z.fa.gz"))).first().n == 2


def test_feature_files(spark, tmp_path):
    path = tmp_path / "a.gtf"
    path.write_text('# c\n\nchr1\ts\tCDS\t9\t1\t.\t+\t0\tgene_id "g; x";\n')
    row = features.read_features(spark, str(path)).first()
    assert (row.start, row.score, row.phase, row.attributes) == (9, None, 0, 'gene_id "g; x";')
    assert features.read_features(spark, str(path), strict=False).first().start == 1
    assert features.feature_lines(features.read_features(spark, str(path))).first().line == path.read_text().splitlines()[2]
    path.write_text("chr1\tonly\tthree\n")
    assert features.read_features(spark, str(path), strict=False).count() == 0
    with pytest.raises(Exception, match="not nine columns"):
        features.read_features(spark, str(path)).collect()
    assert features.repeat_path("a/b.gff3.gz") == "a/b.repeat.gff3.gz" and features.repeat_path("a.b/c") == "a.b/c.repeat.gff"
    assert features.is_gff3("x.GFF.gz") and not features.is_gff3("x.gtf")


def test_vector_names(spark):
    names = spark.createDataFrame([("Homo_sapiens",), ("mus musculus",), ("x",)], "name string")
    v = spark.createDataFrame([("Homo sapiens", [1.0]), ("Mus_musculus", [2.0])], "key string, embedding array<float>")
    assert {r.name: r.embedding for r in vectors.find_vectors(names, v).collect()} == {"Homo_sapiens": [1.0], "mus musculus": [2.0], "x": None}


def test_models_from_windows_and_gff3(spark, tmp_path):
    """Windows of a true path give the same gene whatever their size, on both strands."""
    rng = np.random.default_rng(1)
    coding = [7, 5, 6] + [4, 5, 6] * 30
    inner = coding[:50] + [8, *[1] * 40, 11] + [4, 5, 6] * 8 + [4, 5, 14]
    path = [0] * 20 + [15] * 10 + inner + [16] * 12 + [0] * 30
    bases = list("".join(rng.choice(list("CG"), len(path))))
    path[path.index(15) + 10 + 49] = path[path.index(15) + 10 + 49]
    results = set()
    for size in (len(path), 64, 33):
        for strand in "+-":
            rows = []
            own = path if strand == "+" else path[::-1]
            for i in range(0, len(own), size):
                part = own[i : i + size]
                states = part if strand == "+" else part[::-1]
                p = np.full((len(states), 20), 0.0001)
                p[range(len(states)), states] = 0.998
                rows.append(("s", strand, i + 1, i + len(part), "".join(bases[: len(part)]), p.tolist()))
            df = spark.createDataFrame(rows, "seq_name string, strand string, core_start long, core_end long, bases string, p array<array<double>>")
            models = annotate.annotate(df, use_bases=False).collect()
            n = len(path)
            spans = sorted((r.feature, r.start, r.end) if strand == "+" else (r.feature, n + 1 - r.end, n + 1 - r.start) for r in models)
            results.add((strand, tuple(spans)))
    assert len({s for _, s in results}) == 1 and {f for f, *_ in next(iter(results))[1]} == {"5UTR", "CDS", "3UTR"}
    lines = annotation.render_models(annotate.annotate(df, use_bases=False))
    out = str(tmp_path / "m.gff3")
    features.write_lines(lines, out, ["chrom", "gene_no", "tx_no", "kind", "nth"])
    back = features.read_features(spark, out)
    assert sorted(r.feature for r in back.collect()) == ["CDS", "CDS", "exon", "exon", "gene", "mRNA"]
    assert spark.read.text(out).where("value LIKE '##gff%'").count() == 1
