"""Registered queries over the engine's own operators, with their SQL oracles.

The tables are not genomes. Adapters read them as such: a user's events are a state path,
line items are coding pieces, document texts are base strings. Each adapter has a Spark
and a SQL form of the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import attributes as at
from .functions import mixture
from .functions import numeric as nu
from .functions import sequence as sq
from .operators import annotation, convert, decode, evaluate, intervals, planning, repair, stitch, topology, transcripts, windows
from .operators.components import cut
from .plans import annotate, predict
from .sources import features as ft
from .sources import vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, and its DuckDB oracle if SQL can state it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- adapters


def paths(spark, d) -> DataFrame:
    """user_id, pos, label, state, p: a user's events in time order."""
    e = _t(spark, d, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    state = (F.col("event_id") * 7 % 20).cast("int")
    return e.select("user_id", pos.alias("pos"), F.col("event_type").alias("label"), state.alias("state"), F.pmod(F.round(F.col("value") * 100).cast("long"), F.lit(101)).alias("pct"))


PATHS = """paths AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type AS label,
         CAST(event_id * 7 % 20 AS INT) AS state, (CAST(round(value * 100) AS BIGINT) % 101 + 101) % 101 AS pct FROM events)"""


def cds(spark, d) -> DataFrame:
    """chrom, strand, gene, tx, start, end: line items as coding pieces that don't overlap."""
    tx = F.col("l_partkey")
    start = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100
    return _t(spark, d, "lineitem").select(
        F.concat(F.lit("chr"), (tx % 5).cast("string")).alias("chrom"), F.when(tx % 2 == 0, "+").otherwise("-").alias("strand"),
        F.floor(tx / 3).cast("long").alias("gene"), tx.alias("tx"), start.cast("long").alias("start"),
        (start + F.col("l_quantity").cast("long") - 1).cast("long").alias("end"),
    )


CDS = """cds AS (
  SELECT 'chr' || CAST(l_partkey % 5 AS VARCHAR) AS chrom, CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
         l_partkey // 3 AS gene, l_partkey AS tx, l_orderkey * 1000 + l_linenumber * 100 AS "start",
         l_orderkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT) - 1 AS "end" FROM lineitem)"""


def loose(spark, d) -> DataFrame:
    """seq, strand, id, start, end: intervals that overlap and touch."""
    start = F.col("l_orderkey") * 3 % 100_000
    return _t(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("seq"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"), start.cast("long").alias("start"),
        (start + F.col("l_quantity").cast("long")).cast("long").alias("end"),
    )


LOOSE = """loose AS (
  SELECT l_suppkey AS seq, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, l_orderkey * 10 + l_linenumber AS id,
         l_orderkey * 3 % 100000 AS "start", l_orderkey * 3 % 100000 + CAST(l_quantity AS BIGINT) AS "end" FROM lineitem)"""


def seqs(spark, d) -> DataFrame:
    """seq_name, seq: the letters ACGTN of each text."""
    doc = _t(spark, d, "documents")
    return doc.select(F.col("doc_id").alias("seq_name"), F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGTN]+", "").alias("seq"))


SEQS = """seqs AS (SELECT doc_id AS seq_name, regexp_replace(upper(coalesce(text, '')), '[^ACGTN]', '', 'g') AS seq FROM documents)"""


def lengths(spark, d) -> DataFrame:
    p = _t(spark, d, "part")
    n = F.col("p_partkey") * 7919 % 2500 * F.col("p_size")
    return p.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("name"), n.cast("long").alias("length"))


LENGTHS = "lengths AS (SELECT p_partkey AS ord, 's' || CAST(p_partkey AS VARCHAR) AS name, CAST(p_partkey * 7919 % 2500 * p_size AS BIGINT) AS length FROM part)"


def segments(spark, d) -> DataFrame:
    """Ten sources of 9000 positions and 1000 of spacer on every third sequence."""
    s = _t(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("packed_name"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    return s.select(
        "packed_name", F.concat(F.lit("src"), F.col("packed_name").cast("string"), F.lit("_"), F.col("k").cast("string")).alias("original_name"),
        (F.col("k") * 10_000 + 1).cast("long").alias("packed_start"), (F.col("k") * 10_000 + 9000).cast("long").alias("packed_end"),
    )


SEGMENTS = """segments AS (
  SELECT s_suppkey AS packed_name, 'src' || CAST(s_suppkey AS VARCHAR) || '_' || CAST(k AS VARCHAR) AS original_name,
         CAST(k * 10000 + 1 AS BIGINT) AS packed_start, CAST(k * 10000 + 9000 AS BIGINT) AS packed_end
  FROM supplier, range(10) t(k) WHERE s_suppkey % 3 = 0)"""


def _l(*cols):
    return [F.col(c).cast("long").alias(c) for c in cols]


# ---------------------------------------------------------------- runs and intervals


@query("rle_runs", f"""
WITH {PATHS}, f AS (SELECT *, CASE WHEN lag(label) OVER w IS DISTINCT FROM label THEN 1 ELSE 0 END AS fresh FROM paths WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM f)
SELECT user_id, label, CAST(min(pos) AS BIGINT) AS run_start, CAST(max(pos) AS BIGINT) AS run_end FROM g GROUP BY user_id, run, label""")
def rle_runs(spark, d):
    out = intervals.runs(paths(spark, d), ["user_id"], "label", bin_size=64)
    return out.select("user_id", "label", F.col("start").alias("run_start"), F.col("end").alias("run_end"))


@query("repeat_runs", f"""
WITH {PATHS}, f AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS island FROM paths WHERE label = 'click'),
r AS (SELECT user_id, CAST(min(pos) AS BIGINT) AS s, CAST(max(pos) AS BIGINT) AS e FROM f GROUP BY user_id, island)
SELECT user_id, s, e, 'r' || CAST(row_number() OVER (ORDER BY user_id, s, e) AS VARCHAR) AS repeat_id FROM r""")
def repeat_runs(spark, d):
    found = intervals.runs(paths(spark, d), ["user_id"], "label").where("label = 'click'")
    rows = ft.repeat_rows(found.select(F.col("user_id").alias("seq"), "start", "end", F.lit("+").alias("strand")))
    return rows.select(F.col("seq").alias("user_id"), F.col("start").alias("s"), F.col("end").alias("e"), "repeat_id")


def _merge_sql(gap: int, keys: str = "seq, strand", source: str = "loose") -> str:
    return f"""m AS (SELECT {keys}, "start", "end", max("end") OVER (PARTITION BY {keys} ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM m),
merged AS (SELECT {keys}, min("start") AS s, max("end") AS e, count(*) AS n FROM i GROUP BY {keys}, island)"""


@query("interval_merge", f"WITH {LOOSE}, {_merge_sql(1)} SELECT seq, strand, s, e, n FROM merged")
def interval_merge(spark, d):
    return intervals.merge_touching(loose(spark, d), ["seq", "strand"], bin_size=10_000).select("seq", "strand", F.col("start").alias("s"), F.col("end").alias("e"), "n")


@query("interval_merge_adjacent", f"""
WITH {LOOSE}, u AS (SELECT DISTINCT seq, "start", "start" + 2 AS "end" FROM loose),
f AS (SELECT *, CASE WHEN lag("end") OVER w + 1 = "start" THEN 0 ELSE 1 END AS fresh FROM u WINDOW w AS (PARTITION BY seq ORDER BY "start", "end")),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY seq ORDER BY "start", "end") AS island FROM f)
SELECT seq, min("start") AS s, max("end") AS e, count(*) AS n FROM g GROUP BY seq, island""")
def interval_merge_adjacent(spark, d):
    rows = loose(spark, d).select("seq", "start", (F.col("start") + 2).alias("end"))
    return intervals.merge_adjacent(rows, ["seq"], distinct=True).select("seq", F.col("start").alias("s"), F.col("end").alias("e"), "n")


@query("interval_clip", f"""
WITH {LOOSE} SELECT id, greatest("start" - 20, 1) AS s, least("end", 60000) AS e FROM loose WHERE greatest("start" - 20, 1) <= least("end", 60000)""")
def interval_clip(spark, d):
    rows = loose(spark, d).withColumn("start", F.col("start") - 20).withColumn("limit", F.lit(60_000).cast("long"))
    return intervals.clip(rows, "limit").select("id", F.col("start").alias("s"), F.col("end").alias("e"))


@query("interval_expand_merge", f"""
WITH {LOOSE}, big AS (SELECT seq, greatest(0, "start" - 10) AS "start", least(100000, "end" + 10) AS "end" FROM loose),
{_merge_sql(0, "seq", "big")} SELECT seq, s, e FROM merged""")
def interval_expand_merge(spark, d):
    rows = loose(spark, d).withColumn("limit", F.lit(100_000).cast("long"))
    return intervals.expand_merge(rows, ["seq"], "limit", 10).select("seq", *[F.col(a).cast("long").alias(b) for a, b in (("start", "s"), ("end", "e"))])


@query("exon_union", f"""WITH {CDS}, {_merge_sql(1, "tx", "cds")} SELECT tx, s, e FROM merged""")
def exon_union(spark, d):
    rows = cds(spark, d).withColumn("feature", F.lit("CDS"))
    return annotation.infer_exons(rows, ["tx"]).select("tx", F.col("start").alias("s"), F.col("end").alias("e"))


@query("intron_gaps", f"""
WITH {CDS}, g AS (SELECT tx, "end" + 1 AS s, lead("start") OVER (PARTITION BY tx ORDER BY "start", "end") - 1 AS e FROM cds)
SELECT tx, s, e FROM g WHERE s <= e""")
def intron_gaps(spark, d):
    return intervals.introns(cds(spark, d), ["tx"]).select("tx", F.col("start").alias("s"), F.col("end").alias("e"))


_DIRECTED = """CASE WHEN strand = '-' THEN -"start" ELSE "start" END, CASE WHEN strand = '-' THEN -"end" ELSE "end" END"""


@query("cds_phase", f"""
WITH {CDS}, b AS (SELECT tx, "start" AS s, "end" AS e, coalesce(sum("end" - "start" + 1) OVER (PARTITION BY tx ORDER BY {_DIRECTED} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cds)
SELECT tx, s, e, CAST((3 - before % 3) % 3 AS BIGINT) AS phase FROM b""")
def cds_phase(spark, d):
    return intervals.cds_phase(cds(spark, d), ["tx"]).select("tx", F.col("start").alias("s"), F.col("end").alias("e"), "phase")


@query("cds_position_class", f"""
WITH {CDS}, r AS (SELECT tx, "start" AS s, row_number() OVER (PARTITION BY tx ORDER BY {_DIRECTED}) AS k, count(*) OVER (PARTITION BY tx) AS n FROM cds)
SELECT tx, s, CASE WHEN n = 1 THEN 'single' WHEN k = 1 THEN 'initial' WHEN k = n THEN 'terminal' ELSE 'internal' END AS cds_type FROM r""")
def cds_position_class(spark, d):
    return intervals.cds_position(cds(spark, d), ["tx"]).select("tx", F.col("start").alias("s"), "cds_type")


@query("codon_terminals", f"""
WITH {CDS}, b AS (SELECT tx, strand, "start" AS s, "end" AS e, "end" - "start" + 1 AS len,
    coalesce(sum("end" - "start" + 1) OVER (PARTITION BY tx ORDER BY {_DIRECTED} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
    sum("end" - "start" + 1) OVER (PARTITION BY tx) AS total FROM cds),
c AS (SELECT *, 'start_codon' AS feature, 0 AS a, 3 AS z FROM b WHERE total >= 3 UNION ALL
      SELECT *, 'stop_codon', total - 3, total FROM b WHERE total >= 3 AND total % 3 = 0),
x AS (SELECT *, greatest(a, off) AS l, least(z, off + len) AS r FROM c)
SELECT tx, feature, CAST(CASE WHEN strand = '-' THEN e - (r - off) + 1 ELSE s + l - off END AS BIGINT) AS s,
       CAST(CASE WHEN strand = '-' THEN e - (l - off) ELSE s + r - off - 1 END AS BIGINT) AS e, CAST((3 - (l - a) % 3) % 3 AS BIGINT) AS phase
FROM x WHERE l < r""")
def codon_terminals(spark, d):
    rows = intervals.terminal_codon_rows(intervals.cds_phase(cds(spark, d), ["tx"]), ["tx"])
    return rows.select("tx", "feature", *[F.col(a).cast("long").alias(b) for a, b in (("start", "s"), ("end", "e"))], "phase")


@query("stop_merge", f"""
WITH {LOOSE}, p AS (SELECT seq, strand, "start", "end", id % 3 AS phase, id % 4 <> 0 AS is_cds FROM loose),
m AS (SELECT *, max("end") OVER (PARTITION BY seq, strand ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY seq, strand ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT seq, strand, min("start") AS s, max("end") AS e, count(*) FILTER (is_cds) > 0 AS coding FROM i GROUP BY seq, strand, island""")  # the phase is checked by hand in tests/core
def stop_merge(spark, d):
    rows = loose(spark, d).withColumn("phase", F.col("id") % 3).withColumn("is_cds", F.col("id") % 4 != 0)
    return intervals.merge_stop_codons(rows, ["seq"]).select("seq", "strand", F.col("start").alias("s"), F.col("end").alias("e"), F.col("phase").isNotNull().alias("coding"))


# ---------------------------------------------------------------- gene models


def features_of(spark, d):
    return cds(spark, d).withColumn("feature", F.lit("CDS"))


@query("tx_span", f"""WITH {CDS} SELECT tx, min(chrom) AS chrom, min(strand) AS strand, min("start") AS s, max("end") AS e, CAST(sum("end" - "start" + 1) AS BIGINT) AS cds_len, CAST(0 AS BIGINT) AS n_exons FROM cds GROUP BY tx""")
def tx_span(spark, d):
    return annotation.transcript_spans(features_of(spark, d)).select("tx", "chrom", "strand", F.col("start").alias("s"), F.col("end").alias("e"), "cds_len", "n_exons")


_GENES = """g AS (SELECT gene, chrom, strand, min("start") AS s, max("end") AS e, count(DISTINCT tx) AS n_tx,
  row_number() OVER (PARTITION BY gene ORDER BY chrom, strand) AS k FROM cds GROUP BY gene, chrom, strand)"""


@query("gene_span", f"""WITH {CDS}, {_GENES} SELECT CAST(gene AS VARCHAR) || CASE WHEN k = 1 THEN '' ELSE '_' || CAST(k AS VARCHAR) END AS gene_key, chrom, strand, s, e, n_tx, 'protein_coding' AS biotype FROM g""")
def gene_span(spark, d):
    return annotation.gene_spans(annotation.transcript_spans(features_of(spark, d))).select("gene_key", "chrom", "strand", F.col("start").alias("s"), F.col("end").alias("e"), "n_tx", "biotype")


@query("gene_biotype", f"""WITH {PATHS} SELECT user_id, CASE WHEN bool_or(state BETWEEN 4 AND 14) THEN 'protein_coding' ELSE 'unclassified' END AS biotype FROM paths GROUP BY user_id""")
def gene_biotype(spark, d):
    coding = F.bool_or(topology.feature_of(F.col("state")) == "CDS")
    return paths(spark, d).groupBy("user_id").agg(F.when(coding, "protein_coding").otherwise("unclassified").alias("biotype"))


@query("gene_number", f"""WITH {CDS}, {_GENES} SELECT gene, chrom, strand, 'OG_' || lpad(CAST(row_number() OVER (ORDER BY chrom, s, e, strand, gene) AS VARCHAR), 8, '0') AS gene_id FROM g""")
def gene_number(spark, d):
    genes = annotation.gene_spans(annotation.transcript_spans(features_of(spark, d)))
    rows = annotation.global_numbers(genes, ["chrom", "start", "end", "strand", "gene"], "n")
    return rows.select("gene", "chrom", "strand", F.concat(F.lit("OG_"), F.lpad(F.col("n").cast("string"), 8, "0")).alias("gene_id"))


@query("tx_number", f"""WITH {CDS}, t AS (SELECT gene, tx, min("start") AS s, max("end") AS e FROM cds GROUP BY gene, tx)
SELECT gene, tx, row_number() OVER (PARTITION BY gene ORDER BY s, e, tx) AS tx_no FROM t""")
def tx_number(spark, d):
    return annotation.numbered(annotation.transcript_spans(features_of(spark, d)), ["gene"], ["start", "end", "tx"], "tx_no").select("gene", "tx", "tx_no")


@query("segment_number", f"""WITH {CDS} SELECT tx, "start" AS s, row_number() OVER (PARTITION BY tx ORDER BY "start", "end") AS nth FROM cds""")
def segment_number(spark, d):
    return annotation.numbered(cds(spark, d), ["tx"], ["start", "end"], "nth").select("tx", F.col("start").alias("s"), "nth")


@query("child_ids", f"""WITH {CDS} SELECT tx, "start" AS s, 'tx' || CAST(tx AS VARCHAR) || '.cds' || CAST(row_number() OVER (PARTITION BY tx ORDER BY "start", "end") AS VARCHAR) AS id FROM cds""")
def child_ids(spark, d):
    rows = annotation.numbered(cds(spark, d), ["tx"], ["start", "end"], "nth")
    return rows.select("tx", F.col("start").alias("s"), F.concat(F.lit("tx"), F.col("tx").cast("string"), F.lit(".cds"), F.col("nth").cast("string")).alias("id"))


def _render_sql() -> str:
    cells = lambda f, s, e, ph, a: f"chrom || chr(9) || 'strandflow' || chr(9) || {f} || chr(9) || CAST({s} AS VARCHAR) || chr(9) || CAST({e} AS VARCHAR) || chr(9) || '.' || chr(9) || strand || chr(9) || {ph} || chr(9) || {a} AS line"
    return f"""
WITH {CDS}, {_merge_sql(1, "tx", "cds")}, {_GENES},
gn AS (SELECT gene, chrom, strand, s, e, row_number() OVER (ORDER BY chrom, s, e, strand, gene) AS gene_no FROM g),
t AS (SELECT gene, chrom, strand, tx, min("start") AS s, max("end") AS e FROM cds GROUP BY ALL),
tn AS (SELECT t.*, gene_no, 'OG_' || lpad(CAST(gene_no AS VARCHAR), 8, '0') AS gid, row_number() OVER (PARTITION BY gene_no ORDER BY t.s, t.e, tx) AS tx_no FROM t JOIN gn USING (gene, chrom, strand)),
tm AS (SELECT *, gid || '-mRNA-' || CAST(tx_no AS VARCHAR) AS tid FROM tn),
ex AS (SELECT tx, s, e, row_number() OVER (PARTITION BY tx ORDER BY s, e) AS k, count(*) OVER (PARTITION BY tx) AS n FROM merged),
ph AS (SELECT tx, "start" AS s, "end" AS e, row_number() OVER (PARTITION BY tx ORDER BY "start", "end") AS k,
  coalesce(sum("end" - "start" + 1) OVER (PARTITION BY tx ORDER BY {_DIRECTED} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cds)
SELECT gene_no, CAST(0 AS BIGINT) AS tx_no, 0 AS kind, CAST(0 AS BIGINT) AS nth, {cells("'gene'", "s", "e", "'.'", "'ID=OG_' || lpad(CAST(gene_no AS VARCHAR), 8, '0') || ';gene_biotype=protein_coding'")} FROM gn
UNION ALL SELECT gene_no, tx_no, 1, 0, {cells("'mRNA'", "tm.s", "tm.e", "'.'", "'ID=' || tid || ';Parent=' || gid || ';Num_exons=' || CAST(n AS VARCHAR) || ';geneID=' || gid || ';gene_biotype=protein_coding'")} FROM tm JOIN ex ON tm.tx = ex.tx AND ex.k = 1
UNION ALL SELECT gene_no, tx_no, 2, ex.k, {cells("'exon'", "ex.s", "ex.e", "'.'", "'ID=' || tid || '.exon' || CAST(ex.k AS VARCHAR) || ';Parent=' || tid")} FROM tm JOIN ex ON tm.tx = ex.tx
UNION ALL SELECT gene_no, tx_no, 3, ph.k, {cells("'CDS'", "ph.s", "ph.e", "CAST((3 - before % 3) % 3 AS VARCHAR)", "'ID=' || tid || '.cds' || CAST(ph.k AS VARCHAR) || ';Parent=' || tid")} FROM tm JOIN ph ON tm.tx = ph.tx"""


@query("gff3_models", _render_sql())
def gff3_models(spark, d):
    rows = annotation.render_models(features_of(spark, d))
    return rows.select(*_l("gene_no", "tx_no"), F.col("kind").cast("int").alias("kind"), *_l("nth"), "line")


# ---------------------------------------------------------------- lift-over and recheck


def _packed(spark, d):
    rows = loose(spark, d)
    return rows.withColumn("grp", F.floor(F.col("id") / 10).cast("long"))


_LIFT = f"""{LOOSE}, {SEGMENTS}, lifted AS (
  SELECT l.*, id // 10 AS grp, CASE WHEN seq % 3 <> 0 THEN CAST(seq AS VARCHAR) ELSE original_name END AS source,
         CASE WHEN seq % 3 <> 0 THEN "start" ELSE "start" - packed_start + 1 END AS s, CASE WHEN seq % 3 <> 0 THEN "end" ELSE "end" - packed_start + 1 END AS e,
         seq % 3 <> 0 OR original_name IS NOT NULL AS mapped
  FROM loose l LEFT JOIN segments ON seq = packed_name AND "start" >= packed_start AND "end" <= packed_end),
groups AS (SELECT grp, bool_and(mapped) AND min(source) = max(source) AS ok, min(source) AS source FROM lifted GROUP BY grp),
touched AS (SELECT DISTINCT id, original_name AS source FROM loose JOIN segments ON seq = packed_name AND packed_end >= "start" AND packed_start <= "end")"""


def _text_keys(rows, segs):
    return rows.withColumn("seq", F.col("seq").cast("string")), segs.withColumn("packed_name", F.col("packed_name").cast("string"))


@query("lift_over", f"WITH {_LIFT} SELECT id, source, s, e, mapped FROM lifted")
def lift_over(spark, d):
    rows, segs = _text_keys(_packed(spark, d), segments(spark, d))
    return annotation.lift_over(rows, segs).select("id", "source", F.col("source_start").alias("s"), F.col("source_end").alias("e"), "mapped")


@query("lift_over_groups", f"WITH {_LIFT} SELECT grp, coalesce(ok, false) AS mapped, CASE WHEN ok THEN source END AS source FROM groups")
def lift_over_groups(spark, d):
    return annotation.lift_groups(*_text_keys(_packed(spark, d), segments(spark, d)), "grp")


@query("touched_sources", f"WITH {_LIFT} SELECT id, source FROM touched")
def touched_sources(spark, d):
    return annotation.touched_sources(*_text_keys(_packed(spark, d), segments(spark, d)))


@query("recheck_sources", f"WITH {_LIFT} SELECT DISTINCT t.source FROM touched t JOIN loose l USING (id) JOIN groups g ON g.grp = l.id // 10 WHERE NOT coalesce(ok, false)")
def recheck_sources(spark, d):
    return annotation.recheck_sources(*_text_keys(_packed(spark, d), segments(spark, d)), "grp")


@query("anti_recheck", f"""WITH {LOOSE}, again AS (SELECT DISTINCT seq FROM loose WHERE id % 97 = 0)
SELECT 'part0.' || CAST(id AS VARCHAR) AS gene, seq FROM loose WHERE seq NOT IN (SELECT seq FROM again) UNION ALL
SELECT 'recheck0.' || CAST(id AS VARCHAR), seq FROM loose WHERE seq IN (SELECT seq FROM again) AND id % 2 = 0""")
def anti_recheck(spark, d):
    rows = loose(spark, d)
    again = rows.where("id % 97 = 0").select("seq").distinct()
    named = lambda df, p: df.select(F.concat(F.lit(p), F.col("id").cast("string")).alias("gene"), "seq")
    return annotation.replace_sources(named(rows, "part0."), named(rows.where("id % 2 = 0"), "recheck0."), again, "seq")


@query("union_prefix", f"""WITH {CDS} SELECT 'part' || CAST(gene % 4 AS VARCHAR) || '.g' || CAST(gene AS VARCHAR) AS gene_id, count(*) AS n FROM cds GROUP BY 1""")
def union_prefix(spark, d):
    parts = [cds(spark, d).where(F.col("gene") % 4 == k).select(F.concat(F.lit(f"part{k}.g"), F.col("gene").cast("string")).alias("gene_id")) for k in range(4)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).groupBy("gene_id").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- sequences and windows


@query("seq_windows", f"""WITH {SEQS}, w AS (SELECT *, unnest(range(greatest(1, CAST(ceil(length(seq) / 500.0) AS BIGINT)))) AS i FROM seqs)
SELECT seq_name, CAST(i AS INT) AS win_idx, i * 500 + 1 AS core_start, least(length(seq), (i + 1) * 500) AS core_end, rpad(substring(seq, i * 500 + 1, 500), 500, 'N') AS bases FROM w""")
def seq_windows(spark, d):
    return windows.sequence_windows(seqs(spark, d), 500).drop("strand")


@query("seq_windows_flank", f"""WITH {SEQS}, w AS (SELECT *, unnest(range(greatest(1, CAST(ceil(length(seq) / 400.0) AS BIGINT)))) AS i FROM seqs),
b AS (SELECT seq_name, i, rpad(CASE WHEN i = 0 THEN repeat('N', 50) ELSE '' END || substring(seq, greatest(i * 400 - 49, 1), CASE WHEN i = 0 THEN 450 ELSE 500 END), 500, 'N') AS bases FROM w)
SELECT seq_name, CAST(i AS INT) AS win_idx, '+' AS strand, bases FROM b UNION ALL SELECT seq_name, CAST(i AS INT), '-', reverse(translate(bases, 'ACGTacgt', 'TGCAtgca')) FROM b""")
def seq_windows_flank(spark, d):
    return windows.both_strands(windows.sequence_windows(seqs(spark, d), 400, 50)).select("seq_name", "win_idx", "strand", "bases")


@query("rev_comp", f"WITH {SEQS} SELECT seq_name, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) AS rc FROM seqs")
def rev_comp(spark, d):
    return seqs(spark, d).select("seq_name", sq.reverse_complement(F.col("seq")).alias("rc"))


@query("base_encode", f"WITH {SEQS} SELECT seq_name, regexp_replace(translate(seq, 'ACGT', '0123'), '[^0-3]', '4', 'g') AS code FROM seqs")
def base_encode(spark, d):
    return seqs(spark, d).select("seq_name", sq.category(F.col("seq")).alias("code"))


@query("soft_mask", "SELECT doc_id AS seq_name, regexp_replace(regexp_replace(coalesce(text, ''), '[acgt]', '1', 'g'), '[^1]', '0', 'g') AS mask FROM documents")
def soft_mask(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("seq_name"), sq.soft_masked(F.coalesce("text", F.lit(""))).alias("mask"))


@query("base_composition", f"WITH {SEQS} SELECT seq_name, " + ", ".join(f"length(seq) - length(replace(seq, '{b}', '')) AS n_{b.lower()}" for b in "ACGTN") + " FROM seqs")
def base_composition(spark, d):
    count = lambda b: (F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))).cast("long").alias(f"n_{b.lower()}")
    return seqs(spark, d).select("seq_name", *[count(b) for b in "ACGTN"])


@query("kmer_counts", f"WITH {SEQS}, k AS (SELECT unnest(list_transform(range(1, length(seq) - 1), lambda i: substring(seq, i, 3))) AS kmer FROM seqs) SELECT kmer, count(*) AS n FROM k GROUP BY kmer")
def kmer_counts(spark, d):
    return seqs(spark, d).select(F.explode(sq.kmers(F.col("seq"), 3)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


_CODE_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sq.amino_letters().items()) + "}"


@query("codon_translate", f"""WITH {SEQS} SELECT seq_name, array_to_string(list_transform(range(length(seq) // 3), lambda i: coalesce({_CODE_SQL}[substring(seq, i * 3 + 1, 3)], 'X')), '') AS protein FROM seqs""")
def codon_translate(spark, d):
    return seqs(spark, d).select("seq_name", sq.translate(F.col("seq")).alias("protein"))


def _orfs(spark, d):
    """The whole texts' bases, cut after each TGA whatever the frame: seq_name, nth, cds. Some
    pieces are whole codons, some are not, and some hold a TAA or TAG before their end."""
    cut = F.filter(F.split(F.regexp_replace("seq", "TGA", "TGA|"), r"\|"), lambda x: x != "")
    return seqs(spark, d).select("seq_name", F.posexplode(cut).alias("nth", "cds")).withColumn("nth", F.col("nth").cast("long"))


_ORFS = f"""{SEQS}, cuts AS (SELECT seq_name, list_filter(string_split(replace(seq, 'TGA', 'TGA|'), '|'), lambda x: x <> '') AS parts FROM seqs),
orfs AS (SELECT seq_name, unnest(parts) AS cds, generate_subscripts(parts, 1) - 1 AS nth FROM cuts)"""


@query("strict_filter", f"""WITH {_ORFS}, c AS (SELECT *, list_transform(range(length(cds) // 3), lambda i: substring(cds, i * 3 + 1, 3)) AS parts FROM orfs)
SELECT seq_name, nth FROM c WHERE length(cds) >= 61 AND length(cds) % 3 = 0 AND parts[-1] IN ('TAA', 'TAG', 'TGA') AND len(list_filter(parts[:-2], lambda x: x IN ('TAA', 'TAG', 'TGA'))) = 0""")
def strict_filter(spark, d):
    return _orfs(spark, d).where(sq.is_complete_coding(F.col("cds"))).select("seq_name", "nth")


def pieces(spark, d) -> DataFrame:
    """Two pieces of each of _orfs on its text's bases. Every third transcript is a minus one, every
    fifth reaches three bases beyond its end, some lie on sequences that don't exist."""
    size = F.length("cds").cast("long")
    orfs = _orfs(spark, d).withColumn("stop", F.sum(size).over(Window.partitionBy("seq_name").orderBy("nth")))
    orfs = orfs.withColumn("first", F.col("stop") - size + 1).withColumn("mid", F.least(F.col("stop"), F.col("first") + 19))
    seq_name = F.when(F.col("seq_name") % 17 == 3, F.col("seq_name") + 1_000_000_000).otherwise(F.col("seq_name"))
    tx = F.concat(F.col("seq_name").cast("string"), F.lit("."), F.col("nth").cast("string"))
    late = F.col("stop") + F.when(F.col("nth") % 5 == 4, 3).otherwise(0)
    both = F.array(F.struct(F.col("first").alias("start"), F.col("mid").alias("end")), F.struct((F.col("mid") + 1).alias("start"), late.alias("end")))
    out = orfs.select(seq_name.alias("seq_name"), tx.alias("tx"), F.when(F.col("nth") % 3 == 2, "-").otherwise("+").alias("strand"), F.explode(both).alias("p"))
    return out.select("seq_name", "tx", "strand", "p.start", "p.end").where("end >= start")


_PIECES = f"""{_ORFS}, ends AS (SELECT *, CAST(sum(length(cds)) OVER (PARTITION BY seq_name ORDER BY nth) AS BIGINT) AS stop FROM orfs),
mids AS (SELECT *, stop - length(cds) + 1 AS first, least(stop, stop - length(cds) + 20) AS mid FROM ends),
named AS (SELECT CASE WHEN seq_name % 17 = 3 THEN seq_name + 1000000000 ELSE seq_name END AS seq_name, CAST(seq_name AS VARCHAR) || '.' || CAST(nth AS VARCHAR) AS tx,
  CASE WHEN nth % 3 = 2 THEN '-' ELSE '+' END AS strand, first, mid, stop + CASE WHEN nth % 5 = 4 THEN 3 ELSE 0 END AS late FROM mids),
pieces AS (SELECT * FROM (SELECT seq_name, tx, strand, first AS "start", mid AS "end" FROM named UNION ALL SELECT seq_name, tx, strand, mid + 1, late FROM named) WHERE "end" >= "start"),
spliced AS (SELECT p.seq_name, tx, strand, count(*) AS n_pieces, CAST(sum("end" - "start" + 1) AS BIGINT) AS n_bases,
  coalesce(string_agg(substring(seq, "start", "end" - "start" + 1), '' ORDER BY "start"), '') AS bases FROM pieces p LEFT JOIN seqs s ON p.seq_name = s.seq_name GROUP BY 1, 2, 3),
oriented AS (SELECT seq_name, tx, strand, n_pieces, n_bases, CASE WHEN strand = '-' THEN reverse(translate(bases, 'ACGT', 'TGCA')) ELSE bases END AS cds, length(bases) = n_bases AS complete FROM spliced)"""


@query("spliced_cds", f"WITH {_PIECES} SELECT * FROM oriented")
def spliced_cds(spark, d):
    return transcripts.spliced_cds(pieces(spark, d), seqs(spark, d))


@query("strict_transcripts", f"""WITH {_PIECES}, c AS (SELECT *, list_transform(range(length(cds) // 3), lambda i: substring(cds, i * 3 + 1, 3)) AS parts FROM oriented WHERE complete)
SELECT seq_name, tx, strand FROM c WHERE length(cds) >= 61 AND length(cds) % 3 = 0 AND parts[-1] IN ('TAA', 'TAG', 'TGA') AND len(list_filter(parts[:-2], lambda x: x IN ('TAA', 'TAG', 'TGA'))) = 0""")
def strict_transcripts(spark, d):
    return transcripts.strict_transcripts(pieces(spark, d), seqs(spark, d))


@query("least_coding", f"""WITH {_PIECES} SELECT seq_name, tx, strand FROM oriented WHERE n_bases >= 201""")
def least_coding(spark, d):
    return transcripts.least_coding(pieces(spark, d))


_FEATURES = """features AS (
  SELECT 'chr' || CAST(l_orderkey % 5 AS VARCHAR) AS seq_name, l_orderkey AS tx, CASE l_linenumber % 3 WHEN 0 THEN 'CDS' WHEN 1 THEN 'five_prime_UTR' ELSE 'exon' END AS type,
         l_orderkey * 1000 + l_linenumber * 100 AS "start", l_orderkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT) - 1 AS "end" FROM lineitem),
lengths AS (SELECT seq_name, max("end") // 2 AS length FROM features WHERE seq_name <> 'chr4' GROUP BY seq_name)"""


@query("clip_features", f"""WITH {_FEATURES}, cut AS (SELECT f.seq_name, tx, type, greatest("start", 1) AS "start", least("end", coalesce(length, "end")) AS "end" FROM features f LEFT JOIN lengths l ON f.seq_name = l.seq_name)
SELECT * FROM cut WHERE "start" <= "end" AND tx IN (SELECT tx FROM cut WHERE "start" <= "end" AND type IN ('CDS', 'exon'))""")
def clip_features(spark, d):
    start, kind = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100, F.col("l_linenumber") % 3
    features = _t(spark, d, "lineitem").select(
        F.concat(F.lit("chr"), (F.col("l_orderkey") % 5).cast("string")).alias("seq_name"), F.col("l_orderkey").alias("tx"), F.when(kind == 0, "CDS").when(kind == 1, "five_prime_UTR").otherwise("exon").alias("type"),
        start.cast("long").alias("start"), (start + F.col("l_quantity").cast("long") - 1).cast("long").alias("end"),
    )
    lengths = features.where("seq_name <> 'chr4'").groupBy("seq_name").agg(F.floor(F.max("end") / 2).alias("length"))
    return transcripts.clip_features(features, lengths)


@query("terminal_codons", f"WITH {SEQS} SELECT seq_name, CASE WHEN length(seq) < 3 THEN '.' ELSE seq[:3] END AS first_codon, CASE WHEN length(seq) < 3 THEN '.' ELSE seq[-3:] END AS last_codon FROM seqs")
def terminal_codons(spark, d):
    ends = sq.terminal_codons(F.col("seq"))
    return seqs(spark, d).select("seq_name", ends["start"].alias("first_codon"), ends["stop"].alias("last_codon"))


@query("window_crop", f"WITH {SEQS} SELECT seq_name, CASE WHEN seq_name % 2 = 0 THEN seq[:20] ELSE right(seq, 20) END AS bases FROM seqs")
def window_crop(spark, d):
    strand = F.when(F.col("seq_name") % 2 == 0, "+").otherwise("-")
    return seqs(spark, d).select("seq_name", sq.crop(F.col("seq"), F.lit(20), strand).alias("bases"))


# ---------------------------------------------------------------- attributes


def attrs(spark, d):
    o = _t(spark, d, "orders")
    key, status = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    text = F.concat(F.lit('gene_id "g'), key, F.lit('"; transcript_id "t'), key, F.lit('"; tag "'), status, F.lit('"; tag "x'), status, F.lit('"; flag; ID=a b; note '), F.col("o_orderpriority"), F.lit(";"))
    return o.select("o_orderkey", text.alias("text"), "o_orderpriority")


_ATTRS = """attrs AS (SELECT o_orderkey, o_orderpriority, 'gene_id "g' || CAST(o_orderkey AS VARCHAR) || '"; transcript_id "t' || CAST(o_orderkey AS VARCHAR) || '"; tag "' || o_orderstatus || '"; tag "x' || o_orderstatus || '"; flag; ID=a b; note ' || o_orderpriority || ';' AS text FROM orders)"""


@query("attr_tokens", f"""WITH {_ATTRS}, p AS (SELECT o_orderkey, unnest(list_filter(list_transform(string_split(text, ';'), lambda x: trim(x)), lambda x: x <> '')) AS x, generate_subscripts(list_filter(list_transform(string_split(text, ';'), lambda x: trim(x)), lambda x: x <> ''), 1) AS nth FROM attrs)
SELECT o_orderkey, nth - 1 AS nth, CASE WHEN x LIKE 'ID=%' THEN 'ID' ELSE split_part(x, ' ', 1) END AS key,
  CASE WHEN x LIKE 'ID=%' THEN 'a b' WHEN instr(x, ' ') > 0 THEN trim(substring(x, instr(x, ' ') + 1), '"') ELSE '' END AS value,
  CASE WHEN x LIKE 'ID=%' THEN '=' WHEN instr(x, ' ') > 0 THEN ' ' ELSE '' END AS separator, x LIKE '%"' AS quoted FROM p""")
def attr_tokens(spark, d):
    rows = attrs(spark, d).select("o_orderkey", F.posexplode(at.tokens(F.col("text"))).alias("nth", "t"))
    return rows.select("o_orderkey", F.col("nth").cast("long").alias("nth"), "t.key", "t.value", "t.separator", "t.quoted")


@query("attr_last", "SELECT o_orderkey, 'x' || o_orderstatus AS tag FROM orders")
def attr_last(spark, d):
    return attrs(spark, d).select("o_orderkey", at.last_of(at.tokens(F.col("text")), "tag").alias("tag"))


@query("attr_first", "SELECT o_orderkey, o_orderstatus AS tag FROM orders")
def attr_first(spark, d):
    return attrs(spark, d).select("o_orderkey", at.first_of(at.tokens(F.col("text")), "tag").alias("tag"))


@query("attr_multi", "SELECT o_orderkey, o_orderstatus || ',x' || o_orderstatus AS tags FROM orders")
def attr_multi(spark, d):
    return attrs(spark, d).select("o_orderkey", F.array_join(at.values_of(at.tokens(F.col("text")), "tag"), ",").alias("tags"))


@query("attr_round_trip", f"WITH {_ATTRS} SELECT o_orderkey, text FROM attrs")
def attr_round_trip(spark, d):
    return attrs(spark, d).select("o_orderkey", at.render_tokens(at.tokens(F.col("text"))).alias("text"))


@query("gtf_render", """SELECT o_orderkey, 'gene_id "' || o_orderstatus || '"; transcript_id "t' || CAST(o_orderkey AS VARCHAR) || '"; rank "' || o_orderpriority || '";' AS text FROM orders""")
def gtf_render(spark, d):
    o = _t(spark, d, "orders")
    return o.select("o_orderkey", at.gtf_attributes(F.col("o_orderstatus"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")), rank=F.col("o_orderpriority")).alias("text"))


@query("gff3_render", """SELECT c_custkey, 'ID=' || replace(replace(replace(c_name, '%', '%25'), '#', '%23'), ' ', '%20') || ';Note=' || replace(c_mktsegment, ' ', '%20') || ',b%2Cc' AS text FROM customer""")
def gff3_render(spark, d):
    c = _t(spark, d, "customer")
    note = at.gff3_list("Note", F.array(F.col("c_mktsegment"), F.lit("b,c")))
    return c.select("c_custkey", F.concat_ws(";", at.gff3_attributes(ID=F.col("c_name")), note).alias("text"))


@query("json_audit", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, sha256(event_type) AS digest FROM events""")
def json_audit(spark, d):
    e = _t(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.sha2(F.col("event_type").cast("binary"), 256).alias("digest"))


# ---------------------------------------------------------------- states and stitching

_FEATURES_SQL = "[" + ", ".join(f"'{f}'" for f in topology.FEATURES) + "]"
_STEPS = "steps(a, b) AS (VALUES " + ", ".join(f"({a}, {b})" for a, bs in topology.NEXT.items() for b in bs) + ")"


@query("state_to_feature", f"WITH {PATHS} SELECT user_id, pos, ({_FEATURES_SQL})[state + 1] AS feature FROM paths")
def state_to_feature(spark, d):
    return paths(spark, d).select("user_id", "pos", topology.feature_of(F.col("state")).alias("feature"))


@query("step_legality", f"""WITH {PATHS}, {_STEPS}, l AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY pos) AS before, CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM paths)
SELECT user_id, pos, EXISTS (SELECT 1 FROM steps WHERE (strand = '+' AND a = before AND b = state) OR (strand = '-' AND a = state AND b = before)) AS legal FROM l WHERE before IS NOT NULL""")
def step_legality(spark, d):
    order = Window.partitionBy("user_id").orderBy("pos")
    rows = paths(spark, d).withColumn("before", F.lag("state").over(order)).where("before IS NOT NULL")
    strand = F.when(F.col("user_id") % 2 == 0, "+").otherwise("-")
    return rows.select("user_id", "pos", topology.legal_step(F.col("before"), F.col("state"), strand).alias("legal"))


def _windows(spark, d):
    """Eight events a window; after every fifth window positions go on two further, which leaves a gap."""
    rows = paths(spark, d).withColumn("w", F.floor((F.col("pos") - 1) / 8)).withColumn("pos", F.col("pos") + F.floor(F.col("w") / 5) * 2)
    return rows.groupBy(F.col("user_id").alias("seq"), F.lit("+").alias("strand"), "w").agg(
        F.min("pos").alias("start"), F.max("pos").alias("end"), F.min_by("state", "pos").alias("first_state"), F.max_by("state", "pos").alias("last_state")
    )


_WINDOWS = f"""{PATHS}, {_STEPS}, win AS (SELECT user_id AS seq, (pos - 1) // 8 AS w, CAST(min(pos) + (pos - 1) // 40 * 2 AS BIGINT) AS s, CAST(max(pos) + (pos - 1) // 40 * 2 AS BIGINT) AS e, arg_min(state, pos) AS first_state, arg_max(state, pos) AS last_state
  FROM paths GROUP BY user_id, (pos - 1) // 8, (pos - 1) // 40),
seam AS (SELECT *, lag(e) OVER o AS left_end, lag(last_state) OVER o AS left_state FROM win WINDOW o AS (PARTITION BY seq ORDER BY s)),
st AS (SELECT *, CASE WHEN left_end IS NULL THEN NULL WHEN left_end + 1 <> s THEN 'coordinate_gap'
  WHEN EXISTS (SELECT 1 FROM steps WHERE a = left_state AND b = first_state) THEN 'joined' ELSE 'invalid_transition' END AS status FROM seam)"""


@query("window_stitch_status", f"WITH {_WINDOWS} SELECT seq, s, status FROM st")
def window_stitch_status(spark, d):
    return stitch.seams(_windows(spark, d)).select("seq", F.col("start").alias("s"), "status")


@query("block_ids", f"WITH {_WINDOWS} SELECT seq, s, CAST(sum(CASE WHEN status <> 'joined' THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY s) AS BIGINT) AS block FROM st")
def block_ids(spark, d):
    return stitch.seams(_windows(spark, d)).select("seq", F.col("start").alias("s"), "block")


def _kinds(spark, d):
    kind = F.when(F.col("label") == "click", "intergenic").otherwise(F.col("label"))
    return intervals.runs(paths(spark, d).withColumn("kind", kind), ["user_id"], "kind")


_KINDS = f"""{PATHS}, k AS (SELECT user_id, pos, CASE WHEN label = 'click' THEN 'intergenic' ELSE label END AS kind FROM paths),
kf AS (SELECT *, CASE WHEN lag(kind) OVER w IS DISTINCT FROM kind THEN 1 ELSE 0 END AS fresh FROM k WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
kr AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM kf),
ranges AS (SELECT user_id, kind, min(pos) AS s, max(pos) AS e FROM kr GROUP BY user_id, run, kind)"""


@query("transcript_split", f"""WITH {_KINDS}, g AS (SELECT *, CAST(sum(CASE WHEN kind = 'intergenic' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s) AS BIGINT) AS grp FROM ranges),
l AS (SELECT *, max(grp) OVER (PARTITION BY user_id) AS last FROM g)
SELECT user_id, kind, s, e, grp, CASE WHEN grp = last THEN 'last' WHEN grp = 0 THEN 'first' END AS edge FROM l WHERE kind <> 'intergenic'""")
def transcript_split(spark, d):
    rows = stitch.split_transcripts(_kinds(spark, d), ["user_id"])
    return rows.select("user_id", "kind", F.col("start").alias("s"), F.col("end").alias("e"), F.col("group").alias("grp"), "edge")


@query("utr_resolve", f"""WITH {PATHS}, k AS (SELECT user_id, pos, CASE label WHEN 'click' THEN 'CDS' WHEN 'view' THEN '5UTR' WHEN 'purchase' THEN 'UTR_EI' ELSE 'intron' END AS kind FROM paths),
c AS (SELECT *, sum(CASE WHEN kind = 'CDS' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS comp FROM k),
m AS (SELECT user_id, pos, CASE WHEN kind = 'UTR_EI' AND bool_or(kind = '5UTR') OVER (PARTITION BY user_id, comp) THEN '5UTR' ELSE kind END AS kind FROM c),
f AS (SELECT *, CASE WHEN lag(kind) OVER w IS DISTINCT FROM kind THEN 1 ELSE 0 END AS fresh FROM m WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM f)
SELECT user_id, kind, CAST(min(pos) AS BIGINT) AS s, CAST(max(pos) AS BIGINT) AS e FROM r GROUP BY user_id, run, kind""")
def utr_resolve(spark, d):
    label = F.col("label")
    kind = F.when(label == "click", "CDS").when(label == "view", "5UTR").when(label == "purchase", "UTR_EI").otherwise("intron")
    ranges = intervals.runs(paths(spark, d).withColumn("kind", kind), ["user_id"], "kind")
    return stitch.resolve_utr(ranges, ["user_id"]).select("user_id", "kind", F.col("start").alias("s"), F.col("end").alias("e"))


# ---------------------------------------------------------------- signals and numbers


@query("moving_mean_prefilter", f"""WITH {PATHS}, m AS (SELECT user_id, pct, CASE WHEN count(*) OVER w = 20 THEN avg(pct) OVER w END AS mean FROM paths WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT user_id, round(coalesce(max(mean), avg(pct)), 6) AS best, coalesce(max(mean), avg(pct)) >= 60 AS keep FROM m GROUP BY user_id""")
def moving_mean_prefilter(spark, d):
    return windows.has_signal(paths(spark, d), ["user_id"], "pct", 20, 60).select("user_id", F.round("best", 6).alias("best"), "keep")


@query("genic_buckets", f"""WITH {PATHS}, b AS (SELECT user_id, (pos - 1) // 10 AS b, avg(pct) >= 50 AS live, count(*) FILTER (pct > 60) AS high, max(pos - 1) AS last FROM paths GROUP BY 1, 2),
r AS (SELECT *, coalesce(sum(CASE WHEN live THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM b),
g AS (SELECT user_id, min(b) * 10 AS s, max(last) + 1 AS e, sum(high) AS high, bool_or(live) AS live FROM r GROUP BY user_id, run)
SELECT user_id, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM g WHERE live AND high >= 5""")
def genic_buckets(spark, d):
    values = paths(spark, d).withColumn("pos", F.col("pos") - 1)
    return windows.genic_regions(values, ["user_id"], "pct", 10, 50, 60, 5).select("user_id", *[F.col(a).cast("long").alias(b) for a, b in (("start", "s"), ("end", "e"))])


@query("argmax_state", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS state FROM embeddings")
def argmax_state(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", nu.first_argmax(F.col("embedding")).alias("state"))


@query("prob_normalise", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - list_max(embedding))) AS v FROM embeddings)
SELECT vec_id, round(v[1] / list_sum(v), 6) AS first_p, round(v[-1] / list_sum(v), 6) AS last_p, round(list_max(v) / list_sum(v), 6) AS most FROM e""")
def prob_normalise(spark, d):
    row = F.transform("embedding", lambda x: x.cast("double"))
    p = nu.as_probabilities(F.array(row))[0]
    ends = {"first_p": F.element_at(p, 1), "last_p": F.element_at(p, -1), "most": F.array_max(p)}
    return _t(spark, d, "embeddings").select("vec_id", *[F.round(x, 6).alias(name) for name, x in ends.items()])


@query("safe_log", f"WITH {PATHS} SELECT user_id, pos, round(CASE WHEN pct = 0 THEN -1000 ELSE ln(pct / 100.0) END, 6) AS lp FROM paths")
def safe_log(spark, d):
    return paths(spark, d).select("user_id", "pos", F.round(nu.safe_log(F.col("pct") / 100.0), 6).alias("lp"))


_CORE = "CASE WHEN length >= 64000 THEN 64000 ELSE CAST(ceil(greatest(CASE WHEN length <= 400 THEN 401 ELSE length END, 4) / 1024.0) * 1024 AS BIGINT) END"


@query("adaptive_core", f"WITH {LENGTHS} SELECT name, {_CORE} AS core FROM lengths")
def adaptive_core(spark, d):
    return lengths(spark, d).select("name", nu.adaptive_core(F.col("length"), 64_000, 2, 200).alias("core"))


@query("window_cost", f"WITH {LENGTHS}, c AS (SELECT *, {_CORE} AS core FROM lengths) SELECT name, CAST(2 * greatest(1, ceil(length / CAST(core AS DOUBLE))) * (core + 400) AS BIGINT) AS cost FROM c")
def window_cost(spark, d):
    return lengths(spark, d).select("name", nu.window_cost(F.col("length"), nu.adaptive_core(F.col("length"), 64_000, 2, 200), 200, 2).alias("cost"))


@query("compact_length", f"WITH {LENGTHS} SELECT name, least(105600, CAST(ceil((length % 60000 + 800) / {math.lcm(4096, 48)}.0) * {math.lcm(4096, 48)} AS BIGINT)) AS model_len FROM lengths")
def compact_length(spark, d):
    return lengths(spark, d).select("name", nu.compact_length(F.col("length") % 60_000, 400, 48, 105_600).alias("model_len"))


@query("parallel_factor", f"""WITH {LENGTHS}, f AS (SELECT name, (length % 40 + 1) * 512 AS core, (length % 40 + 1) * 512 + 1024 AS model FROM lengths)
SELECT name, coalesce((SELECT max(k) FROM range(1, 101) t(k) WHERE model % k = 0 AND core % (k * 512) = 0), (SELECT max(k) FROM range(1, 101) t(k) WHERE model % k = 0)) AS factor FROM f""")
def parallel_factor(spark, d):
    core = (F.col("length") % 40 + 1) * 512
    return lengths(spark, d).select("name", nu.parallel_factor(core + 1024, core).alias("factor"))


# ---------------------------------------------------------------- plans over lengths


@query("group_plan", f"""WITH RECURSIVE {LENGTHS}, c AS (SELECT name, length, CASE WHEN length >= 64000 THEN 64000 ELSE CAST(ceil(greatest(length, 2) / 512.0) * 512 AS BIGINT) END AS core FROM lengths),
k AS (SELECT *, CAST(greatest(1, ceil(length / CAST(core AS DOUBLE))) * (core + 200) AS BIGINT) AS cost, row_number() OVER (PARTITION BY core ORDER BY length, name) AS n FROM c),
r AS (SELECT name, core, cost, n, cost AS total, CAST(0 AS BIGINT) AS grp FROM k WHERE n = 1 UNION ALL
  SELECT k.name, k.core, k.cost, k.n, CASE WHEN r.total + k.cost > 300000 THEN k.cost ELSE r.total + k.cost END, CASE WHEN r.total + k.cost > 300000 THEN r.grp + 1 ELSE r.grp END
  FROM r JOIN k ON k.core = r.core AND k.n = r.n + 1)
SELECT name, core, cost, grp FROM r""")
def group_plan(spark, d):
    return planning.group_plan(lengths(spark, d), 300_000, 64_000, 1, 100).select("name", "core", "cost", F.col("group").alias("grp"))


@query("greedy_pack", f"""WITH RECURSIVE {LENGTHS}, k AS (SELECT *, row_number() OVER (ORDER BY ord) AS n FROM lengths),
r AS (SELECT n, name, length, CASE WHEN length >= 50000 THEN 0 ELSE 1 END AS number, CASE WHEN length >= 50000 THEN -1 ELSE length END AS tail FROM k WHERE n = 1 UNION ALL
  SELECT k.n, k.name, k.length, CASE WHEN k.length >= 50000 OR (r.tail >= 0 AND r.tail + 100 + k.length <= 200000) THEN r.number ELSE r.number + 1 END,
    CASE WHEN k.length >= 50000 THEN -1 WHEN r.tail >= 0 AND r.tail + 100 + k.length <= 200000 THEN CASE WHEN r.tail > 0 THEN r.tail + 100 ELSE 0 END + k.length ELSE k.length END
  FROM r JOIN k ON k.n = r.n + 1)
SELECT name AS original_name, CASE WHEN tail < 0 THEN name ELSE 'packed_scaffold_' || lpad(CAST(number AS VARCHAR), 6, '0') END AS packed_name,
  CASE WHEN tail < 0 THEN 1 ELSE tail - length + 1 END AS packed_start, CASE WHEN tail < 0 THEN length ELSE tail END AS packed_end FROM r""")
def greedy_pack(spark, d):
    return planning.pack(lengths(spark, d), 50_000, 100, 200_000).drop("length")


@query("pack_summary", f"""WITH {LENGTHS} SELECT count(*) FILTER (length < 50000) AS members, CAST(sum(length) FILTER (length < 50000) AS BIGINT) AS packed_bases,
  count(*) FILTER (length >= 50000) AS native, CAST(sum(length) FILTER (length >= 50000) AS BIGINT) AS native_bases FROM lengths""")
def pack_summary(spark, d):
    rows = lengths(spark, d)
    return planning.packing_summary(planning.pack(rows, 50_000, 100, 200_000), rows).drop("packs")


@query("shard_balance")
def shard_balance(spark, d):
    return planning.shard_balance(lengths(spark, d), 8)


@query("balanced_slices", f"""WITH {LENGTHS}, r AS (SELECT name, row_number() OVER (ORDER BY ord) - 1 AS k, count(*) OVER () AS n FROM lengths),
t AS (SELECT *, least(n, 3 * greatest(1, CAST(ceil(n / 21.0) AS BIGINT))) AS tasks FROM r) SELECT name, (k * tasks + tasks - 1) // n AS task FROM t""")
def balanced_slices(spark, d):
    return windows.balanced_slices(lengths(spark, d), ["ord"], 3, 7).select("name", "task")


# ---------------------------------------------------------------- evaluation


def _two(spark, d):
    rows = cds(spark, d).withColumn("chain", F.floor(F.col("start") / 1000).cast("long"))
    short = rows.select(F.col("chain").alias("gene"), "chain", F.col("tx"), "chrom", "strand", "start", "end")
    ref = short.select("gene", F.col("tx"), "chrom", "strand", "start", "end")
    shifted = F.when(F.col("gene") % 4 == 0, F.col("end") + 1).otherwise(F.col("end"))
    return evaluate.orf_keys(ref), evaluate.orf_keys(ref.withColumn("end", shifted).withColumn("gene", F.col("gene") * 2))


_TWO = f"""{CDS}, ref AS (SELECT "start" // 1000 AS gene, tx, chrom, strand, "start", "end" FROM cds),
pred AS (SELECT gene * 2 AS gene, tx, chrom, strand, "start", CASE WHEN gene % 4 = 0 THEN "end" + 1 ELSE "end" END AS "end" FROM ref),
rk AS (SELECT DISTINCT gene, orf FROM (SELECT gene, tx, string_agg(chrom || ':' || strand || ':' || CAST("start" AS VARCHAR) || ':' || CAST("end" AS VARCHAR), ',' ORDER BY "start", "end") AS orf FROM ref GROUP BY gene, tx)),
pk AS (SELECT DISTINCT gene, orf FROM (SELECT gene, tx, string_agg(chrom || ':' || strand || ':' || CAST("start" AS VARCHAR) || ':' || CAST("end" AS VARCHAR), ',' ORDER BY "start", "end") AS orf FROM pred GROUP BY gene, tx)),
hits AS (SELECT DISTINCT pk.gene AS pred_gene, rk.gene AS ref_gene FROM pk JOIN rk USING (orf))"""


@query("orf_key", f"WITH {_TWO} SELECT gene, orf FROM rk")
def orf_key(spark, d):
    return _two(spark, d)[0].select("gene", "orf")


@query("orf_match", f"WITH {_TWO} SELECT pred_gene, ref_gene FROM hits")
def orf_match(spark, d):
    return evaluate.match_genes(*_two(spark, d)).select("pred_gene", "ref_gene")


@query("unmatched_genes", f"WITH {_TWO} SELECT DISTINCT gene FROM pk WHERE gene NOT IN (SELECT pred_gene FROM hits)")
def unmatched_genes(spark, d):
    ref, pred = map(cut, _two(spark, d))  # read again beside the matches
    return evaluate.unmatched(pred, evaluate.match_genes(ref, pred), "pred_gene")


@query("precision_recall", f"""WITH {_TWO}, n AS (SELECT (SELECT count(DISTINCT pred_gene) FROM hits) AS matched, (SELECT count(DISTINCT gene) FROM pk) AS predicted, (SELECT count(DISTINCT gene) FROM rk) AS reference)
SELECT matched, predicted, reference, round(matched / predicted, 6) AS "precision", round(matched / reference, 6) AS recall FROM n""")
def precision_recall(spark, d):
    ref, pred = map(cut, _two(spark, d))
    rows = evaluate.precision_recall(ref, pred, evaluate.match_genes(ref, pred))
    return rows.select("matched", "predicted", "reference", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("species_lookup", """SELECT n_name AS name, n_nationkey AS species FROM nation""")
def species_lookup(spark, d):
    n = _t(spark, d, "nation")
    names = n.select(F.concat(F.lit(" "), F.lower(F.replace("n_name", F.lit(" "), F.lit("_")))).alias("name"), F.col("n_name").alias("_shown"))
    keys = n.select(F.col("n_name").alias("key"), F.array(F.col("n_nationkey").cast("float")).alias("embedding"))
    found = vectors.find_vectors(names.select("name"), keys)
    return found.join(names, "name").select(F.col("_shown").alias("name"), F.col("embedding")[0].cast("int").alias("species"))


# ---------------------------------------------------------------- decoding


def _favoured(number, i):
    """Probabilities of the 20 states at position i, one of them favoured by it and a number."""
    return F.transform(F.sequence(F.lit(0), F.lit(19)), lambda s: F.when(s == (i * 7 + number) % 20, 0.6).otherwise(0.4 / 19))


def _tiles(spark, d):
    tiles = windows.sequence_windows(seqs(spark, d), 200)
    return tiles.select(F.col("seq_name").cast("string").alias("seq_name"), "strand", "core_start", "core_end", "bases")


def _p(number):
    """The probabilities of a window's 200 positions."""
    return F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: _favoured(number, i))


def _shared_p(spark):
    """like, p: the probabilities of sequences with numbers from 0; they repeat with the number modulo 20."""
    return spark.range(20).select(F.col("id").alias("like"), _p(F.col("id")).alias("p"))


def _with_p(tiles):
    """tiles with the probabilities p that favour a state by position. They repeat with the sequence's number
    modulo 20, so 20 rows hold them; only negative numbers are worked out row by row."""
    number = F.col("seq_name").cast("long")
    shared = _shared_p(tiles.sparkSession).withColumnsRenamed({"like": "_r", "p": "_p"})
    known = tiles.join(F.broadcast(shared), F.when(number >= 0, number % 20) == F.col("_r"), "left")
    return known.select(*tiles.columns, F.when(number >= 0, F.col("_p")).otherwise(_p(number)).alias("p"))


def _probabilities(spark, d):
    """Windows of a text's bases with probabilities that favour a state by position."""
    return _with_p(_tiles(spark, d))


KEYS = "seq_name string, strand string, core_start long, core_end long"


@query("viterbi")
def viterbi(spark, d):
    rows = decode.decode_windows(_probabilities(spark, d), KEYS, use_bases=False, repair=False)
    return rows.select("seq_name", "core_start", F.array_join("states", ",").alias("states"))


@query("constrained_viterbi")
def constrained_viterbi(spark, d):
    rows = decode.decode_windows(_probabilities(spark, d), KEYS)
    return rows.select("seq_name", "core_start", "repaired", F.array_join("states", ",").alias("states"))


@query("annotate_models")
def annotate_models(spark, d):
    return annotate.annotate(_probabilities(spark, d))


@query("posterior_states")
def posterior_states(spark, d):
    """The likeliest state of each position over all paths, and how sure it is on average."""
    rows = decode.posterior_windows(_probabilities(spark, d), KEYS)
    mean = F.aggregate("confidence", F.lit(0.0), lambda a, x: a + x) / F.size("confidence")
    return rows.select("seq_name", "core_start", F.array_join("states", ",").alias("states"), F.round(mean, 4).alias("confidence"))


@query("sequence_viterbi")
def sequence_viterbi(spark, d):
    """The best path through each text's bases as a whole, in pieces of 200."""
    number = F.col("seq_name").cast("long")
    chunks = _tiles(spark, d).withColumn("chunk", ((F.col("core_start") - 1) / 200).cast("long"))
    chunks = chunks.withColumn("like", F.when(number >= 0, number % 20)).withColumn("p", F.when(F.col("like").isNull(), _p(number)))
    return decode.decode_sequences(chunks, shared=_shared_p(spark)).select("seq_name", "chunk", F.array_join("states", ",").alias("states"))


@query("predicted_gff3")
def predicted_gff3(spark, d):
    """Texts' bases as short sequences: packed, predicted from their motifs, lifted back, those across spacers
    predicted again, filtered and rendered."""
    bases = cut(seqs(spark, d).select(F.col("seq_name").alias("ord"), F.col("seq_name").cast("string").alias("seq_name"), "seq"))
    models = predict.predict_packed(bases, 2000, 1500, 100, 20_000)
    return annotation.render_models(cut(predict.finished(models, bases)))


#: Three normals of 64 dimensions, by rule.
_MEANS = [[((k + 1) * (i + 3) % 7 - 3) / 20 for i in range(64)] for k in range(3)]
_SCALES = [[0.1 + (i * (k + 2) % 5) / 20 for i in range(64)] for k in range(3)]
_LOGITS = [0.0, 0.5, -0.5]


def _mixture_sql() -> str:
    weights = [math.exp(w) / sum(map(math.exp, _LOGITS)) for w in _LOGITS]
    parts = []
    for w, m, s in zip(weights, _MEANS, _SCALES, strict=True):
        constant = 64 * math.log(2 * math.pi) + 2 * sum(math.log(x + mixture.SLACK) for x in s)
        off = f"list_sum(list_transform(list_zip(embedding, {m}::DOUBLE[], {[x + mixture.SLACK for x in s]}::DOUBLE[]), lambda t: pow((t[1]::DOUBLE - t[2]) / t[3], 2)))"
        parts.append(f"{math.log(w)!r} - 0.5 * ({constant!r} + {off})")
    return f"""WITH t AS (SELECT vec_id, [{', '.join(parts)}] AS t FROM embeddings)
SELECT vec_id, round(list_max(t) + ln(list_sum(list_transform(t, lambda x: exp(x - list_max(t))))), 4) AS log_pdf FROM t"""


@query("mixture_log_pdf", _mixture_sql())
def mixture_log_pdf(spark, d):
    e = _t(spark, d, "embeddings")
    return e.select("vec_id", F.round(mixture.mixture_log_pdf(F.col("embedding"), _LOGITS, _MEANS, _SCALES), 4).alias("log_pdf"))


# ---------------------------------------------------------------- conversion and repair


def _gtf_rows(spark, d) -> DataFrame:
    """Coding pieces as GTF rows."""
    rows = cds(spark, d)
    text = at.gtf_attributes(F.concat(F.lit("g"), F.col("gene").cast("string")), F.concat(F.lit("t"), F.col("tx").cast("string")))
    return rows.select(
        F.col("chrom").alias("seqid"), F.lit("s").alias("source"), F.lit("CDS").alias("feature"), "start", "end",
        F.lit(None).cast("double").alias("score"), "strand", F.lit(None).cast("int").alias("phase"), text.alias("attributes"),
    )


@query("gtf_to_gff3", f"""WITH {CDS} SELECT chrom || chr(9) || 's' || chr(9) || 'CDS' || chr(9) || CAST("start" AS VARCHAR) || chr(9) || CAST("end" AS VARCHAR) || chr(9) || '.' || chr(9) || strand || chr(9) || '.' || chr(9) ||
  'ID=t' || CAST(tx AS VARCHAR) || '.cds' || CAST(row_number() OVER (PARTITION BY tx ORDER BY "start", "end") AS VARCHAR) || ';Parent=t' || CAST(tx AS VARCHAR) AS line FROM cds""")
def gtf_to_gff3(spark, d):
    return ft.feature_lines(convert.gtf_to_gff3(_gtf_rows(spark, d)))


@query("evaluation_rows", f"""WITH {CDS} SELECT 'g' || CAST(gene AS VARCHAR) AS gene, 't' || CAST(tx AS VARCHAR) AS tx, chrom, strand, "start" AS s, "end" AS e FROM cds""")
def evaluation_rows(spark, d):
    rows = convert.evaluation_rows(_gtf_rows(spark, d))
    return rows.select("gene", "tx", "chrom", "strand", F.col("start").alias("s"), F.col("end").alias("e"))


@query("seams_to_predict", f"""WITH {_WINDOWS}, l AS (SELECT *, lag(s) OVER (PARTITION BY seq ORDER BY s) AS left_start FROM st)
SELECT seq, left_start AS s, left_end AS seam, e FROM l WHERE status = 'invalid_transition'""")
def seams_to_predict(spark, d):
    rows = stitch.seams_to_predict(_windows(spark, d))
    return rows.select("seq", F.col("start").alias("s"), "seam", F.col("end").alias("e"))


@query("complete_paths", f"""WITH {PATHS}, {_STEPS}, l AS (SELECT *, lag(state) OVER (PARTITION BY user_id, pos // 3 ORDER BY pos) AS before FROM paths),
k AS (SELECT *, before IS NULL OR EXISTS (SELECT 1 FROM steps WHERE a = before AND b = state) AS ok FROM l)
SELECT user_id, pos // 3 AS part, bool_and(ok) AND arg_min(state, pos) = 7 AND arg_max(state, pos) = 14 AND count(*) FILTER (state = 7) = 1 AND count(*) FILTER (state = 14) = 1 AS complete FROM k GROUP BY 1, 2""")
def complete_paths(spark, d):
    rows = paths(spark, d).withColumn("part", F.floor(F.col("pos") / 3).cast("long")).withColumn("strand", F.lit("+"))
    return stitch.complete_paths(rows, ["user_id", "part"])


@query("joint_repair")
def joint_repair(spark, d):
    """UTR conflicts in window-long paths built from each text's bases."""
    rows = _probabilities(spark, d).withColumnRenamed("seq_name", "seq").withColumnRenamed("core_start", "start")
    path = [0] * 40 + [15] * 40 + [17] + [18] * 38 + [19] + [16] * 40 + [0] * 40
    return repair.repair_conflicts(rows.withColumn("states", F.array(*map(F.lit, path))).withColumn("seam", F.col("start") + 99)).withColumn("states", F.array_join("states", ","))
