"""Gene, transcript and feature tables: spans, numbers, lift-over and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import attributes as at
from .components import cut
from .intervals import merge_touching


def transcript_spans(features: DataFrame, tx: str = "tx", more: list[Column] | None = None) -> DataFrame:
    """One row a transcript: chrom, strand, gene, start, end, cds_len, n_exons and what ``more`` aggregates."""
    is_cds = F.col("feature") == "CDS"
    size = F.col("end") - F.col("start") + 1
    return features.groupBy(tx).agg(
        F.min("gene").alias("gene"), F.min("chrom").alias("chrom"), F.min("strand").alias("strand"),
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.coalesce(F.sum(F.when(is_cds, size)), F.sum(F.when(F.col("feature") == "exon", size)), F.lit(0)).cast("long").alias("cds_len"),
        F.count_if(F.col("feature") == "exon").alias("n_exons"), F.bool_or(is_cds).alias("coding"), *(more or []),
    )


def gene_spans(transcripts: DataFrame) -> DataFrame:
    """One row a gene, chrom and strand: gene, start, end, n_tx, biotype.

    A gene id used on several sequences or strands makes a gene on each; all but the first
    by (chrom, strand) get a suffix."""
    spans = transcripts.groupBy("gene", "chrom", "strand").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_tx"),
        F.when(F.bool_or("coding"), "protein_coding").otherwise("unclassified").alias("biotype"),
    )
    nth = F.row_number().over(Window.partitionBy("gene").orderBy("chrom", "strand"))
    named = spans.withColumn("_n", nth)
    return named.withColumn("gene_key", F.when(F.col("_n") == 1, F.col("gene").cast("string")).otherwise(F.concat(F.col("gene").cast("string"), F.lit("_"), F.col("_n").cast("string")))).drop("_n")


def global_numbers(df: DataFrame, order: list[str], out: str, partitions: int | None = None) -> DataFrame:
    """Number rows from 1 in a total order without one task seeing them all: rows are range
    partitioned, numbered inside each range and shifted by the ranges before it. The ranges are
    written once, so that the rows and the sizes of the ranges come from the same partitions."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright(F.col("_id"), 33)).withColumn("_nth", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.max("_nth").alias("_most"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shift = sizes.select("_part", F.coalesce(F.sum(F.col("_most") + 1).over(before), F.lit(0)).alias("_shift"))
    return placed.join(F.broadcast(shift), "_part").withColumn(out, F.col("_nth") + F.col("_shift") + 1).drop("_id", "_part", "_nth", "_shift")


def running_total(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Add what ``value`` adds up to in all rows before this one in a total order, without one task seeing
    them all (see global_numbers)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright(F.col("_id"), 33))
    sizes = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shift = sizes.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn(out, inside).join(F.broadcast(shift), "_part").withColumn(out, (F.col(out) + F.col("_shift")).cast("long")).drop("_id", "_part", "_shift")


def numbered(df: DataFrame, parent: list[str], order: list[str], out: str) -> DataFrame:
    """Number rows from 1 inside each parent."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*parent).orderBy(*order)).cast("long"))


#: The features whose union is a transcript's exons.
PIECES = ("CDS", "five_prime_UTR", "three_prime_UTR", "5UTR", "3UTR")


def infer_exons(features: DataFrame, keys: list[str]) -> DataFrame:
    """Exons as the union of CDS and UTR pieces that touch or overlap."""
    return merge_touching(features.where(F.col("feature").isin(*PIECES)), keys).select(*keys, "start", "end")


def _with_exon_numbers(features: DataFrame) -> DataFrame:
    """Add exon_no: of which of its transcript's inferred exons, from 1 by position, a piece is; null for other features."""
    piece, order = F.col("feature").isin(*PIECES), Window.partitionBy("tx").orderBy("start", "end")
    reach = F.max(F.when(piece, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = features.withColumn("_fresh", (piece & (reach.isNull() | (F.col("start") > reach + 1))).cast("int"))
    number = F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return fresh.withColumn("exon_no", F.when(piece, number)).drop("_fresh")


def normalise_row(feature: Column, phase: Column) -> tuple[Column, Column]:
    """Public feature name and phase; introns have no row (null)."""
    name = F.when(feature == "intron", F.lit(None)).when(feature == "5UTR", "five_prime_UTR").when(feature == "3UTR", "three_prime_UTR").otherwise(feature)
    coded = F.when(feature.isin("CDS", "start_codon", "stop_codon"), phase.cast("string"))
    return name, F.coalesce(coded, F.lit("."))


#: Segments of a lift-over that may be broadcast; beyond it both sides are joined by position bins.
BROADCAST_SEGMENTS = 100_000
SEGMENT_BIN = 1 << 16
#: Names of packed sequences that may be broadcast.
BROADCAST_NAMES = 1_000_000


def _near_segments(rows: DataFrame, segments: DataFrame, condition: Column, how: str) -> DataFrame:
    """Range join on the packed name; a large segment table is dealt by bins that rows touch.

    In the binned form of a left join rows lie inside of a segment, so they go by the bin of their start alone; an
    inner join takes each pair at the first bin that both touch."""
    if segments.count() <= BROADCAST_SEGMENTS:
        return rows.join(F.broadcast(segments), condition, how)
    at = lambda x: F.floor(F.col(x) / SEGMENT_BIN)
    right = segments.withColumn("_sbin", F.explode(F.sequence(at("packed_start"), at("packed_end"))))
    if how == "left":
        return rows.withColumn("_bin", at("start")).join(right, condition & (F.col("_bin") == F.col("_sbin")), "left").drop("_bin", "_sbin")
    left = rows.withColumn("_bin", F.explode(F.sequence(at("start"), F.greatest(at("start"), at("end")))))
    first = F.greatest(at("start"), at("packed_start"))
    return left.join(right, condition & (F.col("_bin") == F.col("_sbin")) & (F.col("_bin") == first)).drop("_bin", "_sbin")


def lift_over(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """rows(id, seq, start, end) -> with source, source_start, source_end, mapped.

    segments(packed_name, original_name, packed_start, packed_end). A row maps if one segment
    contains it; a row on a sequence that isn't packed maps to itself; others get nulls."""
    inside = (F.col("seq") == F.col("packed_name")) & (F.col("start") >= F.col("packed_start")) & (F.col("end") <= F.col("packed_end"))
    found = _near_segments(rows, segments, inside, "left")
    names = cut(segments.select(F.col("packed_name").alias("_p")).distinct())
    packed = F.broadcast(names) if names.count() <= BROADCAST_NAMES else names
    found = found.join(packed, F.col("seq") == F.col("_p"), "left")
    native = F.col("_p").isNull()
    shift = F.col("packed_start") - 1
    return found.select(
        *rows.columns, F.when(native, F.col("seq")).otherwise(F.col("original_name")).alias("source"),
        F.when(native, F.col("start")).otherwise(F.col("start") - shift).alias("source_start"),
        F.when(native, F.col("end")).otherwise(F.col("end") - shift).alias("source_end"),
        (native | F.col("original_name").isNotNull()).alias("mapped"),
    )


def touched_sources(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """(id, source) of every segment that a row overlaps."""
    over = (F.col("seq") == F.col("packed_name")) & (F.col("packed_end") >= F.col("start")) & (F.col("packed_start") <= F.col("end"))
    return _near_segments(rows, segments, over, "inner").select("id", F.col("original_name").alias("source")).distinct()


def lift_groups(rows: DataFrame, segments: DataFrame, group: str) -> DataFrame:
    """group, mapped, source: a group maps only if all its rows map to one source."""
    lifted = lift_over(rows, segments)
    out = lifted.groupBy(group).agg(F.bool_and("mapped").alias("_all"), F.min("source").alias("_low"), F.max("source").alias("_high"))
    ok = F.col("_all") & (F.col("_low") == F.col("_high"))
    return out.select(group, F.coalesce(ok, F.lit(False)).alias("mapped"), F.when(ok, F.col("_low")).alias("source"))


def recheck_sources(rows: DataFrame, segments: DataFrame, group: str) -> DataFrame:
    """Sources to predict again: all that the groups which don't map touch."""
    failed = lift_groups(rows, segments, group).where("NOT mapped").select(group)
    return touched_sources(rows.join(failed, group, "left_semi"), segments).select("source").distinct()


def replace_sources(old: DataFrame, new: DataFrame, again: DataFrame, key: str = "source") -> DataFrame:
    """old without the rows of the sources in ``again``, plus new's rows of those sources."""
    return old.join(again, key, "left_anti").unionByName(new.join(again, key, "left_semi"))


def gtf_line(chrom: Column, source: Column, feature: Column, start: Column, end: Column, strand: Column, phase: Column, attributes: Column) -> Column:
    cells = [chrom, source, feature, start.cast("string"), end.cast("string"), F.lit("."), strand, F.coalesce(phase.cast("string"), F.lit(".")), attributes]
    return F.concat_ws("\t", *cells)


def render_models(features: DataFrame, source: str = "strandflow", prefix: str = "OG_") -> DataFrame:
    """Public GFF3 rows of gene models: chrom, gene_no, rank, line, in the order to be written.

    features: gene, tx, chrom, strand, feature (CDS and UTR pieces), start, end. Genes are
    numbered by (chrom, start, end, strand), transcripts inside a gene by (start, end, id),
    exons and CDS by position."""
    from .intervals import TASK_ROWS, cds_phase

    n = max(int(features.sparkSession.conf.get("spark.sql.shuffle.partitions")), features.count() // TASK_ROWS)
    dealt = lambda *c: features.select("tx", "feature", "start", "end", *c).repartition(n, "tx")
    spans = cut(transcript_spans(_with_exon_numbers(dealt("gene", "chrom", "strand")), more=[F.max("exon_no").alias("exons")]))
    genes = gene_spans(spans).select("gene", "chrom", "strand", F.col("start").alias("g_start"), F.col("end").alias("g_end"), "biotype")
    genes = global_numbers(genes, ["chrom", "g_start", "g_end", "strand", "gene"], "gene_no")
    genes = genes.withColumn("gene_id", F.concat(F.lit(prefix), F.lpad(F.col("gene_no").cast("string"), 8, "0")))
    tx = numbered(spans.join(genes, ["gene", "chrom", "strand"]), ["gene_id"], ["start", "end", "tx"], "tx_no")
    tx = cut(tx.withColumn("tx_id", F.concat("gene_id", F.lit("-mRNA-"), F.col("tx_no").cast("string"))))
    null = F.lit(None).cast("long")
    exons = _with_exon_numbers(dealt()).where("exon_no IS NOT NULL").groupBy("tx", F.col("exon_no").alias("part_no"))
    exons = exons.agg(F.min("start").alias("start"), F.max("end").alias("end")).select("tx", "start", "end", F.lit("exon").alias("feature"), null.alias("phase"), "part_no")
    cds = cds_phase(dealt("strand").where("feature = 'CDS'"), ["tx"])
    cds = numbered(cds, ["tx"], ["start", "end"], "part_no").select("tx", "start", "end", "feature", "phase", "part_no")
    name = F.when(F.col("coding"), "mRNA").otherwise("transcript")

    def line(feature, start, end, phase, attributes):
        return gtf_line(F.col("chrom"), F.lit(source), feature, start, end, F.col("strand"), phase, attributes).alias("line")

    gene_rows = genes.select("chrom", "gene_no", F.lit(0).alias("tx_no"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("nth"),
        line(F.lit("gene"), F.col("g_start"), F.col("g_end"), null, at.gff3_attributes(ID=F.col("gene_id"), gene_biotype=F.col("biotype"))))
    tx_rows = tx.select("chrom", "gene_no", "tx_no", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("nth"),
        line(name, F.col("start"), F.col("end"), null, at.gff3_attributes(ID=F.col("tx_id"), Parent=F.col("gene_id"), Num_exons=F.col("exons"), geneID=F.col("gene_id"), gene_biotype=F.col("biotype"))))
    ids = tx.select("tx", "chrom", "strand", "gene_no", "tx_no", "tx_id")
    child = F.concat("tx_id", F.lit("."), F.lower("feature"), F.col("part_no").cast("string"))
    rows = lambda parts: parts.join(ids, "tx").select("chrom", "gene_no", "tx_no", F.when(F.col("feature") == "exon", 2).otherwise(3).alias("kind"), F.col("part_no").alias("nth"),
        line(F.col("feature"), F.col("start"), F.col("end"), F.col("phase"), at.gff3_attributes(ID=child, Parent=F.col("tx_id"))))
    return gene_rows.unionByName(tx_rows).unionByName(rows(exons)).unionByName(rows(cds))
