"""Conversion of nine-column rows between GFF3 and GTF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import attributes as at
from .annotation import normalise_row


def _parents(rows: DataFrame) -> DataFrame:
    toks = at.tokens(F.col("attributes"))
    return rows.withColumn("_id", at.unescape(at.first_of(toks, "ID"))).withColumn("_parent", at.unescape(at.first_of(toks, "Parent")))


def orphans(gff3: DataFrame) -> DataFrame:
    """Child rows whose Parent no row has as its ID; a valid file has none."""
    rows = _parents(gff3)
    return rows.where("_parent IS NOT NULL").join(rows.select(F.col("_id").alias("_parent")).distinct(), "_parent", "left_anti").drop("_id", "_parent")


def gff3_to_gtf(gff3: DataFrame) -> DataFrame:
    """GTF rows of GFF3 rows: genes get gene_id, transcripts and their parts also transcript_id.

    Parents are joined by id, so the order of rows doesn't matter. Introns have no row."""
    rows = _parents(gff3)
    tx = rows.where(F.col("feature").isin("mRNA", "transcript")).select(F.col("_id").alias("_tx"), F.col("_parent").alias("_gene"))
    is_tx, is_gene = F.col("feature").isin("mRNA", "transcript"), F.col("feature") == "gene"
    joined = rows.join(tx, rows._parent == tx._tx, "left")
    gene = F.when(is_gene, F.col("_id")).when(is_tx, F.col("_parent")).otherwise(F.col("_gene"))
    name, phase = normalise_row(F.when(F.col("feature") == "mRNA", "transcript").otherwise(F.col("feature")), F.col("phase"))
    own = F.when(is_gene, F.lit(None)).when(is_tx, F.col("_id")).otherwise(F.col("_parent"))
    out = joined.select(
        "seqid", "source", name.alias("feature"), "start", "end", "score", "strand",
        F.nullif(phase, F.lit(".")).cast("int").alias("phase"), at.gtf_attributes(F.coalesce(gene, F.lit("")), own).alias("attributes"),
    )
    return out.where("feature IS NOT NULL")


def gtf_to_gff3(gtf: DataFrame) -> DataFrame:
    """GFF3 rows of GTF rows; parts are numbered by position inside their transcript and feature."""
    from pyspark.sql import Window

    toks = at.tokens(F.col("attributes"))
    rows = gtf.withColumn("_gene", at.last_of(toks, "gene_id")).withColumn("_tx", at.last_of(toks, "transcript_id"))
    nth = F.row_number().over(Window.partitionBy("_tx", "feature").orderBy("start", "end"))
    part = F.concat("_tx", F.lit("."), F.lower("feature"), nth.cast("string"))
    is_gene, is_tx = F.col("feature") == "gene", F.col("feature").isin("transcript", "mRNA")
    coding = F.max((F.col("feature") == "CDS").cast("int")).over(Window.partitionBy("_tx")) == 1
    text = (
        F.when(is_gene, at.gff3_attributes(ID=F.col("_gene")))
        .when(is_tx, at.gff3_attributes(ID=F.col("_tx"), Parent=F.col("_gene")))
        .otherwise(at.gff3_attributes(ID=part, Parent=F.col("_tx")))
    )
    name = F.when(is_tx & coding, "mRNA").when(is_tx, "transcript").otherwise(F.col("feature"))
    return rows.select("seqid", "source", name.alias("feature"), "start", "end", "score", "strand", "phase", text.alias("attributes"))


def evaluation_rows(rows: DataFrame) -> DataFrame:
    """CDS rows for a comparison: gene, tx, chrom, strand, start, end. A row without a
    transcript is one of its own, named by its place."""
    toks = at.tokens(F.col("attributes"))
    place = F.concat_ws(":", F.lit("orphan"), "seqid", F.col("start").cast("string"), F.col("end").cast("string"))
    tx = F.coalesce(at.last_of(toks, "transcript_id"), at.unescape(at.last_of(toks, "Parent")), place)
    gene = F.coalesce(at.last_of(toks, "gene_id"), tx)
    return rows.where("feature = 'CDS'").select(gene.alias("gene"), tx.alias("tx"), F.col("seqid").alias("chrom"), "strand", "start", "end")
