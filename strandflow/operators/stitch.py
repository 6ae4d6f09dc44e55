"""Joining windows of decoded ranges, and splitting what is joined into transcripts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import cut
from .intervals import merge_runs
from .topology import CONTEXT, legal_step

SIDES, MARKERS = ("5UTR", "3UTR"), ("UTR_EI", "UTR_IE")


def seams(windows: DataFrame) -> DataFrame:
    """windows(seq, strand, start, end, first_state, last_state) -> with status against the
    window before (null for the first) and block, a number that grows at every seam that isn't joined."""
    order = Window.partitionBy("seq", "strand").orderBy("start")
    real = windows.where("end >= start")
    before_end, before_state = F.lag("end").over(order), F.lag("last_state").over(order)
    status = (
        F.when(before_end.isNull(), F.lit(None))
        .when(before_end + 1 != F.col("start"), "coordinate_gap")
        .when(legal_step(before_state, F.col("first_state"), F.col("strand")), "joined")
        .otherwise("invalid_transition")
    )
    marked = real.withColumn("left_end", before_end).withColumn("left_state", before_state).withColumn("status", status)
    fresh = F.coalesce((F.col("status") != "joined").cast("int"), F.lit(0))
    return marked.withColumn("block", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


#: What a run of a window's path carries on: its states at both ends in genomic order, how many start and
#: stop states it has, and whether all steps inside it are legal.
SUMMARY = ("first_state", "last_state", "starts", "stops", "legal")


def _conflicts(rows: list[tuple]) -> list:
    """Windows of one UTR context, as (win_start, sides, splice) in order, before which it must be cut:
    those with which what has been joined so far would have two sides and a splice."""
    out, sides, splice = [], set(), False
    for nth, (at, own, spliced) in enumerate(rows):
        if nth and (splice or spliced) and len(sides | own) > 1:
            out.append(at)
            sides, splice = set(own), spliced
        else:
            sides, splice = sides | own, splice or spliced
    return out


def _contexts(rows: DataFrame) -> DataFrame:
    """Of rows(seq, strand, block, win_start, kind, start, end) the UTR contexts that go on over several windows
    and have two sides and a splice: seq, strand, block, context, win_start, sides, splice, a row a window."""
    key = ["seq", "strand", "block"]
    order = Window.partitionBy(*key).orderBy("start")
    inside = F.col("kind").isin(*CONTEXT)
    linked = F.coalesce(inside & F.lag(inside).over(order) & (F.lag("end").over(order) + 1 == F.col("start")), F.lit(False))
    marked = rows.withColumn("_fresh", (~linked).cast("int")).withColumn("context", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sides = F.sort_array(F.collect_set(F.when(F.col("kind").isin(*SIDES), F.col("kind"))))
    own = marked.where(inside).groupBy(*key, "context", "win_start").agg(sides.alias("sides"), F.bool_or(~F.col("kind").isin(*SIDES)).alias("splice"))
    whole = Window.partitionBy(*key, "context")
    both = F.size(F.array_distinct(F.flatten(F.collect_set("sides").over(whole)))) > 1
    own = own.withColumn("_both", both).withColumn("_splice", F.max("splice").over(whole)).withColumn("_windows", F.count("*").over(whole))
    return own.where("_both AND _splice AND _windows > 1").drop("_both", "_splice", "_windows")


def _cuts(contexts: DataFrame) -> DataFrame:
    key = ["seq", "strand", "block", "context"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("win_start")
        cuts = _conflicts([(w, set(x), bool(y)) for w, x, y in zip(pdf["win_start"], pdf["sides"], pdf["splice"], strict=True)])
        return pdf[pdf["win_start"].isin(cuts)][[*key, "win_start"]].rename(columns={"win_start": "at"})

    kinds = dict(contexts.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in key) + f", at {kinds['win_start']}"
    return contexts.groupBy(*key).applyInPandas(fold, schema)


def context_cuts(rows: DataFrame) -> DataFrame:
    """rows(seq, strand, block, win_start, kind, start, end) -> seq, strand, block, context, at: windows whose join
    to the window before would give one UTR two sides.

    That depends on what is joined before, but only as far back as UTR and introns go on without
    a gap, so it is folded for each such context that has two sides, a splice and several windows, and
    not for a whole sequence. A context has a row a window there."""
    return _cuts(_contexts(rows))


def conflict_windows(windows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Of stitch()'s arguments -> seq, strand, seam, win_start: for each UTR context with conflicts its first seam (the
    last position left of it), with all windows that the context goes through and their neighbours."""
    placed = seams(windows).withColumnRenamed("start", "win_start")
    order = Window.partitionBy("seq", "strand", "block").orderBy("win_start")
    placed = placed.select("seq", "strand", "block", "win_start", F.lag("win_start").over(order).alias("_before"), F.lead("win_start").over(order).alias("_after"))
    own = _contexts(ranges.join(placed.drop("_before", "_after"), ["seq", "strand", "win_start"]))
    first = _cuts(own).groupBy("seq", "strand", "block", "context").agg((F.min("at") - 1).alias("seam"))
    through = own.join(first, ["seq", "strand", "block", "context"]).join(placed, ["seq", "strand", "block", "win_start"])
    near = F.filter(F.array("_before", "win_start", "_after"), lambda x: x.isNotNull())
    return through.select("seq", "strand", "seam", F.explode(near).alias("win_start")).distinct()


def _joined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Touching ranges of one kind made one, with what they carry."""
    carried = [c for c in SUMMARY if c in rows.columns]
    if not carried:
        return merge_runs(rows, keys, "kind")
    order = Window.partitionBy(*keys).orderBy("start")
    linked = F.coalesce(F.lag("kind").over(order).eqNullSafe(F.col("kind")) & (F.lag("end").over(order) + 1 == F.col("start")), F.lit(False))
    step = legal_step(F.lag("last_state").over(order), F.col("first_state"), F.col("strand"))
    marked = rows.withColumn("_fresh", (~linked).cast("int")).withColumn("_ok", F.col("legal") & (~linked | step))
    marked = marked.withColumn("_run", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run", "kind").agg(
        F.max("end").alias("end"), F.min_by("first_state", "start").alias("first_state"), F.max_by("last_state", "start").alias("last_state"),
        F.sum("starts").alias("starts"), F.sum("stops").alias("stops"), F.bool_and("_ok").alias("legal"), F.min("start").alias("start"),
    ).drop("_run")


def stitch(windows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Blocks of ranges: seq, strand, block, kind, start, end, block_start and, if ranges have them, the
    SUMMARY columns.

    ranges(seq, strand, win_start, kind, start, end) are each window's own. Blocks from
    seams() are cut further where a join would give one UTR two sides (see context_cuts)."""
    placed = seams(windows).select("seq", "strand", F.col("start").alias("win_start"), "block")
    rows = cut(ranges.join(placed, ["seq", "strand", "win_start"]))
    key = ["seq", "strand", "block"]
    cuts = context_cuts(rows).select(*key, F.col("at").alias("win_start"), F.lit(1).alias("_cut"))
    rows = rows.join(cuts, [*key, "win_start"], "left")
    order = Window.partitionBy(*key).orderBy("win_start", "start")
    fresh = F.when(F.col("_cut").isNotNull() & (F.row_number().over(Window.partitionBy(*key, "win_start").orderBy("start")) == 1), 1).otherwise(0)
    rows = rows.withColumn("_cut", fresh).withColumn("part", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_cut")
    joined = _joined(rows, [*key, "part"])
    first = F.min("start").over(Window.partitionBy(*key, "part"))
    return joined.withColumn("block_start", first).drop("part")


def whole_coding(groups: DataFrame, keys: list[str]) -> DataFrame:
    """groups(keys, strand, kind, start, end, SUMMARY) of split_transcripts() -> keys of those whose path from
    the first to the last coding base is a complete coding path (see complete_paths)."""
    every = Window.partitionBy(*keys)
    coding = F.col("kind") == "CDS"
    inner = groups.withColumn("_from", F.min(F.when(coding, F.col("start"))).over(every)).withColumn("_to", F.max(F.when(coding, F.col("end"))).over(every))
    inner = inner.where("start >= _from AND end <= _to")
    order = every.orderBy("start")
    step = (F.lag("end").over(order) + 1 == F.col("start")) & legal_step(F.lag("last_state").over(order), F.col("first_state"), F.col("strand"))
    rows = inner.withColumn("_ok", F.col("legal") & (F.lag("end").over(order).isNull() | step))
    minus = F.min("strand") == "-"
    low, high = F.min_by("first_state", "start"), F.max_by("last_state", "start")
    ends = (F.when(minus, high).otherwise(low) == 7) & (F.when(minus, low).otherwise(high) == 14)
    return rows.groupBy(*keys).agg((F.bool_and("_ok") & ends & (F.sum("starts") == 1) & (F.sum("stops") == 1)).alias("_whole")).where("_whole").drop("_whole")


def resolve_utr(ranges: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Give UTR splice markers the side of their context: keys, kind, start, end.

    A context is a run of touching UTR, marker and intron ranges. Two sides with a splice
    are an error; so are, if strict, markers without any side."""
    order = Window.partitionBy(*keys).orderBy("start")
    inside = F.col("kind").isin(*CONTEXT)
    linked = inside & F.lag(inside).over(order) & (F.lag("end").over(order) + 1 == F.col("start"))
    marked = ranges.withColumn("_fresh", F.when(linked, 0).otherwise(1)).withColumn("_c", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*keys, "_c")
    sides = F.collect_set(F.when(F.col("kind").isin(*SIDES), F.col("kind"))).over(whole)
    splice = F.max(F.when(F.col("kind").isin(*MARKERS, "intron") & inside, 1).otherwise(0)).over(whole)
    seen = marked.withColumn("_sides", sides).withColumn("_splice", splice)
    marker = F.col("kind").isin(*MARKERS)
    kind = F.when((F.size("_sides") > 1) & (F.col("_splice") == 1), F.raise_error(F.lit("a UTR splice has two sides")))
    kind = kind.when(marker & (F.size("_sides") == 1), F.element_at("_sides", 1))
    if strict:
        kind = kind.when(marker, F.raise_error(F.lit("a UTR splice has no side")))
    return merge_runs(seen.select(*keys, kind.otherwise(F.col("kind")).alias("kind"), "start", "end"), keys, "kind")


def split_transcripts(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Number the runs of non-intergenic ranges in each block: adds group and edge ('first',
    'last' or null). A block that begins genic has a first edge if a later group ends inside
    it; one that ends genic has a last edge."""
    order = Window.partitionBy(*keys).orderBy("start")
    whole = Window.partitionBy(*keys)
    between = F.col("kind") == "intergenic"
    rows = blocks.withColumn("group", F.sum(between.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    last = F.max("group").over(whole)
    rows = rows.withColumn("_last", last).where("kind <> 'intergenic'")
    edge = F.when(F.col("group") == F.col("_last"), "last").when(F.col("group") == 0, "first")
    return rows.withColumn("edge", edge).drop("_last")


def complete_paths(path: DataFrame, keys: list[str]) -> DataFrame:
    """path(keys, strand, pos, state) -> keys, complete: contiguous, from one start (7) to one
    stop (14) in transcription order, with legal steps only."""
    order = Window.partitionBy(*keys).orderBy("pos")
    back = F.lag("pos").over(order)
    ok = back.isNull() | ((back + 1 == F.col("pos")) & legal_step(F.lag("state").over(order), F.col("state"), F.col("strand")))
    rows = path.withColumn("_ok", ok)
    minus = F.min("strand") == "-"
    low, high = F.min_by("state", "pos"), F.max_by("state", "pos")
    return rows.groupBy(*keys).agg(
        (F.bool_and("_ok") & (F.when(minus, high).otherwise(low) == 7) & (F.when(minus, low).otherwise(high) == 14)
         & (F.count_if(F.col("state") == 7) == 1) & (F.count_if(F.col("state") == 14) == 1)).alias("complete")
    )


def transcripts_of_edges(groups: DataFrame, complete: DataFrame, keys: list[str]) -> DataFrame:
    """Groups inside their blocks, and those at an edge whose coding path is complete."""
    inner = groups.where("edge IS NULL")
    return inner.unionByName(groups.where("edge IS NOT NULL").join(complete, keys, "left_semi"))


def seams_to_predict(windows: DataFrame) -> DataFrame:
    """Pairs of touching windows with an illegal step between them, to be predicted again as
    one: seq, strand, start, seam, end. The right window starts after ``seam``."""
    order = Window.partitionBy("seq", "strand").orderBy("start")
    marked = seams(windows).withColumn("_left", F.lag("start").over(order))
    bad = marked.where("status = 'invalid_transition'")
    return bad.select("seq", "strand", F.col("_left").alias("start"), F.col("left_end").alias("seam"), "end")
