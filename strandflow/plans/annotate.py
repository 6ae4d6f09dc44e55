"""From sequences and window probabilities to gene models, as one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import annotation, decode, stitch, topology, windows
from ..operators.components import cut


def model_windows(seqs: DataFrame, core: int, flank: int = 0) -> DataFrame:
    return windows.both_strands(windows.sequence_windows(seqs, core, flank))


def genomic_paths(decoded: DataFrame, flank: int = 0) -> DataFrame:
    """decoded(seq_name, strand, core_start, core_end, states) -> seq, strand, win_start, pos, state.

    Flanks and padding go; minus windows, decoded in transcription order, are turned round."""
    n = F.col("core_end") - F.col("core_start") + 1
    turned = F.when(F.col("strand") == "-", F.reverse("states")).otherwise(F.col("states"))
    core = F.slice(turned, F.lit(flank + 1), n.cast("int"))
    rows = decoded.select(F.col("seq_name").alias("seq"), "strand", F.col("core_start").alias("win_start"), F.posexplode(core).alias("_i", "state"))
    return rows.select("seq", "strand", "win_start", (F.col("win_start") + F.col("_i")).alias("pos"), "state")


RUNS = "seq string, strand string, win_start long, kind string, start long, end long, first_state int, last_state int, starts int, stops int, legal boolean"


def run_encoder(flank: int = 0) -> tuple[Callable, str]:
    """A function from Arrow batches of decoded windows (see path_runs) to batches of their runs, and the schema of these.
    All windows of a batch are encoded side by side."""
    names = sorted(set(topology.FEATURES))
    kinds = np.array([names.index(f) for f in topology.FEATURES])
    may_follow = np.zeros((20, 20), bool)
    for state, after in topology.NEXT.items():
        may_follow[state, list(after)] = True

    def encoded(batch):
        states, first = batch.column("states"), batch.column("core_start").to_numpy(zero_copy_only=False)
        size = batch.column("core_end").to_numpy(zero_copy_only=False) - first + 1
        minus = np.array([x == "-" for x in batch.column("strand").to_pylist()], bool)
        ends, values = states.offsets.to_numpy(), states.values.to_numpy(zero_copy_only=False)
        cores, owner = [], []
        for i, known in enumerate(states.is_valid().to_pylist()):
            path = values[ends[i] : ends[i + 1]] if known and size[i] > 0 else values[:0]
            path = (path[::-1] if minus[i] else path)[flank : flank + int(size[i])]
            if len(path):
                cores.append(path)
                owner.append(i)
        owner, lengths = np.array(owner, int), np.array([len(x) for x in cores], int)
        path = np.concatenate(cores).astype(np.int64) if cores else np.empty(0, np.int64)
        if len(path) and (path.min() < 0 or path.max() > 19):
            raise ValueError("a state is outside 0 to 19")
        begins = np.cumsum(lengths) - lengths
        kind = kinds[path]
        fresh = np.concatenate(([True], kind[1:] != kind[:-1]))[: len(path)]
        fresh[begins] = True
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(path))[: len(head)] - 1
        turned = np.repeat(minus[owner], lengths)[1:]
        a, b = np.where(turned, path[1:], path[:-1]), np.where(turned, path[:-1], path[1:])
        wrong = np.concatenate(([0], np.cumsum(~may_follow[a, b])))
        count = lambda state: np.diff(np.concatenate(([0], np.cumsum(path == state)))[np.append(head, len(path))])
        window = np.searchsorted(begins, head, side="right") - 1
        at, shift = owner[window], (first[owner] - begins)[window]
        own = [batch.column(c).take(pa.array(at)) for c in ("seq_name", "strand")]
        cells = [first[at], np.array(names)[kind[head]], head + shift, tail + shift, path[head], path[tail], count(7), count(14), wrong[tail] == wrong[head]]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.bool_()]
        return pa.RecordBatch.from_arrays([*own, *[pa.array(x, t) for x, t in zip(cells, types, strict=True)]], [c.split()[0] for c in RUNS.split(", ")])

    return lambda batches: map(encoded, batches), RUNS


def path_runs(decoded: DataFrame, flank: int = 0) -> DataFrame:
    """decoded(seq_name, strand, core_start, core_end, states) -> seq, strand, win_start, kind, start, end and
    stitch.SUMMARY: each window's runs of one feature in genomic order, without flanks and padding.

    A window is encoded where it is decoded; no row a base is ever made."""
    read = [F.col(c).cast(t) for c, t in (("seq_name", "string"), ("strand", "string"), ("core_start", "long"), ("core_end", "long"), ("states", "array<int>"))]
    return decoded.select(*read).where("states IS NOT NULL").mapInArrow(*run_encoder(flank))


def window_runs(windows: DataFrame, flank: int = 0, **options) -> DataFrame:
    """path_runs() of windows that decode.decode_windows() decodes with ``options``, in one task: their states don't leave it."""
    return decode.decode_windows(windows, "seq_name string, strand string, core_start long, core_end long", then=run_encoder(flank), **options)


def models_from_runs(runs: DataFrame) -> DataFrame:
    """Gene models of path_runs(), materialised: gene, tx, chrom, strand, feature, start, end.

    Runs are stitched over legal seams and split at intergenic; groups at a block's edges stay only if
    their coding path is complete; UTR markers get their side. All of it works on runs."""
    ends = runs.groupBy("seq", "strand", "win_start").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("first_state", "start").alias("first_state"), F.max_by("last_state", "start").alias("last_state")
    )
    spans = stitch.stitch(ends, runs)
    key = ["seq", "strand", "block", "block_start"]
    groups = cut(stitch.split_transcripts(spans, key))  # read three times below
    own = [*key, "group"]
    whole = stitch.whole_coding(groups.where("edge IS NOT NULL"), own)
    kept = stitch.transcripts_of_edges(groups, whole, own)
    resolved = stitch.resolve_utr(kept, own)
    tx = F.concat_ws(":", "seq", "strand", "block_start", "group")
    return resolved.where("kind <> 'intron'").select(tx.alias("gene"), tx.alias("tx"), F.col("seq").alias("chrom"), "strand", F.col("kind").alias("feature"), "start", "end")


def models_from_paths(paths: DataFrame) -> DataFrame:
    """models_from_runs() of paths(seq, strand, win_start, pos, state) with a row a position."""
    order = Window.partitionBy("seq", "strand", "win_start").orderBy("pos")
    kind, back = topology.feature_of(F.col("state")), F.lag("pos").over(order) + 1 == F.col("pos")
    step = topology.legal_step(F.lag("state").over(order), F.col("state"), F.col("strand"))
    marked = paths.withColumn("kind", kind)
    linked = F.coalesce(back & (F.lag("kind").over(order) == F.col("kind")), F.lit(False))
    marked = marked.withColumn("_fresh", (~linked).cast("int")).withColumn("_ok", ~linked | step)
    marked = marked.withColumn("_run", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy("seq", "strand", "win_start", "_run", "kind").agg(
        F.min("pos").alias("start"), F.max("pos").alias("end"), F.min_by("state", "pos").alias("first_state"), F.max_by("state", "pos").alias("last_state"),
        F.count_if(F.col("state") == 7).alias("starts"), F.count_if(F.col("state") == 14).alias("stops"), F.bool_and("_ok").alias("legal"),
    )
    return models_from_runs(cut(runs.drop("_run")))


def annotate(windows_with_p: DataFrame, flank: int = 0, use_bases: bool = True, prefilter: bool = False, scorer: Callable | None = None) -> DataFrame:
    """windows(seq_name, strand, core_start, core_end, bases, p) -> gene models. With ``prefilter``
    windows without a coding signal aren't decoded but are intergenic; with a ``scorer`` p isn't read."""
    runs = window_runs(windows_with_p, flank, use_bases=use_bases, prefilter=prefilter, scorer=scorer)
    return models_from_runs(cut(runs))  # the plan below reads the runs many times


def gff3(models: DataFrame) -> DataFrame:
    """Ordered GFF3 lines of gene models."""
    return annotation.render_models(models)
