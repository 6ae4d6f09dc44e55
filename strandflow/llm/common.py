"""What the corpus operators share: shared folders, lineage cuts and word splitting.

Every operator reads the columns it names and ignores the others, so tables may
carry further columns of any name.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: a blank and the bytes 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the
    session has one, else, on one machine only, a temporary folder set here."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path and not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = path or tempfile.mkdtemp(prefix="strandflow-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a written table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written in the shared folder and read again. Loops that join their own results use it
    in place of cut(): a checkpoint hands on the planner's size estimates, and products of
    products soon have so many digits that planning takes longer than the work; a written
    table has its true size."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id, folds: int, fold: int):
    """Is crc32 of the id as text, modulo folds, the held-out fold?"""
    return F.crc32(doc_id.cast("string")) % folds == fold


#: A key is heavy when it holds over one row in so many; there are at most so many heavy keys.
HEAVY = 4096


def attach(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str) -> DataFrame:
    """rows inner-joined with groups (one row a key; ``size`` counts its rows).

    Groups that hold more than 1 / HEAVY of all rows number at most HEAVY whatever the
    data's size, so they are broadcast and their rows stay where they are; all other
    keys are too light to skew the shuffled join. Both inputs should be materialised."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    heavy = groups.where(F.col(size) * HEAVY > total)
    light = groups.where(F.col(size) * HEAVY <= total)
    on_heavy = rows.join(F.broadcast(heavy), key)
    on_light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return on_heavy.unionByName(on_light)


#: Up to so many ids (of 8 to 40 bytes each) are broadcast; beyond it both sides are shuffled.
BROADCAST_IDS = 100_000


def join_ids(docs: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """docs joined with a materialised table of ids, broadcast only while it is small."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


def told_apart(docs: DataFrame) -> tuple[DataFrame, str | None]:
    """docs with an id for each row, and the name of the column that now has the ids they came with (None
    if those tell the rows apart).

    If ids are null or repeated, each row gets a number of its own in the order of the ids, null
    ids last; rows of one id follow in the order of their texts' hashes and then of their places in
    the input, so an id that a third of the rows share is numbered by many tasks. It is written
    once, so every reading of a row sees the same one."""
    n, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == ids:
        return docs, None
    own = f"doc_id_{uuid.uuid4().hex}"
    place = f"place_{uuid.uuid4().hex}"
    rows = docs.withColumn(place, F.monotonically_increasing_id())
    rows = rows.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), place).drop(place).withColumnRenamed("doc_id", own)
    return cut(rows.withColumn("doc_id", F.monotonically_increasing_id())), own


def by_row(docs: DataFrame, drop) -> DataFrame:
    """drop(docs), where drop decides by doc_id, with the rows told apart by more than their ids."""
    rows, own = told_apart(docs)
    kept = drop(rows)
    if own is None:
        return kept
    return kept.drop("doc_id").withColumnRenamed(own, "doc_id").select(docs.columns)


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str, folds: int, fold: int, per_class: int):
    """At most ``per_class`` texts of each 0/1 label in ``column``, none of the held-out fold, as a
    pandas frame (doc_id, text, label) in doc_id order.

    The sample is drawn by a hash of the id from the labels alone; only its ids, at most
    1.25 * per_class of a class, are broadcast to the documents. Of several labels of one
    document the smallest counts, and so does the smallest of several texts of one id."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    known = known.groupBy("doc_id").agg(F.min(column).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, 1.25 * per_class / n))).otherwise(share)
    ticket = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = known.where(ticket < share).select(F.col("doc_id").alias("drawn_id"), "label")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("drawn_id"))
    found = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label").toPandas().sort_values("doc_id")
    return found.groupby("label", sort=True).head(per_class)


_SEPARATE = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Runs of letters and digits of the lower-cased text; all beyond ASCII counts as letters."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SEPARATE).split()


def numbered_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, pa.LargeBinaryArray]:
    """tokens() of all texts at once: how many each text has, their numbers one text after the other, and the
    distinct words by number."""
    lowered = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    flat = np.frombuffer(b" ".join(lowered).translate(_SEPARATE), np.uint8)
    letter = flat != 32
    edges = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    first, last = edges[::2], edges[1::2]
    ends = np.concatenate([[0], np.cumsum(last - first)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(flat[letter])]).dictionary_encode()
    limits = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1)
    return np.diff(np.searchsorted(first, limits), prepend=0), words.indices.to_numpy(), words.dictionary
