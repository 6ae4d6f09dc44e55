"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ in at
most three bits agree in at least five of the eight bytes (the guaranteed minimum).
The index posts each distinct fingerprint under eight keys: every three bytes of the
first half and every three bytes of the second half, with their positions. Five
agreeing bytes put three into one half, so every qualifying pair meets in a posting
list. In each list the shared positional bytes are tallied per pair, pairs below the
guaranteed minimum go, and the rest are verified by the exact bit distance.

Copies collapse to one fingerprint before anything is posted. A posting list longer
than ``split_above`` is dealt again over keys one byte longer: a pair that already
shares three bytes shares at least two of the remaining five, so one of any four of
them; this goes on until lists are short or five bytes are fixed. A list answers with
star links to the smallest fingerprint of each connected piece, not with its pairs,
so a list of m fingerprints returns fewer than m links. Components over the links are
found by repeated minimum-label steps with pointer jumping, on Spark tables only.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, by_row, cut, join_ids, table
from .components import components

#: A-Z to a-z on UTF-8 bytes.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: For a byte value, a word whose eight byte lanes hold its eight bits.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_hashes(text: bytes | None, width: int = 3) -> np.ndarray:
    """XXH64 with seed 42 of every word shingle, repeats included."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    pieces = [joined[s:e] for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), np.uint64, len(pieces))


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of hashes; a bit is 1 if set in over half a run.

    Bits are summed in byte lanes over pieces of at most 255 hashes, then per run."""
    out = np.zeros(len(counts), np.uint64)
    live = np.flatnonzero(counts)
    if not len(live):
        return out
    first = np.concatenate(([0], np.cumsum(counts[live])[:-1]))
    pieces = -(-counts[live] // 255)
    owner_first = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    nth = np.arange(pieces.sum()) - np.repeat(owner_first, pieces)
    cuts = np.repeat(first, pieces) + 255 * nth
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(LANES[octets[:, k]], cuts).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), owner_first, axis=0)
        bits = np.packbits(2 * ones > counts[live][:, None], axis=1, bitorder="little").ravel()
        out[live] |= bits.astype(np.uint64) << np.uint64(8 * k)
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp long (the 64 bits, signed). Null and wordless texts get zero."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            parts = [shingle_hashes(t, width) for t in texts]
            counts = np.array([len(p) for p in parts], np.int64)
            hashes = np.concatenate(parts) if parts else np.empty(0, np.uint64)
            fp = majority_bits(hashes, counts).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


#: Keys pack the set of fixed byte positions (8 bits) above up to five bytes.
TRIPLES = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]


def _key(fp, positions):
    key = F.lit(sum(1 << p for p in positions) << 40)
    for n, p in enumerate(positions):
        key = key.bitwiseOR(F.shiftleft(F.shiftright(fp, 8 * p).bitwiseAND(F.lit(255)), 8 * n))
    return key


def postings(groups: DataFrame) -> DataFrame:
    """groups(fp, rep) -> key, rep, fp: eight postings a fingerprint."""
    keys = F.array(*[_key(F.col("fp"), t) for t in TRIPLES])
    return groups.select(F.explode(keys).alias("key"), "rep", "fp")


def _narrower(key: int, reps: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The postings of a long list under keys one byte longer: any four of the free positions."""
    fixed = [p for p in range(8) if key >> 40 >> p & 1]
    octets = fps.view(np.uint8).reshape(-1, 8)
    keys = []
    for p in [p for p in range(8) if p not in fixed][:4]:
        base = (key & ((1 << 40) - 1)) | ((key >> 40 | 1 << p) << 40)
        keys.append(base | octets[:, p].astype(np.int64) << (8 * len(fixed)))
    return np.concatenate(keys), np.tile(reps, len(keys)), np.tile(fps, len(keys))


def list_links(keys: np.ndarray, reps: np.ndarray, fps: np.ndarray, max_bits: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links of complete posting lists sorted by (key, rep): tally, filter, verify."""
    alive, lefts, rights, d = np.arange(len(keys)), [], [], 1
    while True:
        alive = alive[alive + d < len(keys)]
        alive = alive[keys[alive] == keys[alive + d]]
        if not len(alive):
            break
        differ = fps[alive] ^ fps[alive + d]
        shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        near = (shared >= least) & (np.bitwise_count(differ) <= max_bits)
        lefts.append(alive[near])
        rights.append(alive[near] + d)
        d += 1
    if not lefts:
        return reps[:0], reps[:0]
    a, b, label = np.concatenate(lefts), np.concatenate(rights), np.arange(len(keys))
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
    while (label != label[label]).any():
        label = label[label]
    off = np.flatnonzero(label != np.arange(len(keys)))
    return reps[label[off]], reps[off]


def _lists(max_bits: int, least: int, split_above: int, chunk: int = 1 << 16):
    """Walk a partition sorted by (key, rep): links of the short lists; long ones go out again,
    in pieces of at most split_above rows, so memory doesn't depend on a list's length."""

    def out(key, a, b, fp):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.array(b), pa.array(fp)], ["key", "a", "b", "fp"])

    def relink(keys, reps, fps):
        a, b = list_links(keys, reps, fps, max_bits, least)
        zero = np.zeros(len(a), np.int64)
        return out(zero, a, b, zero)

    def repost(key, reps, fps):
        k, r, f = _narrower(int(key), reps, fps)
        return out(k, r, r, f)

    def run(batches):
        held, rows, long_key = [], 0, None
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            rows += batch.num_rows
            if rows < chunk:
                continue
            keys, reps, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.searchsorted(keys, keys[-1]))
            yield from complete(keys, reps, fps, last, long_key)
            if last:
                long_key = None
            tail = keys[last:], reps[last:], fps[last:]
            if can_split(keys[-1]) and (long_key == keys[-1] or len(tail[0]) > split_above):
                long_key = keys[-1]
                yield from pieces(*tail)
                tail = tail[0][:0], tail[1][:0], tail[2][:0]
            held, rows = [list(tail)], 0
        if held:
            keys, reps, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from complete(keys, reps, fps, len(keys), long_key)

    def can_split(key):
        return int(key >> 40).bit_count() < 5

    def pieces(keys, reps, fps):
        for i in range(0, len(keys), split_above):
            yield repost(keys[0], reps[i : i + split_above], fps[i : i + split_above])

    def complete(keys, reps, fps, end, long_key):
        keys, reps, fps = keys[:end], reps[:end], fps[:end]
        if not end:
            return
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(first, end))
        long = [i for i in np.flatnonzero((sizes > split_above) | (keys[first] == (long_key or 0))) if can_split(keys[first[i]])]
        for i in long:
            s = slice(first[i], first[i] + sizes[i])
            yield from pieces(keys[s], reps[s], fps[s])
        short = ~np.isin(np.arange(len(first)), long)
        rows = np.repeat(short, sizes)
        yield relink(keys[rows], reps[rows], fps[rows])

    return run


def near_links(groups: DataFrame, max_bits: int = 3, split_above: int = 1024) -> DataFrame:
    """groups(fp, rep), one row a fingerprint -> links a < b between representatives whose
    transitive closure is that of all pairs at ``max_bits`` or fewer differing bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the triple index guarantees pairs of up to three differing bits")
    found = None
    todo = postings(groups)
    while True:
        dealt = todo.repartition("key").sortWithinPartitions("key", "rep")
        done = cut(dealt.mapInArrow(_lists(max_bits, 8 - max_bits, split_above), "key long, a long, b long, fp long"))
        links = done.where("key = 0").select("a", "b")
        found = links if found is None else found.unionByName(links)
        todo = done.where("key <> 0").select("key", F.col("a").alias("rep"), "fp").distinct()
        if not done.where("key <> 0").take(1):
            return found


def simhash_groups(docs: DataFrame, width: int = 3, max_bits: int = 3, split_above: int = 1024) -> DataFrame:
    """One row per document: doc_id, fp, group_size (documents with that fingerprint), component_id.

    Null, empty and blank texts all have fingerprint zero and link like any other. A
    repeated doc_id gives a row for each of its rows; rows without an id join the component
    of an equal fingerprint, if an id has it, else they have none. An empty table gives no rows."""
    rows = cut(fingerprints(docs, width))
    groups = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("group_size")))
    roots = components(near_links(groups.where("rep IS NOT NULL"), max_bits, split_above))
    named = cut(
        groups.join(roots, groups.rep == roots.node, "left")
        .select("fp", "group_size", F.coalesce("root", "rep").alias("component_id"))
    )
    return attach(rows, named, "fp", "group_size")


def drop_near_copies(docs: DataFrame, width: int = 5, max_bits: int = 3) -> DataFrame:
    """docs with one row of each component of fingerprints, that of the smallest doc_id. Rows are
    told apart by more than their ids; those without an id come last."""

    def drop(rows: DataFrame) -> DataFrame:
        gone = cut(simhash_groups(rows, width, max_bits).where("doc_id <> component_id").select("doc_id").distinct())
        return join_ids(rows, gone, "doc_id", "left_anti").select(rows.columns)

    return by_row(docs, drop)


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size"
    )
