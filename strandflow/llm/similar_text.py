"""Near-duplicates at a stated shingle similarity: SimHash first, then exact prefix filtering.

The byte-position index of simhash.py links the fingerprints that differ in at most three
bits, and the texts of those links are verified. Three of 64 bits only reach texts that are
all but equal (a pair just above 0.8 differs in about nine), so the pairs that are left are
found on the sets of word shingles themselves. Every text's distinct shingle hashes are put in one
order for all texts, common shingles last. Two sets of Jaccard similarity t share one of
the first n - ceil(t n) + 1 of each, so each text is posted under those only and every
similar pair meets in a posting list, wherever its edits are. Which shingles are common is
learned from a sample of texts; it decides how long lists get, never what is found.

Pairs of a list are tried in rounds. First every document meets one other, the smallest that
heads one of its lists. Lists whose rows verified links have joined by then are done with and
go; in the others pairs are tried with the first row, then with the nearest earlier rows, then
with all others, and pairs that are joined by then are left out. So a large family of copies
needs few pairs, and no pair that could be similar is left untried.
Before the exact Jaccard similarity of the two texts is taken, pairs go only by bounds that
hold for certain: by the sets' sizes and the places of the shared shingle, and by the
parities of the shingles that fall on each of 512 bits (each bit that differs is a shingle
that only one of the sets has), then by those on as many bits as the smaller set has shingles,
so that even texts of many thousand words are read only where they are likely to be similar.

Long posting lists are cut into blocks: each pair of blocks is compared by a task of its
own, so no task's memory or time depends on the length of a list and every pair of the
list still meets. Documents to which many others link have their shingle sets dealt to
several tasks.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, by_row, cut, join_ids
from .components import components
from .language_id import chunks
from .simhash import majority_bits, near_links, shingle_hashes

#: A document with more links than this has its shingles joined in several parts.
FAN = 1000
#: Texts whose shingles are counted: so many, or one in SAMPLE_SHARE where that is more.
SAMPLE_TEXTS, SAMPLE_SHARE = 10_000, 16
#: At most so many shingles that stand in three sampled texts are put last.
COMMON = 50_000
#: Bytes of text whose shingles a task holds at a time.
TEXT_BYTES = 1_000_000
#: Rows of the same list between the two of a pair, a round; the pairs with the first row come before.
ROUNDS = [(1, 8), (8, None)]

SKETCH = "doc_id long, fp long, f1 long, f2 long, n int, parity binary, wide binary, prefix array<long>"


def some_texts(batches, column: int):
    """Parts of batches whose texts together stay small, and these texts."""
    for batch in batches:
        texts = batch.column(column).cast(pa.binary()).to_pylist()
        for part in chunks(texts, TEXT_BYTES):
            yield batch.slice(part.start, part.stop - part.start), texts[part]


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, their places from the rarest on) of shingles that many sampled texts have."""

    def run(batches):
        for _, texts in some_texts(batches, 0):
            sets = [np.unique(shingle_hashes(t, width)) for t in texts]
            found, count = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(count.astype(np.int64))], ["h", "n"])

    share = min(1.0, max(SAMPLE_TEXTS / max(docs.count(), 1), 1 / SAMPLE_SHARE))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")
    counts = cut(drawn.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 3"))
    least = 3
    while counts.where(F.col("n") >= least).count() > COMMON:
        least *= 2
    rows = counts.where(F.col("n") >= least).toArrow()
    hashes, n = rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    hashes = hashes[np.lexsort((hashes, -n))]
    order = np.argsort(hashes)
    return hashes[order], (len(hashes) - order).astype(np.int64)


def in_order(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sorted hashes in the order of all texts: by hash, the common ones last by their places."""
    known, places = common
    if not len(known):
        return hashes
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    place = np.where(known[at] == hashes, places[at], 0)
    return hashes[np.argsort(place, kind="stable")]


def least_shared(total, similarity: float):
    """Shingles that two sets of so many in all share at least at this similarity."""
    return np.ceil(similarity * total - 1e-9).astype(np.int64)


def parities(hashes: np.ndarray, log_bits: int) -> np.ndarray:
    """As packed bits, whether an odd number of hashes falls on each of 2 ** log_bits places."""
    place = (hashes >> np.uint64(32) & np.uint64((1 << log_bits) - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=1 << log_bits) & 1)


def folded(bits: np.ndarray, n_bytes: int) -> np.ndarray:
    """Packed parities on fewer places."""
    return np.bitwise_xor.reduce(bits.reshape(-1, n_bytes), axis=0)


def sketches(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, fp (the SimHash), f1 and f2 (a digest of the shingle set), n (its size), its
    parities on 512 bits and on as many as it has shingles (at least 512; a power of two) and its prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, width))

    def run(batches):
        for batch, texts in some_texts(batches, 1):
            parts = [shingle_hashes(t, width) for t in texts]
            fp = majority_bits(np.concatenate(parts) if parts else np.empty(0, np.uint64), np.array([len(p) for p in parts], np.int64))
            sets = [np.unique(p) for p in parts]
            digests = np.array([[xxhash.xxh64_intdigest(s.tobytes(), seed) for seed in (1, 2)] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            wide = [parities(s, max(9, int(len(s) - 1).bit_length())) for s in sets]
            bits = [folded(w, 64) for w in wide]
            prefix = [in_order(s, shared.value)[: len(s) - int(least_shared(np.float64(len(s)), similarity)) + 1].view(np.int64) for s in sets]
            columns = [batch.column(0), pa.array(fp.view(np.int64)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([len(s) for s in sets], pa.int32()), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array([w.tobytes() for w in wide], pa.binary()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "f1", "f2", "n", "parity", "wide", "prefix"])

    return docs.mapInArrow(run, SKETCH)


def _whole_lists(rows: DataFrame, schema: str, chunk: int, keep_rows) -> DataFrame:
    """rows(key, rep, ...) sorted by key and rep, and of them what keep_rows says of the whole
    lists of a chunk; a list longer than a chunk is passed on whole."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < chunk:
                continue
            part = pa.Table.from_batches(held).combine_chunks()
            key = part.column("key").to_numpy()
            end = int(np.searchsorted(key, key[-1]))
            if end:
                yield from part.slice(0, end).filter(pa.array(keep_rows(part.slice(0, end)))).to_batches()
                held = part.slice(end).to_batches()
            elif n >= 2 * chunk:
                yield from part.slice(0, n - 1).to_batches()
                held = part.slice(n - 1).to_batches()
            n = sum(b.num_rows for b in held)
        if held:
            part = pa.Table.from_batches(held).combine_chunks()
            yield from part.filter(pa.array(keep_rows(part))).to_batches()

    return rows.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(run, schema)


def mixed_lists(lists: DataFrame, roots: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """The rows of lists(key, rep, n, at) whose list has rows of more than one root, with their root."""

    def keep(part):
        key, root = part.column("key").to_numpy(), part.column("root").to_numpy()
        edge = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        size = np.diff(np.append(edge, len(key)))
        return np.repeat(np.minimum.reduceat(root, edge) != np.maximum.reduceat(root, edge), size)

    known = roots.select(F.col("node").alias("rep"), "root")
    rows = join_ids(lists.select("key", "rep", "n", "at"), known, "rep", "left")
    rows = rows.select("key", "rep", "n", "at", F.coalesce("root", "rep").alias("root"))
    return _whole_lists(rows, "key long, rep long, n int, at int, root long", chunk, keep)


def head_links(lists: DataFrame, similarity: float) -> DataFrame:
    """lists, materialised by posting_lists() -> b and a: of the rows that head the lists of b and
    may be similar to it, the smallest. Lists lie together in their partitions, so only
    the links move."""

    def run(batches):
        key, head, n_head, at_head = None, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, reps, n, at = (batch.column(i).to_numpy().astype(np.int64) for i in range(4))
            fresh = np.flatnonzero(np.diff(keys, prepend=keys[:1] - (keys[0] != key)))
            heads = np.concatenate(([-1], fresh))[np.searchsorted(fresh, np.arange(len(keys)), "right")]
            first = [np.where(heads < 0, old, x[heads]) for old, x in ((head, reps), (n_head, n), (at_head, at))]
            key, head, n_head, at_head = keys[-1], first[0][-1], first[1][-1], first[2][-1]
            least = least_shared((n + first[1]).astype(float), similarity / (1 + similarity))
            near = (first[0] != reps) & (np.minimum(n - at, first[1] - first[2]) + np.minimum(at, first[2]) >= least)
            yield pa.RecordBatch.from_arrays([pa.array(first[0][near]), pa.array(reps[near])], ["a", "b"])

    return lists.mapInArrow(run, "a long, b long").groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def posting_lists(groups: DataFrame) -> DataFrame:
    """groups(rep, n, prefix) -> key, rep, n, at (the key's place in the set) of lists of two rows or more."""
    names = ["key", "rep", "n", "at"]

    def run(batches):
        held, known = None, False  # the last row, and whether the row before has its key
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            keys = rows.column("key").to_numpy()
            same = keys[1:] == keys[:-1]
            keep = np.concatenate(([known], same)) | np.concatenate((same, [False]))
            yield from rows.slice(0, rows.num_rows - 1).filter(pa.array(keep[:-1])).combine_chunks().to_batches()
            known = bool(same[-1]) if len(same) else known
            held = rows.slice(rows.num_rows - 1)
        if held is not None and known:
            yield from held.to_batches()

    posted = groups.select("rep", "n", F.posexplode("prefix").alias("at", "key")).select(*names)
    return posted.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(run, "key long, rep long, n int, at int")


def cells(lists: DataFrame, block: int, *carried: str) -> DataFrame:
    """lists(key, rep, ...) -> key, pair, rep and what is carried: a list of up to ``block`` rows is one cell. The rows of
    a longer one fall into blocks by a hash, and a cell holds the rows of two blocks."""
    sizes = lists.groupBy("key").count().where(F.col("count") > block)
    long = cut(sizes.select("key", F.ceil(F.col("count") / block).cast("long").alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("rep"), blocks)
    others = F.sequence(F.lit(0).cast("long"), blocks - 1)
    pairs = F.transform(others, lambda j: F.least(own, j).bitwiseOR(F.shiftleft(F.greatest(own, j), 31)))
    return join_ids(lists, long, "key", "left").select("key", F.explode(pairs).alias("pair"), "rep", *carried)


def row_pairs(lists: np.ndarray, root: np.ndarray, possible, span) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of one list and two roots that possible(a, b) keeps. span None: each row with
    the first of its list; else with the earlier ones but the first, at a distance in [span)."""
    index = np.arange(len(lists))
    first = np.searchsorted(lists, lists) if len(lists) else index

    def tried(a, b):
        other = root[a] != root[b]
        a, b = a[other], b[other]
        keep = possible(a, b)
        return a[keep], b[keep]

    if span is None:
        return tried(first, index)
    found, d, alive = [], span[0], index
    while span[1] is None or d < span[1]:
        alive = alive[alive + d < len(lists)]
        alive = alive[(lists[alive] == lists[alive + d])]
        if not len(alive):
            break
        met = first[alive] == alive
        found.append(tried(alive[~met], alive[~met] + d))
        d += 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (index[:0], index[:0])


def bounded_pairs(n: np.ndarray, at: np.ndarray, parity: np.ndarray, similarity: float):
    """possible(a, b) by the sets' sizes, the places of the shared shingle and the parities."""

    def possible(a, b):
        total = n[a] + n[b]
        least = least_shared(total.astype(float), similarity / (1 + similarity))
        keep = np.minimum(at[a], at[b]) + np.minimum(n[a] - at[a], n[b] - at[b]) >= least
        near = np.flatnonzero(keep)
        bits = np.bitwise_count(parity[a[near]] ^ parity[b[near]]).sum(axis=1, dtype=np.int64)
        keep[near] = bits <= (total - 2 * least)[near]
        return keep

    return possible


def candidate_links(dealt: DataFrame, bounds, span, chunk: int = 1 << 16) -> DataFrame:
    """Cells (key, pair, rep, root, carried ...) of lists -> the distinct pairs a < b of representatives
    of one round. bounds(*carried columns) -> possible(a, b); binary columns come as rows of words of 64 bits."""

    def run(batches):
        held, rows = [], 0

        def links(parts):
            key, pair, reps, root, *own = parts
            lists = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))))
            a, b = row_pairs(lists, root, bounds(*own), span)
            return pa.RecordBatch.from_arrays([pa.array(reps[a]), pa.array(reps[b])], ["a", "b"])

        def column(c):
            if pa.types.is_binary(c.type):
                return np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1)
            return c.to_numpy(zero_copy_only=False).astype(np.int64)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([column(c) for c in batch.columns])
            rows += batch.num_rows
            if rows >= chunk:
                parts = [np.concatenate(x) for x in zip(*held, strict=True)]
                ends = np.flatnonzero((parts[0][1:] != parts[0][:-1]) | (parts[1][1:] != parts[1][:-1]))
                last = int(ends[-1]) + 1 if len(ends) else 0  # the last list may go on
                if last:
                    yield links([x[:last] for x in parts])
                held, rows = [[x[last:] for x in parts]], 0
        if held and len(held[0][0]):
            yield links([np.concatenate(x) for x in zip(*held, strict=True)])

    return dealt.repartition("key", "pair").sortWithinPartitions("key", "pair", "rep").mapInArrow(run, "a long, b long").distinct()


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, shingles: sorted distinct hashes of a text's word shingles."""

    def run(batches):
        kind = pa.list_(pa.int64())
        for batch, texts in some_texts(batches, 1):
            sets = [np.sort(np.unique(shingle_hashes(t, width)).view(np.int64)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, kind)], ["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles array<long>")


def verified(docs: DataFrame, links: DataFrame, width: int, similarity: float) -> DataFrame:
    """The links (a, b) whose texts' shingle sets have at least this Jaccard similarity."""
    ids = cut(links.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = cut(shingle_sets(join_ids(own, ids, "doc_id", "inner").select("doc_id", "text"), width))
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    fan = links.groupBy("a").count().where(F.col("count") > FAN)
    fan = cut(fan.select("a", F.ceil(F.col("count") / FAN).cast("long").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = join_ids(links, fan, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).alias("part"))
    left = join_ids(left, fan, "a", "left").select("a", "sa", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    num, den = Fraction(str(similarity)).as_integer_ratio()
    both = dealt.join(left, ["a", "part"]).join(right, "b").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            sa, sb = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = sa[i].values.to_numpy(), sb[i].values.to_numpy()
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                shared = int((y[at] == x).sum()) if len(y) else 0
                keep[i] = den * shared >= num * (len(x) + len(y) - shared)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def fingerprint_links(reps: DataFrame) -> DataFrame:
    """a, b: rows of one fingerprint, linked to the first of them, and the fingerprints that the
    byte-position index of simhash.py links."""
    groups = cut(reps.groupBy("fp").agg(F.min("rep").alias("first"), F.count("*").alias("size")))
    equal = attach(reps.select("rep", "fp"), groups.where("size > 1"), "fp", "size").where("rep <> first")
    near = near_links(groups.select("fp", F.col("first").alias("rep")))
    return cut(equal.select(F.col("first").alias("a"), F.col("rep").alias("b")).unionByName(near.select("a", "b")).distinct())


def similar_roots(docs: DataFrame, width: int = 5, similarity: float = 0.8, block: int = 8192) -> DataFrame:
    """node, root: documents that aren't the smallest of their similarity component, and that
    smallest one. Texts of one shingle set are linked to the first of them."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    rows = cut(sketches(docs, width, similarity))
    groups = cut(rows.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")))
    same = attach(rows.select("doc_id", "f1", "f2"), groups.where("size > 1"), ["f1", "f2"], "size").where("doc_id <> rep")
    same = cut(same.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct())
    reps = join_ids(rows, cut(same.select(F.col("b").alias("doc_id"))), "doc_id", "left_anti").withColumnRenamed("doc_id", "rep")
    lists = cut(posting_lists(reps.where("n > 0").select("rep", "n", "prefix")))
    good = cut(same.unionByName(verified(docs, fingerprint_links(reps.where("n > 0").select("rep", "fp")), width, similarity)))
    roots = components(good)
    heads = _possible(_apart(head_links(lists, similarity), roots), reps, similarity)
    parity = reps.select("rep", "parity")
    good = cut(good.unionByName(verified(docs, cut(heads), width, similarity)))
    roots = components(good)
    for span in (None, *ROUNDS):
        lists = cut(mixed_lists(lists, roots))
        if not lists.take(1):
            break
        ids = cut(lists.select("rep").distinct())
        dealt = cells(lists.join(join_ids(parity, ids, "rep", "inner"), "rep"), block, "root", "n", "at", "parity")
        bounds = lambda n, at, parity: bounded_pairs(n, at, parity, similarity)
        links = cut(_possible(candidate_links(dealt, bounds, span), reps, similarity))
        if links.take(1):
            good = cut(good.unionByName(verified(docs, links, width, similarity)))
            roots = components(good)
    return roots


def _possible(links: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """The links whose parities don't rule them out."""

    def run(batches):
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            n_a, n_b = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 4))
            spare = n_a + n_b - 2 * least_shared((n_a + n_b).astype(float), similarity / (1 + similarity))
            near = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                x, y = (np.frombuffer(w, np.uint8) for w in (x, y))
                least = min(len(x), len(y))
                near[i] = int(np.bitwise_count(folded(x, least) ^ folded(y, least)).sum()) <= spare[i]
            yield batch.select([0, 1]).filter(pa.array(near))

    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"p{x}"))
    both = links.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "pa", "nb", "pb")
    return both.mapInArrow(run, "a long, b long")


def _apart(links: DataFrame, roots: DataFrame) -> DataFrame:
    """The links whose ends aren't joined yet."""
    at_a, at_b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    both = links.join(at_a, "a", "left").join(at_b, "b", "left")
    return both.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def drop_similar(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row, that of the smallest id, of each similarity component. Rows are told
    apart by more than their ids; those without an id come last. Null, empty and blank texts
    are alike. A text of fewer words than a shingle is its own shingle. An empty table gives
    no rows."""

    def drop(rows: DataFrame) -> DataFrame:
        gone = cut(similar_roots(rows, width, similarity).select(F.col("node").alias("doc_id")).distinct())
        return join_ids(rows, gone, "doc_id", "left_anti").select(rows.columns)

    return by_row(docs, drop)
