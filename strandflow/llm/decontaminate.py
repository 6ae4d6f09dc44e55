"""Benchmark decontamination by spaced-seed hashing.

Fixed masks of SPAN tokens each ignore some positions. Every window of a benchmark item
is hashed under every mask over the positions it keeps; the windows of the training
documents are hashed alike and joined to them by hash. Two texts that differ by a
substituted token still meet in the windows whose masks ignore it. Around each hit the
two texts are aligned without gaps and the best-scoring stretches (+1 a token that agrees,
-3 one that doesn't) are taken, so substitutions inside a passage are bridged. All
stretches of all alignments of an item add up to the item tokens a document covers.

The benchmark is the stated query set: it is read in slices of at most SLICE_TOKENS
tokens (plus one item), each broadcast and joined with all documents where they are
read, so documents are never shuffled. Where there are more slices than one, each is run,
written to the shared folder and dropped before the next is built, so memory doesn't grow
with either side.

Tokens are runs of letters and digits of the lower-cased text: ASCII punctuation and
white space separate, everything beyond ASCII counts as a letter.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, tokens
from .language_id import chunks

SPAN = 8
#: The kept positions of a window, one mask a line.
MASKS = (
    (0, 1, 2, 3, 4),
    (3, 4, 5, 6, 7),
    (0, 1, 3, 6, 7),
    (0, 2, 4, 5, 7),
    (0, 1, 4, 5, 6),
    (1, 2, 3, 6, 7),
)
#: Items of fewer tokens than SPAN must be found whole and unchanged; those below LEAST never match.
LEAST = 5
SLICE_TOKENS = 2_000_000
#: Pairs of windows that are laid out at a time; repeated tokens make many.
PAIRS = 1 << 20
#: Alignments of a text and an item that are looked into before the rest is sifted again.
TRIED = 64
_MUL = np.uint64(0x9E3779B97F4A7C15)

OVERLAP = "doc_id long, item_id long, matched int, item_tokens int, best int, doc_start int, item_start int, contaminated boolean"


class Slice(NamedTuple):
    items: np.ndarray  # item ids
    starts: np.ndarray  # of each item in tokens, with the end
    tokens: np.ndarray  # ids from 1
    words: dict[bytes, int]
    hashes: list[np.ndarray]  # one sorted array a mask
    places: list[np.ndarray]  # token index of each hash's window


def _masks() -> list[tuple[int, ...]]:
    """The spaced masks, then one whole mask for each length of short item."""
    return [*MASKS, *(tuple(range(n)) for n in range(LEAST, SPAN))]


def _hash(ids: np.ndarray, at: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for p in mask:
        h = (h ^ ids[at + p].astype(np.uint64)) * _MUL
        h ^= h >> np.uint64(31)
    return h


def build_slice(item_ids: list[int], texts: list[str | None]) -> Slice:
    words: dict[bytes, int] = {}
    parts = [np.array([words.setdefault(w, len(words) + 1) for w in tokens(t)], np.int32) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.concatenate([*parts, np.zeros(SPAN, np.int32)])
    hashes, places = [], []
    for k, mask in enumerate(_masks()):
        if k < len(MASKS):
            at = [np.arange(s, s + n - SPAN + 1) for s, n in zip(starts, sizes, strict=False) if n >= SPAN]
        else:
            at = [np.array([s]) for s, n in zip(starts, sizes, strict=False) if n == len(mask)]
        where = np.concatenate(at) if at else np.zeros(0, np.int64)
        h = _hash(flat, where, mask)
        order = np.argsort(h, kind="stable")
        hashes.append(h[order])
        places.append(where[order])
    return Slice(np.array(item_ids, np.int64), starts, flat[: starts[-1]], words, hashes, places)


def alignments(ids: np.ndarray, starts: np.ndarray, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (text, item, shift) of all window pairs whose hashes join, in that order.

    Pairs are laid out PAIRS at a time and give way to their alignments at once. Where a
    window recurs so often in one text and one item that the pairs outnumber the shifts there
    can be, the shifts are marked in place, so repeated tokens take memory for alignments only."""
    filled = ids > 0
    span = len(ids) + len(s.tokens) + 1  # of shifts
    held: list[np.ndarray] = []
    marked: dict[tuple[int, int], np.ndarray] = {}

    def text_of(at, mask):
        """A window begins before its text where its mask ignores the first positions."""
        return np.searchsorted(starts, at + mask[0], "right") - 1

    def note(doc, at, place):
        item = np.searchsorted(s.starts, place, "right") - 1
        shift = (at - starts[doc]) - (place - s.starts[item])
        held.append(np.unique((doc * len(s.items) + item) * span + shift + len(s.tokens)))
        if sum(map(len, held)) > 8 * PAIRS and len(held) > 1:
            held[:] = [np.unique(np.concatenate(held))]

    def mark(d, at, places):
        """All shifts of one window's places in one text, and in one item after another."""
        a = at - starts[d]
        run = a[-1] - a[0] + 1 == len(a)
        of_item = np.searchsorted(s.starts, places, "right") - 1
        for i in np.unique(of_item).tolist():
            n = int(s.starts[i + 1] - s.starts[i])
            if (d, i) not in marked:
                marked[d, i] = np.zeros(int(starts[d + 1] - starts[d]) + n, bool)
            line = marked[d, i]
            mine = places[of_item == i] - s.starts[i]
            if run:
                for p in mine.tolist():
                    line[a[0] - p + n : a[-1] - p + n + 1] = True
            elif len(mine) <= len(a):
                for p in mine.tolist():
                    line[a + (n - p)] = True
            else:
                for x in a.tolist():
                    line[x + n - mine] = True

    for mask, hashes, places in zip(_masks(), s.hashes, s.places, strict=True):
        if not len(hashes):
            continue
        n = len(ids) - SPAN
        ok = filled[mask[0] : mask[0] + n].copy()
        for p in mask[1:]:
            ok &= filled[p : p + n]
        at = np.flatnonzero(ok)
        h = _hash(ids, at, mask)
        lo = np.searchsorted(hashes, h, "left")
        found = lo < len(hashes)
        found[found] = hashes[lo[found]] == h[found]
        at, lo = at[found], lo[found]
        many = np.searchsorted(hashes, h[found], "right") - lo
        if many.sum() > PAIRS:
            doc = text_of(at, mask)
            order = np.lexsort((at, doc, lo))
            at, lo, many, doc = at[order], lo[order], many[order], doc[order]
            edge = np.flatnonzero((np.diff(lo, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
            size = np.diff(np.append(edge, len(at)))
            often = size * many[edge] > 1 << 16
            for e, k in zip(edge[often].tolist(), size[often].tolist(), strict=True):
                mark(int(doc[e]), at[e : e + k], places[lo[e] : lo[e] + many[e]])
            rest = np.repeat(~often, size)
            at, lo, many = at[rest], lo[rest], many[rest]
        total = np.cumsum(many)
        first = 0
        while first < len(at):
            before = int(total[first - 1]) if first else 0
            end = max(first + 1, int(np.searchsorted(total, before + PAIRS, "right")))
            own = many[first:end]
            nth = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            left = np.repeat(at[first:end], own)
            note(text_of(left, mask), left, places[np.repeat(lo[first:end], own) + nth])
            first = end
    for (d, i), line in marked.items():
        n = int(s.starts[i + 1] - s.starts[i])
        held.append((d * len(s.items) + i) * span + np.flatnonzero(line) - n + len(s.tokens))
    keys = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
    pair, shift = np.divmod(keys, span)
    return pair // max(len(s.items), 1), pair % max(len(s.items), 1), shift - len(s.tokens)


def _worth_a_look(body: np.ndarray, item: np.ndarray, shifts: np.ndarray, covered: np.ndarray, best: int) -> np.ndarray:
    """Of ascending shifts, those whose alignment has more agreeing tokens than ``best`` or
    agrees where nothing is covered yet; no other alignment can change what was found."""
    n = len(item)
    padded = np.concatenate([np.full(n, -1, body.dtype), body, np.full(n, -1, body.dtype)])
    keep = np.zeros(len(shifts), bool)
    step = max(1, PAIRS // n)
    rows = np.lib.stride_tricks.sliding_window_view(padded, n)
    for k in range(0, len(shifts), step):
        same = rows[shifts[k : k + step] + n] == item
        keep[k : k + step] = (same.sum(axis=1) > best) | (same & ~covered).any(axis=1)
    return shifts[keep]


def best_stretch(same: np.ndarray) -> tuple[int, int]:
    """[first, end) of the stretch with the largest score, the earliest of equals."""
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -3))))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    first = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return first, end


def stretches(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The best stretch, then those of what lies before and after it, and so on: all of at
    least ``least`` agreeing tokens."""
    out, todo = [], [(0, len(same))]
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        first, end = best_stretch(same[a:b])
        if first < end:
            if int(same[a + first : a + end].sum()) >= least:
                out.append((a + first, a + end))
            todo += [(a, a + first), (a + end, b)]
    return out


def overlaps(texts: list[str | None], s: Slice, least_matched: int, least_share: float) -> list[tuple]:
    """(text index, item, matched, item tokens, best, text start, item start, contaminated)."""
    get = s.words.get
    parts = [[get(w, 0) for w in tokens(t)] for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + SPAN)))
    ids = np.zeros(starts[-1] + SPAN, np.int32)
    for a, p in zip(starts, parts, strict=False):
        ids[a : a + len(p)] = p
    docs, items, shifts = alignments(ids, starts, s)
    heads = np.flatnonzero((np.diff(docs, prepend=-1) != 0) | (np.diff(items, prepend=-1) != 0))
    out = []
    for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(docs)], strict=False):
        d, i = int(docs[lo]), int(items[lo])
        n = int(s.starts[i + 1] - s.starts[i])
        body, mine = ids[starts[d] : starts[d] + sizes[d]], s.tokens[s.starts[i] : s.starts[i + 1]]
        covered, best = np.zeros(n, bool), (0, 0, 0)
        todo = shifts[lo:hi]
        while len(todo) and best[0] < n:  # once the whole item was found, later shifts only start later
            for shift in todo[:TRIED].tolist():
                a, b = max(0, -shift), min(n, len(body) - shift)
                same = body[a + shift : b + shift] == mine[a:b]
                for first, end in stretches(same, min(LEAST, n)):
                    got = int(same[first:end].sum())
                    covered[a + first : a + end] |= same[first:end]
                    best = max(best, (got, -(a + first + shift), -(a + first)))
            todo = todo[TRIED:]
            if len(todo):
                todo = _worth_a_look(body, mine, todo, covered, best[0])
        matched = int(covered.sum())
        if best[0]:
            whole = n < SPAN and matched == n
            out.append((d, int(s.items[i]), matched, n, best[0], -best[1], -best[2], bool(whole or n >= SPAN and (best[0] >= least_matched or matched >= max(LEAST, least_share * n)))))
    return out


def slices(benchmark: DataFrame, slice_tokens: int = SLICE_TOKENS):
    """The benchmark's items as bounded slices, one at a time on the driver. Items are told
    apart by their ids: different texts of one id are searched each, equal ones once."""
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = F.length("text") / 2 + 1  # a token has a character and a separator at least
    total = items.agg(F.sum(size)).first()[0] or 0
    n = int(total // slice_tokens) + 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        if rows:
            yield k == 0 and n == 1, build_slice([r.item_id for r in rows], [r.text for r in rows])


def find_overlaps(docs: DataFrame, benchmark: DataFrame, least_matched: int = 10, least_share: float = 0.8, slice_tokens: int = SLICE_TOKENS) -> DataFrame:
    """One row per document and item that share a verified stretch: how many item tokens are
    covered (matched), the longest stretch's agreeing tokens and where it starts (token
    positions from 0), and whether that makes the document contaminated: a stretch of
    ``least_matched`` agreeing tokens or ``least_share`` of the item. Null and empty texts
    and items give no rows, nor do empty tables; items below LEAST tokens never match. Rows
    that repeat or lack an id give rows of their own. Of equally long stretches the one that
    starts first counts."""
    found = docs.sparkSession.createDataFrame([], OVERLAP)
    for alone, part in slices(benchmark, slice_tokens):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches, shared=shared):
            s, types = shared.value, [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.bool_()]
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for sl in chunks(texts):
                    rows = [(ids[sl][r[0]], *r[1:]) for r in overlaps(texts[sl], s, least_matched, least_share)]
                    if rows:
                        names = [c.split()[0] for c in OVERLAP.split(", ")]
                        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, names)

        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        mine = own.mapInArrow(run, OVERLAP)
        if not alone:
            mine = cut(mine)
            shared.destroy()
        found = found.unionByName(mine)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least_matched: int = 10, least_share: float = 0.8) -> DataFrame:
    """docs without the contaminated ones; each text is tested where it is read. Null and empty
    texts stay, rows that repeat or lack an id are judged each, and an empty benchmark drops
    nothing."""
    for alone, part in slices(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches, shared=shared):
            s = shared.value
            for batch in batches:
                texts = batch.column("text").to_pylist()
                for sl in chunks(texts):
                    keep = np.ones(sl.stop - sl.start, bool)
                    keep[[r[0] for r in overlaps(texts[sl], s, least_matched, least_share) if r[-1]]] = False
                    yield batch.slice(sl.start, sl.stop - sl.start).filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        if not alone:
            docs = cut(docs)
            shared.destroy()
    return docs


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The contaminated documents with the items they hold; shorter overlaps are left out."""
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).where("contaminated")
