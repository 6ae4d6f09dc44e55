"""Spelling variants: words one insertion, deletion or replacement apart, through two automata.

A word u is cut into halves. Of a word v one error away from it, the error lies either in v's
second half, so that v begins with u's first half, or in its first half, so that v ends with u's
second half. Two minimal acyclic automata answer both: one of the words, one of the words
spelled backwards. The exact half is walked, then the rest is completed with one error. Each
automaton numbers its words without gaps (the sum of the offsets on the way to a word is its
rank), so what is known of a word is kept in an array at its number and not in the automaton.

Only words that share the exact half can meet, so words are dealt to shards by that half, each
into at most two halves a direction (the lengths of its neighbours differ by one at most), and
each shard has automata of its own. A half that very many words share is dealt to several
shards, and the words that ask for it go to each of them, so no task holds more than
about a shard's words. Edits are made in one place only where several give the same word (the
last letter of a run goes, a letter is added at the end of its run), and the backward automaton
leaves out what begins with the exact first half, so every pair is found once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_ids, table
from .components import follow

#: Words that a shard's automaton holds, about.
SHARD_WORDS = 16_384
#: Words whose completion a task carries on side by side.
QUERIES = 2048
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, shortest: int = 6, least: int = 5, damage: int = 199) -> DataFrame:
    """word, n: words of at least ``shortest`` code points that stand in the texts ``least`` times or more.

    Words are runs of letters with A-Z lower-cased. Where ``damage`` divides h, the crc32 of
    ``<doc_id>:<run>``, the run's code point h modulo its length is left out (a null id is
    empty there). Null and empty texts hold no words."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rf"[A-Za-zÀ-ÿ]{{{shortest},}}"), 0)).alias("run"))
    ascii_only = F.octet_length("run") == F.char_length("run")
    lowered = F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    runs = runs.select("doc_id", lowered.alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    damaged = F.concat(F.left("run", at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % damage == 0, damaged).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after the other, and where each word begins (and the last ends)."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return points, np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; accept() paths add up to word numbers."""

    def __init__(self, words: list[str]):
        points, begin = spelled(words)
        self.alphabet, points = np.unique(points, return_inverse=True)
        size = np.diff(begin)
        # The trie, level by level; nodes of a level are numbered in the words' order.
        parent, letter, levels, final = [], [], [0, 1], [size[:1] * 0]
        live, node, depth = np.flatnonzero(size > 0), np.zeros(int((size > 0).sum()), np.int64), 0
        final[0] = np.array([int((size == 0).any())])
        while len(live):
            c = points[begin[live] + depth]
            fresh = np.concatenate(([True], (node[1:] != node[:-1]) | (c[1:] != c[:-1])))
            parent.append(node[fresh])
            letter.append(c[fresh])
            node = levels[-1] + np.cumsum(fresh) - 1
            ends = size[live] == depth + 1
            level = np.zeros(int(fresh.sum()), np.int64)
            level[node[ends] - levels[-1]] = 1
            final.append(level)
            levels.append(levels[-1] + len(level))
            live, node, depth = live[~ends], node[~ends], depth + 1
        final = np.concatenate(final)
        parent, letter = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (parent, letter))
        degree = np.bincount(parent, minlength=len(final))
        first = np.concatenate(([0], np.cumsum(degree)))  # edge k leads to node k + 1
        below, height = final.copy(), np.zeros(len(final), np.int64)
        for lo, hi in zip(levels[-3::-1], levels[-2:0:-1], strict=True):
            inner = lo + np.flatnonzero(degree[lo:hi])
            if len(inner):
                a, b = first[inner[0]], first[inner[-1] + 1]
                cuts = first[inner] - a
                below[inner] += np.add.reduceat(below[a + 1 : b + 1], cuts)
                height[inner] = np.maximum.reduceat(height[a + 1 : b + 1], cuts) + 1
        self._merge(final, letter, degree, first, below, height)

    def _merge(self, final, letter, degree, first, below, height) -> None:
        """Nodes with the same right language become one state, from the lowest on."""
        state = np.zeros(len(final), np.int64)
        keep, n_states = [], 0
        by_height = np.argsort(height, kind="stable")
        cuts = np.concatenate(([0], np.cumsum(np.bincount(height))))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            nodes = by_height[lo:hi]
            rows = np.repeat(np.arange(len(nodes)), degree[nodes])
            edges = np.arange(len(rows)) + np.repeat(first[nodes] - np.concatenate(([0], np.cumsum(degree[nodes])[:-1])), degree[nodes])
            for seed in range(1, 100):
                with np.errstate(over="ignore"):
                    mixed = ((letter[edges] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed)) ^ ((state[edges + 1] + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x165667B19E3779F9 + 2 * seed)
                    mixed ^= mixed >> np.uint64(32)
                    sums = final[nodes].astype(np.uint64)
                    np.add.at(sums, rows, mixed)
                _, head, own = np.unique(sums, return_index=True, return_inverse=True)
                twin = nodes[head][own]
                same = (degree[twin] == degree[nodes]).all() and (final[twin] == final[nodes]).all()
                if same:
                    other = edges + np.repeat(first[twin] - first[nodes], degree[nodes])
                    same = (letter[other] == letter[edges]).all() and (state[other + 1] == state[edges + 1]).all()
                if same:  # no two languages share a sum
                    break
            else:
                raise ValueError("no seed tells the states apart")
            state[nodes] = n_states + own
            keep.append(nodes[head])
            n_states += len(head)
        keep = np.concatenate(keep)
        self.start, self.final = int(state[0]), final[keep].astype(bool)
        self.degree = degree[keep]
        self.first = np.concatenate(([0], np.cumsum(self.degree)))
        edges = np.arange(self.first[-1]) + np.repeat(first[keep] - self.first[:-1], self.degree)
        self.letter, self.target = letter[edges], state[edges + 1]
        counts = below[edges + 1]
        passed = np.cumsum(counts) - counts
        own = np.repeat(np.arange(len(keep)), self.degree)
        self.offset = passed - passed[np.minimum(self.first[own], max(len(passed) - 1, 0))] + self.final[own]
        self.keys = own * len(self.alphabet) + self.letter

    def letters(self, points: np.ndarray) -> np.ndarray:
        """Code points as letters of the automaton, -1 for others."""
        if not len(self.alphabet):
            return np.full(len(points), -1, np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at, -1)

    def edge(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The edge from each state by each letter, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(state), -1, np.int64)
        key = state * len(self.alphabet) + letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (letter >= 0), at, -1)

    def accept(self, text, ends, q, at, state, number) -> tuple[np.ndarray, np.ndarray]:
        """Of the walks that stand at text[at] in state, those that end in a word exactly: q and number."""
        found = []
        while len(q):
            done = at == ends[q]
            hit = done & self.final[state]
            found.append((q[hit], number[hit]))
            q, at, state, number = (x[~done] for x in (q, at, state, number))
            e = self.edge(state, text[at])
            q, at, e, number = (x[e >= 0] for x in (q, at, e, number))
            at, state, number = at + 1, self.target[e], number + self.offset[e]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (q, number)

    def one_error(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word number): words that begin with the first ``exact`` code points of the
        query and differ from it by one insertion, deletion or replacement after them."""
        points, begin = spelled(words)
        text, ends = self.letters(points), begin[1:]
        same_next = np.concatenate((points[1:] == points[:-1], [False]))
        same_next[ends - 1] = False
        q, at = np.arange(len(words)), begin[:-1].copy()
        state, number = np.full(len(q), self.start), np.zeros(len(q), np.int64)
        walks = []
        while len(q):
            free = at >= begin[q] + exact[q]
            more = at < ends[q]
            gone = free & more
            gone[more] &= ~same_next[at[more]]
            walks.append((q[gone], at[gone] + 1, state[gone], number[gone]))
            n = np.where(free, self.degree[state], 0)
            rows = np.repeat(np.arange(len(q)), n)
            e = np.arange(len(rows)) + np.repeat(self.first[state] - (np.cumsum(n) - n), n)
            here = np.where(more, text[np.minimum(at, len(text) - 1)], -2)[rows]
            other = self.letter[e] != here
            rows, e = rows[other], e[other]
            step = q[rows], at[rows], self.target[e], number[rows] + self.offset[e]
            walks.append(step)  # a letter is added
            swap = more[rows]
            walks.append((step[0][swap], step[1][swap] + 1, step[2][swap], step[3][swap]))
            q, at, state, number = (x[more] for x in (q, at, state, number))
            e = self.edge(state, text[at])
            q, at, e, number = (x[e >= 0] for x in (q, at, e, number))
            at, state, number = at + 1, self.target[e], number + self.offset[e]
        if not walks:
            return q, number
        return self.accept(text, ends, *(np.concatenate(x) for x in zip(*walks, strict=True)))


def _shards(words: DataFrame, shortest: int, shard_words: int) -> DataFrame:
    """shard, asks, text, half, n: the rows that build each shard's automaton, then those that ask it."""
    size = F.char_length("word")
    sides = []
    for back, halved in ((0, F.floor), (1, F.ceil)):
        text = F.reverse("word") if back else F.col("word")
        halves = [halved((size + d) / 2).cast("int") for d in (0, -1, 1)]
        least = (shortest + back) // 2
        told = F.filter(F.array_distinct(F.array(*halves)), lambda h: (h >= least) & (h <= size))  # noqa: B023
        built = F.transform(told, lambda h: F.struct(h.alias("half"), F.lit(0).alias("asks")))
        roles = F.concat(built, F.array(F.struct(halves[0].alias("half"), F.lit(1).alias("asks"))))
        sides.append(words.select(text.alias("text"), "n", F.lit(back).alias("back"), F.inline(roles)))
    rows = sides[0].unionByName(sides[1])
    rows = rows.withColumn("key", F.xxhash64("back", "half", F.left("text", F.col("half"))))
    sizes = rows.where("asks = 0").groupBy("key").count().where(F.col("count") > shard_words)
    large = cut(sizes.select("key", F.ceil(F.col("count") / shard_words).cast("long").alias("parts")))
    n_shards = max(1, -(-4 * words.count() // shard_words))
    parts = F.coalesce("parts", F.lit(1))
    some = F.when(F.col("asks") == 1, F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("text"), parts)))
    rows = join_ids(rows, large, "key", "left").select("key", "back", "asks", "text", "half", "n", F.explode(some).alias("part"))
    shard = F.pmod(F.xxhash64("key", "part"), F.lit(n_shards)) * 2 + F.col("back")
    rows = rows.select(shard.alias("shard"), "asks", "text", "half", "n")
    return rows.repartition(min(2 * n_shards, 10_000), "shard").sortWithinPartitions("shard", "asks", "text")


def near_pairs(words: DataFrame, shortest: int = 6, shard_words: int = SHARD_WORDS) -> DataFrame:
    """words(word, n), distinct, of ``shortest`` code points or more -> word, n, near, near_n: every ordered
    pair that one inserted, deleted or replaced code point sets apart, once."""

    def run(batches):
        shard, told, automaton, asked = None, [], None, []

        def answers():
            nonlocal automaton, asked
            if not asked or not told:
                asked = []
                return
            if automaton is None:
                automaton = Automaton([t for t, _ in told])
            back = shard & 1
            for k in range(0, len(asked), QUERIES):
                some = asked[k : k + QUERIES]
                q, number = automaton.one_error([t for t, _, _ in some], np.array([h for _, h, _ in some], np.int64))
                out = []
                for i, j in zip(q.tolist(), number.tolist(), strict=True):
                    (text, half, n), (near, near_n) = some[i], told[j]
                    if not back:
                        out.append((text, n, near, near_n))
                    elif not near.endswith(text[half:]):
                        out.append((text[::-1], n, near[::-1], near_n))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["word", "n", "near", "near_n"])
            asked = []

        for batch in batches:
            for s, asks, text, half, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    yield from answers()
                    shard, told, automaton = s, [], None
                if asks:
                    asked.append((text, half, n))
                elif not told or told[-1][0] != text:
                    told.append((text, n))
            yield from answers()

    return _shards(words, shortest, shard_words).mapInArrow(run, "word string, n long, near string, near_n long")


def variants(words: DataFrame, shortest: int = 6, ratio: int = 5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """words(word, n), materialised and distinct -> word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that is
    at least ``ratio`` times its own n. n grows with each step to a form, so forms never run in a circle; root is
    where they end. An empty table gives no rows."""
    pairs = near_pairs(words, shortest, shard_words)
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    near = pairs.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    formed = -F.col("best.m") >= ratio * F.col("n")
    near = cut(near.select("word", "n_near", F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.m")).alias("form_n")))
    roots = follow(near.where("form IS NOT NULL").select(F.col("word").alias("node"), F.col("form").alias("root")))
    rows = words.join(near, "word", "left").join(roots.withColumnRenamed("node", "word"), "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(cut(word_counts(table(spark, sf_dir, "documents"))))


def _crc_sql() -> str:
    """The usual table of the reflected polynomial, by its rule, as an SQL list."""
    out = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        out.append(k)
    return str(out)


#: DuckDB's levenshtein counts bytes, so letters beyond ASCII stand as upper-case letters, digits and signs there.
OP11_SQL = rf"""
WITH RECURSIVE runs AS MATERIALIZED (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents
),
bytes AS (
  SELECT run, hex(encode(concat(doc_id, ':', run))) AS b FROM runs WHERE length(run) >= 6
),
hashed AS (
  SELECT run, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(b), 2), lambda i: ('0x' || b[i:i + 1])::BIGINT)),
    lambda c, x: xor(c >> 8, ({_crc_sql()}::BIGINT[])[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes
),
damaged AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed
),
words AS MATERIALIZED (SELECT word, count(*) AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
coded AS MATERIALIZED (
  SELECT word, n, length(word) AS size, translate(word, '{"".join(map(chr, range(0xC0, 0x100)))}', '{UPPER}0123456789!#$%&()*+,-./:;<=>?@[]^_`{{|}}~"') AS code FROM words
),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM coded a JOIN coded b ON b.size BETWEEN a.size - 1 AND a.size + 1
  WHERE levenshtein(a.code, b.code) = 1
),
best AS (
  SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word, n
),
forms AS (SELECT word, n_near, near AS form, near_n AS form_n FROM best WHERE near_n >= 5 * n),
steps AS (
  SELECT word, word AS last, 0 AS k FROM words
  UNION ALL
  SELECT s.word, f.form, s.k + 1 FROM steps s JOIN forms f ON f.word = s.last
),
roots AS (SELECT word, arg_max(last, k) AS root FROM steps GROUP BY word)
SELECT w.word, f.form, r.root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n
FROM words w JOIN roots r USING (word) LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word)
"""
