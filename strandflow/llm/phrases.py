"""Phrase collocations by contiguous pattern growth in projected occurrences.

Every phrase that is frequent begins with a frequent phrase, so phrases are grown to the right.
Words are counted first, then pairs of frequent words. What follows a frequent pair, as far as each
pair of neighbours is frequent too, is the pair's projection: up to three more words for each
occurrence, equal ones counted together before anything is moved. Sorted, the occurrences of a
prefix are one run of pointers, and so are those of each longer prefix within it: a task
takes a prefix's run, splits it by the next word, and goes on into each part that is frequent
before it turns to the next one.

Tasks own ranges of prefixes. Where a prefix has so many occurrences that its run goes on in
another task (or batch), both return their part of its count, whether frequent or not, and the
parts are added up, so no prefix has to fit into one task.

Words are told apart by 64-bit hashes of language and word. That no two words of the corpus share
one is checked on the whole vocabulary, and another seed is taken if they do. What is moved of a hash is its lower
40 bits if no frequent word shares those with any other word, else more of them. Which words and pairs
are frequent goes to the tasks as a table of a fixed number of bits: a bit that two share
makes some rows more, never a wrong count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, join_ids, table
from .simhash import LOWER

#: Bits of the tables of frequent words and pairs (4 MB).
TABLE_BITS = 25
#: Words of text a task holds at a time, and different words whose places it remembers.
CHUNK_WORDS, KNOWN_WORDS = 2_000_000, 200_000
#: The bytes that end a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"
_PIECES = bytes(ord(".") if c in ENDS else ord(" ") if c == 9 else LOWER[c] for c in range(256))


def pieces(text: bytes | None) -> list[bytes]:
    """The lower-cased words of a text, with b"." wherever a piece ends."""
    return (text or b"").translate(_PIECES).replace(b".", b" . ").split()


class Places(dict):
    """Places of one language's words in the list of hashes that all languages share."""

    def __init__(self, lang: bytes, hashes: list[int], words: list, seed: int, bits: int):
        super().__init__({b".": 0})
        self.lang, self.hashes, self.words, self.mask = lang, hashes, words, (1 << bits) - 1
        self.prefix = b"%d:%d:%b" % (seed, len(lang), lang)

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(self.prefix + word, 42) & self.mask)
        self.words.append((self.lang, word))
        return place


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def chunked(batches, seed: int, bits: int = 64, keep_words: bool = False):
    """(places, hashes, words): the words of many texts as places in ``hashes`` (the lower bits of them), place 0
    between texts and pieces."""
    langs, hashes, words, held, n = {}, [0], [None], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            places = langs.get(lang)
            if places is None:
                places = langs[lang] = Places(lang, hashes, words if keep_words else _Nothing(), seed, bits)
            found = pieces(text)
            held.append(np.fromiter(map(places.__getitem__, found), np.int64, len(found)))
            held.append(np.zeros(1, np.int64))
            n += len(found)
            if n >= CHUNK_WORDS or len(hashes) >= KNOWN_WORDS:
                yield np.concatenate(held), np.array(hashes, np.uint64), words
                held, n = [], 0
                if len(hashes) >= KNOWN_WORDS:
                    langs, hashes, words = {}, [0], [None]
    if held:
        yield np.concatenate(held), np.array(hashes, np.uint64), words


class _Nothing(list):
    def append(self, x):
        pass


def word_table(docs: DataFrame, seed: int) -> DataFrame:
    """h, lang, word, f: every word of every language, and how often it occurs."""

    def run(batches):
        for places, hashes, words in chunked(batches, seed, keep_words=True):
            f = np.bincount(places, minlength=len(hashes))
            f[0] = 0
            some = np.flatnonzero(f)
            own = [words[i] for i in some.tolist()]
            texts = [pa.array([x[k] for x in own], pa.binary()).cast(pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*texts, pa.array(f[some].astype(np.int64))], ["lang", "word", "f"])

    rows = _texts(docs).mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    # as Places hashes it: Spark's function is XXH64 with the seed 42
    h = F.xxhash64(F.concat(F.lit(f"{seed}:"), F.octet_length("lang").cast("string"), F.lit(":"), F.col("lang"), F.col("word")))
    return rows.select(h.alias("h"), "lang", "word", "f")


def counted_words(docs: DataFrame, tries: int = 20) -> tuple[DataFrame, int]:
    """word_table(), materialised, under the first seed with which each word has a hash of its own."""
    for seed in range(tries):
        words = cut(word_table(docs, seed))
        shared = words.groupBy("h").agg(F.count("*").alias("n")).where("n > 1 OR h = 0")
        if not shared.take(1):
            return words, seed
    raise ValueError("no seed tells all words apart")


def enough_bits(words: DataFrame, least: int) -> int:
    """How many lower bits of the hashes suffice to tell each frequent word from all other words."""
    for bits in (40, 48, 56):
        low = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
        shared = words.groupBy(low.alias("low")).agg(F.count("*").alias("n"), F.max("f").alias("most"))
        if not shared.where(((F.col("n") > 1) | (F.col("low") == 0)) & (F.col("most") >= least)).take(1):
            return bits
    return 64


def bit_table(rows: DataFrame, column: str) -> np.ndarray:
    """A table of 2 ** TABLE_BITS bits, as bytes, in which the bits of all values of the column are set."""
    at = F.col(column).bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    bits = rows.select(F.shiftright(at, 5).alias("at"), F.expr(f"SHIFTLEFT(1L, CAST({column} & 31 AS INT))").alias("bit"))
    found = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (TABLE_BITS - 5), np.uint32)
    out[found.column("at").to_numpy().astype(np.int64)] = found.column("bits").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def in_table(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = (values & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A number for each pair of hashes, which pairs may share."""
    with np.errstate(over="ignore"):
        return (first ^ (first >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + second


def pair_keys(pairs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            first, second = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(pair_key(first, second).view(np.int64))], ["key"])

    return pairs.select("h1", "h2").mapInArrow(run, "key long")


def pair_table(docs: DataFrame, frequent: np.ndarray, seed: int, bits: int) -> DataFrame:
    """h1, h2, f: neighbours of which both may be frequent."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for places, hashes, _ in chunked(batches, seed, bits):
            known = in_table(shared.value, hashes)
            known[0] = False
            near = known[places[:-1]] & known[places[1:]]
            keys, f = np.unique(places[:-1][near] << 32 | places[1:][near], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[keys >> 32].view(np.int64)), pa.array(hashes[keys & 0xFFFFFFFF].view(np.int64)), pa.array(f.astype(np.int64))], ["h1", "h2", "f"])

    return _texts(docs).mapInArrow(run, "h1 long, h2 long, f long").groupBy("h1", "h2").agg(F.sum("f").alias("f"))


def projections(docs: DataFrame, frequent: np.ndarray, pairs: np.ndarray, longest: int, seed: int, bits: int) -> DataFrame:
    """h1 .. hn (n = longest; zero beyond the end), f: what follows the occurrences of pairs that may be frequent,
    one word at least, as long as neighbours may be frequent pairs."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, pairs))
    names = [f"h{i + 1}" for i in range(longest)]

    def run(batches):
        for places, hashes, _ in chunked(batches, seed, bits):
            known = in_table(shared.value[0], hashes)
            known[0] = False
            h = np.where(known, hashes, np.uint64(0))[places]
            near = np.zeros(len(h) + longest, bool)
            near[: len(h) - 1] = (h[:-1] != 0) & (h[1:] != 0) & in_table(shared.value[1], pair_key(h[:-1], h[1:]))
            start = np.flatnonzero(near[: len(h)] & near[1 : len(h) + 1])
            places = np.append(places, np.zeros(longest, np.int64))
            columns, going = [places[start], places[start + 1], places[start + 2]], np.ones(len(start), bool)
            for k in range(3, longest):
                going &= near[start + k - 1]
                columns.append(np.where(going, places[start + k], 0))
            order = np.lexsort(columns[::-1])
            columns = [c[order] for c in columns]
            fresh = np.ones(len(order), bool)
            fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            head = np.flatnonzero(fresh)
            f = np.diff(np.append(head, len(order)))
            yield pa.RecordBatch.from_arrays([*(pa.array(hashes[c[head]].view(np.int64)) for c in columns), pa.array(f.astype(np.int64))], [*names, "f"])

    rows = _texts(docs).mapInArrow(run, ", ".join(f"{x} long" for x in [*names, "f"]))
    return rows.groupBy(*names).agg(F.sum("f").alias("f"))


def grow(columns: list[np.ndarray], f: np.ndarray, least: int):
    """Phrases of three words or more in sorted projections, with their counts: the frequent ones,
    and those at either edge, whose occurrences may go on in other rows.

    A prefix's pointers are rows [lo, hi); the recursion splits them by the word at ``depth``."""
    total = np.concatenate(([0], np.cumsum(f)))
    out = []

    def extend(lo: int, hi: int, depth: int) -> None:
        word = columns[depth][lo:hi]
        heads = lo + np.concatenate(([0], np.flatnonzero(word[1:] != word[:-1]) + 1))
        tails = np.append(heads[1:], hi)
        n = total[tails] - total[heads]
        keep = (columns[depth][heads] != 0) & ((n >= least) | (heads == 0) | (tails == len(f)))
        for a, b, count in zip(heads[keep].tolist(), tails[keep].tolist(), n[keep].tolist(), strict=True):
            if depth >= 2:
                out.append(([int(c[a]) for c in columns[: depth + 1]], count))
            if depth + 1 < len(columns):
                extend(a, b, depth + 1)

    if len(f):
        extend(0, len(f), 0)
    return out


def grown(projected: DataFrame, longest: int, least: int) -> DataFrame:
    """phrase (hashes), a: the frequent phrases of three words or more."""
    names = [f"h{i + 1}" for i in range(longest)]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            *columns, f = (batch.column(i).to_numpy() for i in range(longest + 1))
            found = grow(columns, f, least)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.list_(pa.int64())), pa.array([n for _, n in found], pa.int64())], ["phrase", "a"])

    dealt = projected.repartitionByRange(*names).sortWithinPartitions(*names)
    parts = dealt.mapInArrow(run, "phrase array<long>, a long")
    return parts.groupBy("phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """phrases(phrase, a) with lang, n and of its lowest-scoring cut (ties: the first) score, l and r.
    Products go through decimals of 38 digits."""
    parts = cut(phrases.unionByName(words.select(F.array("h").alias("phrase"), F.col("f").alias("a"))))
    named = phrases.withColumn("h", F.col("phrase")[0]).join(words.select("h", "lang"), "h")
    named = join_ids(named, totals, "lang", "inner")
    cuts = named.select("phrase", "lang", "a", "n", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("phrase", F.lit(1), F.col("k")), "right": F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k"))})
    cuts = cuts.join(parts.select(F.col("phrase").alias("left"), F.col("a").alias("l")), "left")
    cuts = cuts.join(parts.select(F.col("phrase").alias("right"), F.col("a").alias("r")), "right")
    score = F.expr("(1000 * CAST(a AS DECIMAL(14, 0)) * CAST(n AS DECIMAL(17, 0))) DIV (CAST(l AS DECIMAL(14, 0)) * CAST(r AS DECIMAL(14, 0)))")
    cuts = cuts.select("phrase", "lang", "a", "n", F.struct(score.cast("long").alias("score"), "k", "l", "r").alias("cut"))
    return cuts.groupBy("phrase", "lang", "a", "n").agg(F.min("cut").alias("cut")).select("phrase", "lang", "a", "n", "cut.score", "cut.l", "cut.r")


def absorbed(phrases: DataFrame, percent: int) -> DataFrame:
    """phrase: those that stand in a longer one with at least this share of their occurrences. A longer
    one that has it holds a phrase of just one word more that has it too."""
    inner = F.array(F.slice("phrase", F.lit(1), F.size("phrase") - 1), F.slice("phrase", F.lit(2), F.size("phrase") - 1))
    longer = phrases.where(F.size("phrase") > 2).select(F.explode(inner).alias("phrase"), F.col("a").alias("more"))
    longer = longer.groupBy("phrase").agg(F.max("more").alias("more"))
    return phrases.join(longer, "phrase").where(100 * F.col("more") >= percent * F.col("a")).select("phrase")


def best(rows: DataFrame, top: int) -> DataFrame:
    """Of each language the rows that are among the first ``top`` by score, then a; ties at the end all stay.
    Parts of a language are cut down first, so no task ranks all of its phrases."""
    order = [F.desc("score"), F.desc("a")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    rows = rows.withColumn("part", part).withColumn("place", F.rank().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    return rows.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top).drop("part", "place")


def mine(docs: DataFrame, longest: int = 5, least: int = 100, percent: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best collocations of 2 to ``longest`` words.

    a is how often the phrase occurs within pieces (``least`` times or more), l and r are the counts of
    the two parts of its weakest cut, n all words of its language, score = 1000 a n / (l r). Phrases with
    ``percent`` of their occurrences in a longer candidate go. A null language is ``und``; null
    and empty texts hold nothing; an empty table gives no rows."""
    if longest < 3:
        raise ValueError("phrases of up to three words at least")
    words, seed = counted_words(docs)
    totals = cut(words.groupBy("lang").agg(F.sum("f").alias("n")))
    bits = enough_bits(words, least)
    frequent = cut(words.where(F.col("f") >= least).withColumn("h", F.col("h").bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))))
    word_bits = bit_table(frequent, "h")
    pairs = cut(pair_table(docs, word_bits, seed, bits).where(F.col("f") >= least))
    pair_bits = bit_table(pair_keys(pairs), "key")
    longer = grown(cut(projections(docs, word_bits, pair_bits, longest, seed, bits)), longest, least)
    phrases = cut(longer.unionByName(pairs.select(F.array("h1", "h2").alias("phrase"), F.col("f").alias("a"))))
    kept = scored(phrases, frequent, totals).join(absorbed(phrases, percent), "phrase", "left_anti")
    kept = cut(best(kept, top))
    spelled = kept.select("phrase", F.posexplode("phrase").alias("at", "h")).join(frequent.select("h", "word"), "h")
    spelled = spelled.groupBy("phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("words"))
    rows = kept.join(spelled, "phrase").select("lang", F.col("words").alias("phrase"), "a", "l", "r", "n", "score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return rows.withColumn("rank", place.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM split GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
grams AS MATERIALIZED (
  SELECT lang, w[i:i + size - 1] AS g, count(*) AS f
  FROM starts JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS size) ON i + size - 1 <= len(w)
  GROUP BY ALL HAVING count(*) >= 100
),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM grams WHERE len(g) > 1) c
  JOIN grams l ON l.lang = c.lang AND l.g = c.g[1:k]
  JOIN grams r ON r.lang = c.lang AND r.g = c.g[k + 1:]
  JOIN totals t ON t.lang = c.lang
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT d.lang, unnest([d.g[1:len(d.g) - 1], d.g[2:]]) AS g, d.f FROM grams d WHERE len(d.g) > 2
),
kept AS (
  SELECT * FROM lowest c WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.g = c.g AND 100 * i.f >= 100 * c.a)
),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
         array_to_string(g, ' ') AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
  FROM kept
)
SELECT * FROM ranked WHERE rank <= 2000
"""
