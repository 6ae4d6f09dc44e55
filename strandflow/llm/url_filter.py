"""URL filtering by a broadcast trie over reversed host labels and path segments.

A rule is a host and a path prefix with a verdict. It fits a url whose host is the rule's
or a subdomain of it and whose path starts with the rule's path. Of the rules that fit,
the longest (characters of host and path) decides, whatever its verdict; of equal rules
block wins. A url that no rule fits gets the default verdict.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Rules a broadcast trie holds; more rules make more tries, each tried where the urls are read.
RULES_PER_TRIE = 500_000
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)")
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without '://'."""
    found = _PARTS.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


class Trie:
    """Nodes are dicts: host labels from the last one, then None, then whole path segments.
    A node's rules hang under the empty tuple, by the beginning of the next segment."""

    ENDS = ()

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, start = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(self.ENDS, {})
            if ends.get(start, ("", ""))[1] != "block":
                ends[start] = (host + path, verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest fitting rule and its verdict."""
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            below = node.get(None)
            for segment in segments if below else ():
                for start, rule in below.get(self.ENDS, {}).items():
                    if segment.startswith(start) and (best is None or len(rule[0]) > len(best[0])):
                        best = rule
                below = below.get(segment)
                if not below:
                    break
        return best


def tries(rules: DataFrame, per_trie: int):
    """The rules (host, path, verdict) in bounded slices; null hosts, paths or verdicts are skipped."""
    known = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(F.lower("host").alias("host"), "path", "verdict")
    n = -(-known.count() // per_trie)
    for k in range(n):
        own = known.where(F.pmod(F.xxhash64("host", "path"), F.lit(n)) == k)
        yield Trie((r.host, r.path, r.verdict) for r in own.toLocalIterator())


JUDGED = "page_id long, host string, path string, rule string, verdict string"


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", per_trie: int = RULES_PER_TRIE) -> DataFrame:
    """One row per page: page_id, host, path, rule (host and path; null if none fits), verdict.

    A null url, or one without '://', has an empty host and path and gets the default.
    Rows that repeat stay; an empty rule table gives every url the default."""
    none = F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", none.alias("rule"), none.alias("verdict"))
    for part in tries(rules, per_trie):
        trie = pages.sparkSession.sparkContext.broadcast(part)

        def run(batches, trie=trie):
            t = trie.value
            for batch in batches:
                out = []
                for url, *had in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                    found = t.match(*split_url(url))
                    out.append(found if found and len(found[0]) > len(had[0] or "") else had)
                columns = [pa.array([r[i] for r in out], pa.string()) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], batch.schema.names)

        rows = rows.mapInArrow(run, "page_id long, url string, rule string, verdict string")

    def parts(batches):
        for batch in batches:
            split = [split_url(u) for u in batch.column(1).to_pylist()]
            host, path = (pa.array([s[i] for s in split], pa.string()) for i in range(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), host, path, batch.column(2), batch.column(3)], ["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(parts, JUDGED).fillna(default, ["verdict"])


def kept_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The judged pages that are allowed."""
    return judge_urls(pages, rules, default).where("verdict = 'allow'")


#: The contract's rules.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rhost, rpath, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), hits AS (
  SELECT host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(v, length(rhost || rpath)) AS v
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN hits USING (host, path)
"""
