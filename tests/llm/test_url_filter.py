import random

from strandflow.llm import url_filter as uf


def brute(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


def test_judging_matches_brute_force(spark):
    rng = random.Random(1)
    hosts = ["a.org", "org", "b.a.org", "xa.org", "com", "a.com", "c.b.a.org", "a.org.", "", "A.ORG"]
    paths = ["", "/", "/x", "/x/", "/x/y", "/xy", "/x//y", "//", "/é/z", "/x/y1/z"]
    urls = [None, "", "a.org/x", "://", "http://", "x://a.org://b/y", "http://a.org?x=/x", "http://a.org#/x"]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=1', '#f', '/' * 5000])}" for _ in range(400)]
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h in hosts[:7] for p in paths[1:] if rng.random() < 0.4}.values())
    rules += [("a.org", "/x", "allow"), ("a.org", "/x", "block")]
    pages = spark.createDataFrame([(i, u, "r", None) for i, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("q", None, "block")], "host string, path string, verdict string")
    best = {}
    for h, p, v in rules:
        if best.get((h, p)) != "block":
            best[h, p] = v
    rules = [(h, p, v) for (h, p), v in best.items()]
    for per_trie in (1000, 3):
        got = uf.judge_urls(pages, table, "block", per_trie).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: brute(u, rules, "block") for i, u in enumerate(urls)}


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")] * 2, "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in uf.judge_urls(pages, rules).collect()] == [(1, "a.org", "/", None, "allow")] * 2
    assert uf.judge_urls(pages.limit(0), rules).collect() == []
    assert uf.kept_urls(pages, rules).count() == 2
