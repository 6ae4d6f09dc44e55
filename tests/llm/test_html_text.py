import html as h
import re
import time
from itertools import product

import numpy as np
import pytest

from strandflow.llm import crf, html_pages, html_text


@pytest.fixture(scope="module")
def extractor():
    return html_text.default_extractor()


def test_viterbi_matches_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(50):
        s, t = rng.normal(size=6), rng.normal(size=(2, 2))

        def score(path):
            return sum(s[i] * y for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:]))

        got = crf.viterbi_two(s.tolist(), t.tolist())
        assert abs(score(got) - max(map(score, product((0, 1), repeat=6)))) < 1e-9
    assert crf.viterbi_two([], ((0, 0), (0, 0))) == []


def test_held_out_pages(extractor):
    wrong = total = 0
    for page in html_pages.labelled_pages(150, seed=5):
        blocks, want = html_text.label_by_marks(page)
        wrong, total = wrong + sum(a != b for a, b in zip(extractor.labels(blocks), want)), total + len(want)
    assert wrong / total < 0.01


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = html_text.op9_html_text(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(source)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        want = " ".join(h.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())
        assert r.text == want and r.n_chars == len(want)


def test_odd_pages(spark, extractor):
    pages = {
        1: None, 2: "", 3: " <!-- x --> <script>var a='<p>no</p>'</script><style>p{}</style>",
        4: "<article><p>One &amp; two&nbsp;&#233; &lt;b&gt; f<b>oo</b>.<p>Three &quot;four&quot; five six seven.</article>",
        5: "<body><nav><a href=x>Menu entry</a></nav><article><h1>The title of it</h1><p>Body text that is long enough to read.</p>"
           "<div class='ad'>Buy this now.</div><section id=comments><div class=comment><p>I agree with this, really.</p></div></section>"
           "<form><label>Your mail</label></form></article><aside>Other things to read here</aside><footer>&copy; me</footer>",
        6: "<article>" + "<p>Some words stand here. " * 20_000, 7: "<div>" * 50_000 + "text", 8: "</p></div></x><article><p>a < b and <3 c > d in words.",
        9: "<article><p title='a>b'>Quoted attributes are no trouble here.</p><p title=\"open>Nor are open ones in the text.</p></article>",
    }
    frame = spark.createDataFrame([(i, "u", p, "z", 3) for i, p in pages.items()] + [(4, "u", pages[4], "z", 3)], "page_id long, url string, html string, text string, n_chars int")
    rows = html_text.extract_text(frame, extractor).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == len(pages) + 1 and all(r.n_chars == len(r.text) for r in rows)
    assert got[1] == got[2] == got[3] == ""
    assert got[4] == 'One & two é <b> foo. Three "four" five six seven.'
    assert got[5] == "The title of it Body text that is long enough to read."
    assert got[6] == " ".join(["Some words stand here."] * 20_000)
    assert got[8] == "a < b and <3 c > d in words."
    assert got[9].startswith("Quoted attributes are no trouble here.")
    assert html_text.extract_text(frame.limit(0), extractor).collect() == []
    assert html_text.page_blocks(frame.where("page_id = 5"), extractor).where("main").count() == 2


def test_layouts_the_generator_does_not_make(extractor):
    lines = [f"Sentence number {i} tells a bit more about the harbour and the old town." for i in range(6)]
    body, want = "".join(f"<p>{x}</p>" for x in lines), " ".join(lines)
    for page in (
        f"<body>{body}</body>", f"<div class='mw-parser-output'>{body}</div>", want, want.replace(". ", ".\n"), f"{body}<footer>Imprint</footer>",
        f"<body><article>{body}<div class='comments-area'><p>I like this text very much, thanks.</p></div></article></body>",
        f"<body><article>{body}<div id='reader-feedback'><p>I like this text very much, thanks.</p></div></article></body>",
        f"<div id='mw-content-text'><div class='mw-parser-output'>{body}</div></div><div id='mw-navigation'><ul><li><a href=x>Main page</a></li></ul></div>",
        f"<body><div class='top-bar'><a href=/>Home</a> <a href=/x>News</a></div><div class='story-wrap'>{body}</div><div class='bottom'><p>All rights reserved, 2020 The Paper.</p></div></body>",
    ):
        assert extractor.text(page) == want, page[:60]


def test_long_malformed_pages_take_linear_time(extractor):
    odd = ["<a " * 350_000, "<span>" * 80_000 + "<p>x</p>" * 80_000, "<p><div>" + "<span>" * 60_000 + "<p>x</p>" * 60_000, "<a \"'>" * 150_000,
           "<span>" * 80_000 + "x<br>" * 80_000, "<!--" * 250_000, "<svg>" * 200_000, "<x-a>" * 80_000 + "<p>y</p>" * 80_000, "<b '" * 250_000 + ">"]
    for page in odd:
        began = time.process_time()
        html_text.leaf_blocks(page)
        assert time.process_time() - began < 8, page[:20]
    assert extractor.text("<article><p>One line of text stands here.</p><!-- and <p>no more</p>") == "One line of text stands here."


def test_unseen_elements_end_where_they_end():
    def shown(page):
        return " ".join(b.text for b in html_text.leaf_blocks(page))

    for odd in ('<svg class="i"/>', "<svg class=icon />", '<svg a="x>y"><title>t</title><path d=""/></svg >', "<video-player src=a></video-player>", "<button-group></button-group>",
                "<select-menu/>", "<button>", "<select>", "<object>", "<svg>", "<button>x</button>", "<video src='a>b'>x</video>", "<title-x>", "<script>if (a<b) '<p>'</script>", "<style>a{}</style x>"):
        assert shown(f"<h1>a</h1>{odd}<p>Body text</p>") == "a Body text", odd
    assert shown("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p>") == "Let x=2 hold."
    for odd in ("<script>", "<style>", "<title>", "<textarea>", "<iframe>", "<noscript>"):
        assert shown(f"<h1>a</h1>{odd}<p>Body text</p>") == "a", odd
