"""Main-text extraction with a linear-chain CRF over the leaf blocks of a page.

A page is read as a sequence of leaf blocks: runs of text between block-level tags, with
scripts, styles, comments and other unseen content out. Each block is described by the
tags, classes, ids and roles of its ancestors and by its text (length, share of link
text, closing punctuation). A two-label CRF, trained on labelled pages that
html_pages.labelled_pages() composes, decides by Viterbi which blocks are main text.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .crf import forward_backward, pair_expectations, viterbi_two
from .language_id import chunks

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>",
    re.S | re.I,
)
#: Elements whose content isn't shown as text; the first kind runs to the page's end where it isn't closed.
TO_END = set("script style title textarea iframe noscript".split())
UNSEEN = TO_END | set("template svg object canvas select button audio video".split())
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in UNSEEN}
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")

#: HTML's void and inline elements, and what an open element of a kind ends.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
    "math semantics annotation maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table body html article section div td th".split())
LANDMARKS = SCOPES | set(SIBLINGS) | {"p"}

#: Names that ancestors' tags, classes, ids and roles are looked up in.
KNOWN_TAGS = set("nav header footer aside form article main section ul ol li dl table td blockquote pre figure figcaption h1 h2 h3 h4 h5 h6 p div body head menu address details dialog fieldset".split())
KNOWN_NAMES = set(
    "nav navigation navbar menu menubar header masthead banner top footer bottom contentinfo sidebar side aside complementary "
    "ad ads advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent gdpr notice alert warning message modal popup overlay "
    "comment comments commentary feedback reader readers review reviews opinions forum reply replies discussion disqus respond share sharing social follow related recommended recommendations more trending popular "
    "newsletter subscribe subscription signup login register form search breadcrumb breadcrumbs pagination pager paging tags tag meta byline author widget "
    "toolbar skip copyright legal article content contents post entry body main story text page container wrapper column col row inner paragraph caption".split()
)


class Block(NamedTuple):
    text: str
    tag: str
    path: frozenset  # names of all ancestors
    near: frozenset  # names of the innermost ancestor that structures the page
    link_share: float


#: Tags that structure a page even without a known class or id.
STRUCTURE = set("nav header footer aside form article main menu address dialog fieldset".split())


def _names(tag: str, attributes: str) -> set[str]:
    found = {f"<{tag}"} if tag in KNOWN_TAGS else set()
    if attributes and "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            found |= {f".{n}" for n in _NAME.findall((m[1] or m[2] or m[3] or "").lower()) if n in KNOWN_NAMES}
    return found


def leaf_blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks in order; text as shown, with white space collapsed."""
    out: list[Block] = []
    empty: frozenset = frozenset()
    stack: list[tuple[str, frozenset, frozenset, str]] = []  # tag, names above, names near, innermost block tag
    marks: list[int] = []  # places in the stack of the tags in LANDMARKS
    open_tags: dict[str, int] = {}
    parts: list[str] = []
    linked = total = at = 0

    def flush():
        nonlocal linked, total
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                above, near, tag = stack[-1][1:] if stack else (empty, empty, "")
                out.append(Block(text, tag, above, near, linked / max(total, 1)))
            parts.clear()
        linked = total = 0

    def pop():
        open_tags[stack[-1][0]] -= 1
        stack.pop()
        if marks and marks[-1] == len(stack):
            marks.pop()

    def add(piece: str):
        nonlocal linked, total
        if piece:
            parts.append(piece)
            total += len(piece)
            if open_tags.get("a"):
                linked += len(piece)

    page = page or ""
    last = page.rfind(">")  # no tag ends beyond it
    if (tail := page.find("<!--", last + 1)) >= 0:
        page = page[:tail]
    unclosed: set[str] = set()  # unseen elements that have no further end tag
    while at <= last and (m := _TOKEN.search(page, at, last + 1)):
        add(page[at : m.start()])
        at = m.end() if not m[0].startswith("<!--") or m[0].endswith("-->") else len(page)
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in UNSEEN and not closing:
            if tag == "svg" and attributes.endswith("/"):
                continue
            end = None if tag in unclosed else _END[tag].search(page, at)
            if end or tag in TO_END:
                at = end.end() if end else len(page)
                continue
            unclosed.add(tag)
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        if closing:
            if open_tags.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in SIBLINGS or tag not in INLINE:
            ends = SIBLINGS.get(tag, set()) | {"p"}
            nth = len(marks) - 1
            while nth >= 0 and stack[marks[nth]][0] not in ends and stack[marks[nth]][0] not in SCOPES:
                nth -= 1
            if nth >= 0 and stack[depth := marks[nth]][0] in ends:
                while len(stack) > depth:
                    pop()
        if not attributes.endswith("/") or tag not in INLINE:
            above, near, block = stack[-1][1:] if stack else (empty, empty, "")
            if own := _names(tag, attributes):
                if tag in STRUCTURE or len(own) > (tag in KNOWN_TAGS):
                    near = frozenset(f"near={x}" for x in own)
                above = above | own
            if tag in LANDMARKS:
                marks.append(len(stack))
            stack.append((tag, above, near, block if tag in INLINE else tag))
            open_tags[tag] = open_tags.get(tag, 0) + 1
    add(page[at:])
    flush()
    return out


def own_features(b: Block, first: bool, last: bool) -> list[str]:
    """Names of the features that a block has by its own text and place."""
    n = len(b.text)
    size = "tiny" if n < 20 else "short" if n < 80 else "middle" if n < 250 else "long"
    link = "none" if not b.link_share else "some" if b.link_share < 0.5 else "most"
    end = "stop" if b.text[-1] in ".!?…\"”»:" else "open"
    out = ["bias", f"size={size}", f"link={link}", f"end={end}", f"tag={b.tag}", f"{size}+{link}+{end}"]
    if "©" in b.text:
        out.append("sign=copyright")
    if first:
        out.append("at=first")
    if last:
        out.append("at=last")
    return out


def block_features(blocks: list[Block]) -> list[set[str]]:
    """Names of each block's features, ancestors' included."""
    end = len(blocks) - 1
    return [{*own_features(b, i == 0, i == end), *b.path, *b.near} for i, b in enumerate(blocks)]


class Extractor(NamedTuple):
    weights: dict[str, float]
    steps: tuple

    def labels(self, blocks: list[Block]) -> list[int]:
        get, end, scores, of_path = self.weights.get, len(blocks) - 1, [], {}
        for i, b in enumerate(blocks):
            key = (b.path, b.near)
            if key not in of_path:
                of_path[key] = sum(get(f, 0.0) for f in b.path) + sum(get(f, 0.0) for f in b.near)
            scores.append(of_path[key] + sum(get(f, 0.0) for f in own_features(b, i == 0, i == end)))
        return viterbi_two(scores, self.steps)

    def text(self, page: str | None) -> str:
        blocks = leaf_blocks(page)
        return " ".join(b.text for b, y in zip(blocks, self.labels(blocks), strict=True) if y)


def train_extractor(pages: list[tuple[list[Block], list[int]]], epochs: int = 150, rate: float = 0.2) -> Extractor:
    """Full-batch Adagrad on the conditional likelihood of the pages' labels."""
    named = [block_features(blocks) for blocks, _ in pages]
    index: dict[str, int] = {}
    for own in (f for page in named for f in page):
        for f in sorted(own):
            index.setdefault(f, len(index))
    length = max(map(len, named))
    real, gold = np.zeros((len(pages), length), bool), np.zeros((len(pages), length), np.int64)
    x = np.zeros((len(pages), length, len(index)), np.float32)
    for i, (page, (_, y)) in enumerate(zip(named, pages, strict=True)):
        real[i, : len(page)], gold[i, : len(page)] = True, y
        for j, own in enumerate(page):
            x[i, j, [index[f] for f in own]] = 1
    w, steps = np.zeros(len(index), np.float32), np.zeros((2, 2), np.float32)
    past, past_steps = np.full_like(w, 1e-6), np.full_like(steps, 1e-6)
    pairs = np.zeros((2, 2), np.float32)
    np.add.at(pairs, (gold[:, :-1][real[:, 1:]], gold[:, 1:][real[:, 1:]]), 1)
    for _ in range(epochs):
        s = x @ w
        probs, *rest = forward_backward(np.stack([np.zeros_like(s), s], axis=2), real, steps)
        grad = np.einsum("nlf,nl->f", x, (gold - probs[:, :, 1]) * real) / len(pages) - 1e-3 * w
        past += grad * grad
        w += rate * grad / np.sqrt(past)
        step = (pairs - pair_expectations(*rest, real)) / len(pages)
        past_steps += step * step
        steps += (rate * step / np.sqrt(past_steps)).astype(np.float32)
    return Extractor({f: float(w[i]) for f, i in index.items()}, tuple(map(tuple, steps.tolist())))


def default_extractor(n_pages: int = 700, seed: int = 11) -> Extractor:
    """Trained on composed pages; the same for every input."""
    from .html_pages import labelled_pages

    return train_extractor([label_by_marks(page) for page in labelled_pages(n_pages, seed)])


def label_by_marks(page: str) -> tuple[list[Block], list[int]]:
    """Blocks and labels of a page whose main text carries the mark U+E000 in every block."""
    blocks = leaf_blocks(page)
    return [b._replace(text=b.text.replace("", "")) for b in blocks], [int("" in b.text) for b in blocks]


TEXTS = "page_id long, url string, text string, n_chars long"


def extract_text(pages: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """One row per page: page_id, url, text (main blocks, joined by a blank), n_chars.

    Null, empty and textless pages have an empty text; repeated rows stay."""
    shared = pages.sparkSession.sparkContext.broadcast(extractor or default_extractor())

    def run(batches):
        e = shared.value
        for batch in batches:
            raw = batch.column(2).to_pylist()
            for part in chunks(raw):
                texts = [e.text(h) for h in raw[part]]
                own = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, TEXTS)


def page_blocks(pages: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """Every leaf block with its label: page_id, nth, tag, main, text."""
    shared = pages.sparkSession.sparkContext.broadcast(extractor or default_extractor())

    def run(batches):
        e = shared.value
        for batch in batches:
            for page_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks = leaf_blocks(raw)
                if blocks:
                    rows = [(page_id, i, b.tag, bool(y), b.text) for i, (b, y) in enumerate(zip(blocks, e.labels(blocks), strict=True))]
                    types = [pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "nth", "tag", "main", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, nth int, tag string, main boolean, text string")


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
