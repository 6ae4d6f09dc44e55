"""Labelled training pages: composed from layouts of menus, articles and everything around them.

Every text block of the main article carries the mark U+E000; nothing else does. Layouts
differ in whether they use semantic tags or classes, in what stands inside the article
without belonging to it, and in how sloppy the markup is.
"""

from __future__ import annotations

import random

MARK = ""
_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo zu".split()


def _word(rng):
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))


def _sentence(rng, low=3, high=14):
    words = " ".join(_word(rng) for _ in range(rng.randint(low, high)))
    return words.capitalize() + rng.choice([".", ".", ".", "!", "?", ""])


def _prose(rng, marked, most=6):
    text = " ".join(_sentence(rng, *rng.choice([(1, 3), (3, 14), (5, 20)])) for _ in range(rng.randint(1, most)))
    return (MARK if marked else "") + text


def _list(rng, n=None, links=True):
    items = [_word(rng) if rng.random() < 0.7 else _sentence(rng, 1, 5) for _ in range(n or rng.randint(1, 8))]
    return "<ul>" + "".join(f'<li><a href="/{x}">{x}</a></li>' if links else f"<li>{x}</li>" for x in items) + "</ul>"


def _box(rng, names, body, tags=("div", "section", "aside")):
    tag, name = rng.choice(tags), rng.choice(names)
    attribute = rng.choice(["class", "class", "id"])
    return f'<{tag} {attribute}="{name}">{body}</{tag}>'


def _around(rng, kind):
    """A block that isn't main text."""
    if kind == "menu":
        inner = _list(rng)
        return rng.choice([f"<nav>{inner}</nav>", _box(rng, ["menu", "navbar", "main-menu", "navigation"], inner, ("div", "ul")), f'<div role="navigation">{inner}</div>'])
    if kind == "header":
        inner = f"<h2>{_sentence(rng, 1, 4)}</h2>" * (rng.random() < 0.5) + (f"<p>{_sentence(rng)}</p>" if rng.random() < 0.5 else _list(rng))
        return rng.choice([f"<header>{inner}</header>", _box(rng, ["header", "site-header", "masthead", "banner"], inner, ("div",))])
    if kind == "footer":
        inner = rng.choice([f"&copy; {_word(rng)}.example &middot; {_sentence(rng)}", f"<p>{_prose(rng, False, 2)}</p>", _list(rng)])
        return rng.choice([f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", _box(rng, ["footer", "site-footer", "copyright", "legal"], inner, ("div",))])
    if kind == "side":
        inner = f"<h3>{_sentence(rng, 1, 4)}</h3>" + rng.choice([_list(rng), f"<p>{_prose(rng, False, 3)}</p>"])
        return rng.choice([f"<aside>{inner}</aside>", _box(rng, ["sidebar", "side", "widget", "related", "recommended", "trending"], inner)])
    if kind == "notice":
        return _box(rng, ["cookie-notice", "cookie", "consent", "notice", "alert", "gdpr", "message", "popup", "modal"], rng.choice([_prose(rng, False, 3), f"<p>{_prose(rng, False, 2)}</p>"]), ("div", "section"))
    if kind == "ad":
        return _box(rng, ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "ad-slot"], rng.choice([_prose(rng, False, 4), f"<p>{_prose(rng, False, 2)}</p>"]), ("div", "div", "aside"))
    if kind == "form":
        inner = f"<label>{_sentence(rng, 1, 4)}</label><input name=q>" + f"<p>{_prose(rng, False, 2)}</p>" * (rng.random() < 0.5)
        return rng.choice([f"<form>{inner}</form>", _box(rng, ["newsletter", "subscribe", "signup", "search", "login"], f"<form>{inner}</form>"), _box(rng, ["newsletter", "subscribe"], f"<p>{_prose(rng, False, 2)}</p>", ("div",))])
    if kind == "comments":
        each = "".join(f'<{t} class="comment"><p>{_prose(rng, False, 4)}</p></{t}>' for t in [rng.choice(["div", "li", "article"])] * rng.randint(1, 4))
        return _box(rng, ["comments", "comment-list", "comments-area", "discussion", "replies", "respond", "feedback", "reader-feedback", "reviews"], f"<h3>{_sentence(rng, 1, 3)}</h3>" * (rng.random() < 0.5) + each, ("div", "section", "ol"))
    inner = rng.choice([_list(rng, 3), f"<p>{_sentence(rng, 1, 5)}</p>"])
    return _box(rng, ["share", "social", "breadcrumb", "breadcrumbs", "pagination", "tags", "byline", "meta", "toolbar"], inner, ("div", "ul", "section"))


KINDS = ["menu", "header", "footer", "side", "notice", "ad", "form", "comments", "small"]


def _inline(rng, text):
    if rng.random() < 0.4:
        cut = rng.randrange(len(text))
        tag = rng.choice(['a href="/x"', "b", "em", "span", "code"])
        text = f"{text[:cut]}<{tag}>{text[cut:]}</{tag.split()[0]}>" if rng.random() < 0.7 else f"<{tag}>{text}</{tag.split()[0]}>"
    return text


def _article(rng):
    parts = []
    if rng.random() < 0.8:
        title = f"<h1>{MARK}{_sentence(rng, 1, 10)}</h1>"
        parts.append(f"<header>{title}</header>" if rng.random() < 0.1 else title)
    for _ in range(rng.randint(1, 9)):
        kind = rng.random()
        if kind < 0.7:
            end = "" if rng.random() < 0.15 else "</p>"
            parts.append(f"<p>{_inline(rng, _prose(rng, True))}{end}")
        elif kind < 0.76:
            parts.append(f"<h2>{MARK}{_sentence(rng, 1, 6)}</h2>")
        elif kind < 0.82:
            parts.append(rng.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(f"<li>{_prose(rng, True, 2)}</li>" for _ in range(rng.randint(1, 4)))))
        elif kind < 0.86:
            parts.append(f"<blockquote>{_prose(rng, True)}</blockquote>")
        elif kind < 0.9:
            parts.append("<table>" + "".join(f"<tr><td>{MARK}{_word(rng)}</td><td>{_prose(rng, True, 1)}</td></tr>" for _ in range(2)) + "</table>")
        elif kind < 0.93:
            parts.append(f"<pre>{_prose(rng, True)}</pre>")
        else:
            parts.append(f"<p><b>{_prose(rng, True, 2)}<br><p>{_prose(rng, True)}</p>")
    for _ in range(rng.choice([0, 0, 1, 1, 2])):
        parts.insert(rng.randint(1, len(parts)), _around(rng, rng.choice(["ad", "side", "form", "small", "comments", "notice"])))
    body = "".join(parts)
    return rng.choice([
        f"<article>{body}</article>", f"<article>{body}</article>", f"<main><article>{body}</article></main>", f"<main>{body}</main>",
        f'<div class="{rng.choice(["article", "post", "entry-content", "content", "story", "main-content"])}">{body}</div>',
        f'<div id="{rng.choice(["content", "main", "article-body", "post"])}">{body}</div>', f"<div>{body}</div>",
        body, f'<div class="{_word(rng)}">{body}</div>', f'<div class="{_word(rng)}"><div id="{_word(rng)}">{body}</div></div>',
    ])


def labelled_page(rng: random.Random) -> str:
    if rng.random() < 0.03:  # text without any markup, or paragraphs alone
        return rng.choice([_prose(rng, True, 12), "".join(f"<p>{_prose(rng, True)}</p>" for _ in range(rng.randint(1, 5)))])
    before = [_around(rng, k) for k in rng.sample(["menu", "header", "notice", "ad", "side", "small", "form"], rng.randint(0, 4))]
    after = [_around(rng, k) for k in rng.sample(["comments", "side", "ad", "form", "small", "notice", "menu"], rng.randint(0, 3))]
    if rng.random() < 0.9:
        after.append(_around(rng, "footer"))
    head = f"<head><title>{_sentence(rng)}</title></head>" if rng.random() < 0.8 else ""
    return f"<html>{head}<body>{''.join(before)}{_article(rng)}{''.join(after)}</body></html>"


def labelled_pages(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [labelled_page(rng) for _ in range(n)]
