"""Main text of web pages: flat text blocks and a decision tree over their neighbourhood."""

from __future__ import annotations

import functools
import html
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

#: Elements by the way they're treated.
SILENT = (
    "script", "style", "noscript", "template", "textarea", "select", "button", "iframe", "object", "svg", "canvas", "head", "title",
)
#: Those of them that hold no elements, so only their own end tag or the page's end closes them.
RAW = (
    "script", "style", "noscript", "textarea", "iframe", "title",
)
#: Elements around an article, article elements, blocks, and elements without an end tag.
BOILER = (
    "nav", "footer", "aside", "form", "menu", "dialog",
)
ARTICLE = (
    "article", "main",
)
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
VOID = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
)
#: Words of class, id and role that mark what surrounds an article.
HINTS = (
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar",
    "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "sidebar", "complementary", "contentinfo", "comment", "comments", "commentlist",
    "reply", "replies", "respond", "disqus", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal",
    "newsletter", "subscribe", "subscription", "signup", "login", "search", "share", "sharing", "social", "related", "recommended", "recommendations",
    "widget", "toc", "pagination", "pager", "skip", "masthead", "disclaimer", "form", "dialog",
)
#: Words that a name ends in without telling what it holds: the word before them does.
HOLDERS = (
    "area", "bar", "block", "body", "bottom", "box", "buttons", "col", "column", "container", "group", "header", "inner", "items", "left", "links", "list", "outer", "panel",
    "posts", "right", "row", "section", "slot", "stories", "top", "unit", "wrap", "wrapper",
)
#: Words that mark what readers wrote.
ANSWERS = (
    "comment", "comments", "commentlist", "reply", "replies", "respond", "disqus",
)
#: Words of class, id and role that mark the article itself: one of the first, or one of the second with one of the third.
BODY = (
    "main", "article",
)
BODY_OF = (
    "article", "entry", "post", "story", "page", "blog", "news",
)
BODY_PART = (
    "content", "body", "text",
)
_HOLDERS, _ANSWERS, _BODY, _BODY_OF, _BODY_PART = map(frozenset, (HOLDERS, ANSWERS, BODY, BODY_OF, BODY_PART))
_SILENT, _BOILER, _ARTICLE, _BLOCKS, _VOID, _HINTS = map(frozenset, (SILENT, BOILER, ARTICLE, BLOCKS, VOID, HINTS))
#: Attributes: quotes count where a value begins, and nowhere else.
_REST = r"(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+"
#: A tag that the page's end cuts off.
_CUT = re.compile(r"<[a-zA-Z/!][^>]*\Z")
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW)})(?=[\s/>]){_REST}>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s>/]*)({_REST})>|<[!?/][^>]*>|[^<]+|<",
    re.S | re.I,
)
#: Silent elements that hold others: they end where their end tag stands, if there is one.
_HUSHED = frozenset(SILENT) - frozenset(RAW) - {"head"}
_END = re.compile(rf"</({'|'.join(sorted(_HUSHED))})(?=[\s/>])", re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: Words at which a word count stops telling blocks apart.
MOST_WORDS = 60


def _is_body(named: set[str]) -> bool:
    return bool(named & _BODY) or "content" in named and len(named) == 1 or bool(named & _BODY_OF and named & _BODY_PART)


def telling(name: str) -> str:
    """The word that tells what a class or id names: its last one, words for mere boxes apart. A share-price is a price, an ad-box an advert."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    while len(words) > 1 and words[-1] in _HOLDERS:
        words.pop()
    return words[-1] if words else ""


def blocks(page: str) -> list[tuple[str, int, float, int, int]]:
    """Flat text blocks in page order: (text, words, link density, hint, heading).

    hint: what the nearest element that says so is by its kind or name: 1 an article, -1 something around one, 0 neither.
    """
    out: list[tuple[str, int, float, int, int]] = []
    stack: list[tuple[str, int]] = []  # element, and the hint inside it (-2: by the element itself, or what readers wrote)
    text: list[str] = []
    linked: list[str] = []
    link, heading, silent = 0, 0, ""
    last_end = {m.group(1).lower(): m.start() for m in _END.finditer(page)}

    def close() -> None:
        nonlocal text, linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                n = words.count(" ") + 1
                of = len("".join(linked).split())
                out.append((words, n, min(1.0, of / n), max(-1, stack[-1][1]) if stack else 0, heading))
        text, linked = [], []

    cut = _CUT.search(page, page.rfind(">") + 1)
    for m in _TOKEN.finditer(page[: cut.start()] if cut else page):
        token = m.group(0)
        if token[0] != "<" or token == "<":
            if not silent:
                token = html.unescape(token)
                text.append(token)
                if link:
                    linked.append(token)
            continue
        if m.group(3) is None:
            if m.group(1) and not silent:
                text.append(" ")
            continue
        name, ending, attributes = m.group(3).lower(), bool(m.group(2)), m.group(4)
        if silent and silent != "head":
            if ending and name == silent:
                silent = ""
            continue
        if name == "head":
            silent = "" if ending else name
            continue
        if silent and name != "body":
            continue
        silent = ""
        if name in _HUSHED:
            if not ending and not attributes.endswith("/") and last_end.get(name, -1) > m.start():
                silent = name
            text.append(" ")
            continue
        if name == "a":
            link = 0 if ending else 1
            linked.append(" ")
        elif name == "br":
            text.append("\n")
        if name not in _BLOCKS or name in _VOID:
            if name == "hr":
                close()
            continue
        close()
        if name == "p":
            heading = 0
            if ending or not _NAMED.search(attributes):
                while stack and stack[-1][0] == "p":
                    stack.pop()
                continue
        if re.fullmatch("h[1-6]", name):
            heading = 0 if ending else 1
        if ending:
            if any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        while stack and stack[-1][0] == "p":  # a block ends an open paragraph
            stack.pop()
        hint = stack[-1][1] if stack else 0
        names = [n for g in _NAMED.findall(attributes) for n in "".join(g).lower().split()]
        told, named = {telling(n) for n in names}, {w for n in names for w in re.split(r"[^a-z]+", n) if w}
        answer = named & _ANSWERS and name not in ("body", "html", "main") and (name != "article" or any(x[0] in _ARTICLE for x in stack))
        around = bool(told & _HINTS) and name not in ("body", "html", *ARTICLE) or "header" in told and hint < 1
        if name in _BOILER or name == "header" and hint < 1 or answer or _HIDDEN.search(attributes):
            hint = -2
        elif hint > -2:
            if name in _ARTICLE or name in ("div", "section") and _is_body(named) and not around:
                hint = 1  # a page's wrapper may be named after its sidebar
            elif around:
                hint = -1
        stack.append((name, hint))
    close()
    return out


#: Words of other blocks beyond which it doesn't matter how many there are.
MOST_AROUND = 120
FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "heading", "words in better places", "words in worse places")


def describe(found: list[tuple[str, int, float, int, int]]) -> np.ndarray:
    """One row of ``FEATURES`` for each block.

    Hints count by how much text there is with a better or worse one than a block's own, links apart: on a page
    without an article element, or whose text stands under an odd name, length and links of blocks decide alone.
    """
    n = np.array([[min(b[1], MOST_WORDS), b[2]] for b in found], dtype=float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    hint, heading = (np.array([b[i] for b in found], dtype=float) for i in (3, 4))
    own = np.array([b[1] * (1 - b[2]) for b in found], dtype=float)
    sums = {h: own[hint == h].sum() for h in (-1, 0, 1)}
    better = np.array([sum(v for k, v in sums.items() if k > h) for h in hint]).reshape(-1)
    worse = np.array([sum(v for k, v in sums.items() if k < h) for h in hint]).reshape(-1)
    return np.concatenate([n, np.concatenate([edge, n])[:-1], np.concatenate([n, edge])[1:], heading[:, None], np.minimum(better, MOST_AROUND)[:, None], np.minimum(worse, MOST_AROUND)[:, None]], axis=1)


#: The labelled table, pages of blocks as read and judged by hand:
#: words, link density, in an article by element or name, marked as surroundings, heading, and 1 for main text.
PAGES = (
    # news with an article element: menu, advert and footer around it, an advert, a form and comments inside
    ((1, 1.0, 0, 1, 0, 0), (1, 1.0, 0, 1, 0, 0), (2, 1.0, 0, 1, 0, 0), (8, 0.0, 0, 1, 0, 0), (9, 0.0, 1, 0, 1, 1), (60, 0.0, 1, 0, 0, 1), (1, 0.0, 1, 0, 0, 1), (22, 0.1, 1, 0, 0, 1), (3, 1.0, 1, 0, 0, 1), (4, 0.0, 1, 1, 0, 0),
     (45, 0.0, 1, 0, 0, 1), (2, 0.0, 1, 0, 0, 1), (1, 0.0, 1, 0, 0, 1), (3, 0.0, 1, 1, 1, 0), (30, 0.0, 1, 1, 0, 0), (60, 0.1, 1, 1, 0, 0),
     (2, 1.0, 1, 1, 0, 0), (1, 1.0, 1, 1, 0, 0), (12, 0.6, 1, 1, 0, 0), (30, 0.5, 1, 1, 0, 0), (14, 0.2, 0, 1, 0, 0)),
    # an article amid boxes that nothing marks: teasers, an advert, a notice
    ((1, 1.0, 0, 0, 0, 0), (3, 1.0, 0, 0, 0, 0), (12, 0.0, 0, 0, 0, 0), (40, 0.0, 0, 0, 0, 0), (4, 0.0, 0, 0, 1, 0), (26, 0.0, 0, 0, 0, 0), (5, 0.0, 1, 0, 1, 1), (18, 0.0, 1, 0, 0, 1), (60, 0.2, 1, 0, 0, 1), (7, 0.0, 1, 0, 0, 1),
     (9, 0.0, 0, 0, 0, 0), (35, 0.1, 0, 0, 0, 0), (3, 0.0, 0, 0, 1, 0), (60, 0.0, 0, 0, 0, 0), (2, 0.5, 0, 0, 0, 0)),
    # a list of links as an article, then a marked list of links
    ((6, 0.0, 1, 0, 1, 1), (2, 1.0, 1, 0, 0, 1), (4, 1.0, 1, 0, 0, 1), (9, 0.7, 1, 0, 0, 1), (1, 1.0, 1, 0, 0, 1), (5, 1.0, 0, 1, 0, 0), (5, 1.0, 0, 1, 0, 0), (16, 0.9, 0, 1, 0, 0)),
    # an article with links of their own among its texts
    ((1, 1.0, 0, 1, 0, 0), (4, 1.0, 1, 0, 0, 1), (12, 0.0, 1, 0, 0, 1), (5, 1.0, 1, 0, 0, 1), (60, 0.0, 1, 0, 0, 1), (3, 0.9, 1, 0, 0, 1), (3, 0.0, 1, 0, 0, 1), (6, 0.0, 1, 0, 1, 1), (30, 0.0, 1, 0, 0, 1), (8, 0.2, 0, 1, 0, 0)),
    # an article that ends in a list of links to others, which nothing marks
    ((2, 1.0, 0, 1, 0, 0), (9, 0.0, 1, 0, 1, 1), (40, 0.0, 1, 0, 0, 1), (33, 0.0, 1, 0, 0, 1), (55, 0.1, 1, 0, 0, 1), (6, 1.0, 1, 0, 0, 0), (7, 1.0, 1, 0, 0, 0), (5, 1.0, 1, 0, 0, 0), (8, 1.0, 1, 0, 0, 0), (11, 0.3, 0, 1, 0, 0)),
    # a page whose text stands under a name like those of boxes
    ((2, 1.0, 0, 0, 0, 0), (1, 1.0, 0, 0, 0, 0), (5, 0.0, 0, 1, 1, 1), (48, 0.0, 0, 1, 0, 1), (27, 0.0, 0, 1, 0, 1), (4, 0.0, 0, 1, 0, 1), (60, 0.1, 0, 1, 0, 1), (3, 1.0, 0, 1, 0, 0), (4, 1.0, 0, 1, 0, 0)),
    # articles of a few words and nothing around them, or no markup at all
    ((1, 0.0, 1, 0, 0, 1),),
    ((2, 0.0, 1, 0, 0, 1),),
    ((5, 0.0, 0, 0, 0, 1),),
    ((1, 0.0, 1, 0, 0, 1), (2, 0.0, 1, 0, 0, 1)),
    ((50, 0.0, 1, 0, 0, 1), (6, 0.0, 1, 0, 0, 1)),
    ((5, 0.0, 1, 0, 0, 1), (1, 0.0, 1, 0, 0, 1)),
    ((3, 0.0, 1, 0, 0, 1), (8, 0.0, 1, 0, 0, 1), (2, 0.0, 1, 0, 0, 1)),
    # a text and a last line, in an article and without any; a text between boxes of links
    ((50, 0.0, 1, 0, 0, 1), (5, 0.0, 1, 0, 0, 1)),
    ((55, 0.0, 0, 0, 0, 1), (6, 0.0, 0, 0, 0, 1)),
    ((38, 0.0, 1, 0, 0, 1), (4, 0.0, 1, 0, 0, 1), (29, 0.0, 1, 0, 0, 1)),
    ((2, 1.0, 0, 0, 0, 0), (1, 0.0, 0, 0, 1, 1), (28, 0.0, 0, 0, 0, 1), (2, 0.0, 0, 0, 0, 1), (28, 0.0, 0, 0, 0, 1), (3, 1.0, 0, 0, 0, 0)),
    ((3, 1.0, 0, 0, 0, 0), (34, 0.0, 0, 0, 0, 1), (60, 0.1, 0, 0, 0, 1), (4, 1.0, 0, 0, 0, 0), (6, 1.0, 0, 0, 0, 0)),
    ((2, 1.0, 0, 1, 0, 0), (2, 0.0, 0, 0, 1, 1), (31, 0.0, 0, 0, 0, 1), (3, 0.0, 0, 0, 0, 1), (25, 0.0, 0, 0, 0, 1), (4, 1.0, 0, 0, 0, 0)),
    # short lines at the start, in the middle and at the end of articles
    ((1, 1.0, 0, 1, 0, 0), (1, 1.0, 0, 1, 0, 0), (2, 0.0, 0, 1, 0, 0), (9, 0.0, 1, 0, 1, 1), (2, 0.0, 1, 0, 0, 1), (28, 0.0, 1, 0, 0, 1), (5, 0.0, 1, 0, 0, 1), (60, 0.0, 1, 0, 0, 1), (7, 0.0, 1, 0, 0, 1), (3, 0.0, 1, 0, 0, 1), (12, 0.0, 0, 1, 0, 0)),
    ((1, 1.0, 0, 1, 0, 0), (16, 0.0, 0, 1, 0, 0), (10, 0.0, 1, 0, 1, 1), (60, 0.0, 1, 0, 0, 1), (2, 0.0, 1, 0, 0, 1), (2, 0.0, 1, 0, 0, 1), (8, 0.0, 1, 0, 0, 1), (60, 0.0, 1, 0, 0, 1), (2, 0.0, 1, 0, 0, 1), (11, 0.0, 0, 1, 0, 0)),
    ((1, 1.0, 0, 1, 0, 0), (5, 0.0, 0, 1, 0, 0), (2, 0.0, 1, 0, 1, 1), (2, 0.0, 1, 0, 0, 1), (6, 0.0, 1, 0, 0, 1), (14, 0.0, 0, 1, 0, 0)),
    # an article of one line, of two short ones, of a heading and a line
    ((1, 1.0, 0, 1, 0, 0), (1, 0.0, 1, 0, 0, 1), (7, 0.0, 0, 1, 0, 0)),
    ((1, 1.0, 0, 1, 0, 0), (2, 1.0, 0, 1, 0, 0), (8, 0.0, 0, 1, 0, 0), (4, 0.0, 1, 0, 1, 1), (1, 0.0, 1, 0, 0, 1), (13, 0.0, 0, 1, 0, 0)),
    ((1, 1.0, 0, 1, 0, 0), (1, 1.0, 0, 1, 0, 0), (3, 0.0, 0, 1, 0, 0), (12, 0.0, 1, 0, 1, 1), (3, 0.0, 1, 0, 0, 1), (2, 0.0, 1, 0, 0, 1), (9, 0.0, 0, 1, 0, 0)),
    ((2, 1.0, 0, 1, 0, 0), (14, 0.0, 0, 1, 0, 0), (2, 0.0, 1, 0, 1, 1), (60, 0.0, 1, 0, 0, 1), (1, 0.0, 1, 0, 0, 1), (60, 0.0, 1, 0, 0, 1), (11, 0.0, 0, 1, 0, 0)),
    # a blog without an article element: menu, heading, text, a short line between texts, related links, copyright
    ((1, 1.0, 0, 0, 0, 0), (1, 1.0, 0, 0, 0, 0), (2, 1.0, 0, 0, 0, 0), (6, 0.0, 0, 0, 1, 1), (60, 0.0, 0, 0, 0, 1), (35, 0.1, 0, 0, 0, 1), (3, 0.0, 0, 0, 0, 1), (50, 0.0, 0, 0, 0, 1), (4, 1.0, 0, 0, 0, 0), (6, 1.0, 0, 0, 0, 0), (9, 0.8, 0, 0, 0, 0), (6, 0.0, 0, 0, 0, 0)),
    # an advert between menu and heading; a footer with a link after the text
    ((1, 1.0, 0, 0, 0, 0), (8, 0.0, 0, 0, 0, 0), (7, 0.0, 0, 0, 1, 1), (28, 0.0, 0, 0, 0, 1), (2, 0.0, 0, 0, 0, 1), (28, 0.0, 0, 0, 0, 1), (16, 0.0, 0, 0, 0, 1), (12, 0.4, 0, 0, 0, 0), (3, 0.7, 0, 0, 0, 0)),
    # an advert, then straight the text; a share line and a signature after it
    ((5, 1.0, 0, 0, 0, 0), (9, 0.0, 0, 0, 0, 0), (1, 1.0, 0, 0, 0, 0), (60, 0.0, 0, 0, 0, 1), (60, 0.1, 0, 0, 0, 1), (5, 0.6, 0, 0, 0, 0), (2, 0.0, 0, 0, 0, 0)),
    # a manual: sections with lists between texts; a heading over links at the end
    ((3, 0.0, 0, 0, 1, 1), (18, 0.0, 0, 0, 0, 1), (5, 0.0, 0, 0, 0, 1), (7, 0.0, 0, 0, 0, 1), (25, 0.0, 0, 0, 0, 1), (2, 0.0, 0, 0, 1, 1), (15, 0.2, 0, 0, 0, 1), (40, 0.0, 0, 0, 0, 1), (3, 0.0, 0, 0, 1, 0), (2, 1.0, 0, 0, 0, 0), (3, 1.0, 0, 0, 0, 0)),
    # short headings over texts, a line between two of them
    ((2, 1.0, 0, 0, 0, 0), (1, 0.0, 0, 0, 1, 1), (26, 0.0, 0, 0, 0, 1), (2, 0.0, 0, 0, 0, 1), (31, 0.0, 0, 0, 0, 1), (3, 1.0, 0, 0, 0, 0)),
    ((1, 0.0, 0, 0, 1, 1), (20, 0.0, 0, 0, 0, 1), (33, 0.0, 0, 0, 0, 1), (1, 1.0, 0, 0, 0, 0)),
    # a front page: headings over links, teasers full of links, no text of its own
    ((2, 0.0, 0, 0, 1, 0), (6, 1.0, 0, 0, 0, 0), (16, 0.6, 0, 0, 0, 0), (30, 0.5, 0, 0, 0, 0), (2, 0.0, 0, 0, 1, 0), (8, 1.0, 0, 0, 0, 0), (60, 0.6, 0, 0, 0, 0), (4, 0.0, 0, 0, 0, 0), (5, 1.0, 0, 0, 0, 0)),
    # text without an article element and marked boxes of any length around it
    ((30, 0.0, 0, 1, 0, 0), (5, 0.0, 0, 1, 1, 0), (8, 0.0, 0, 0, 1, 1), (24, 0.0, 0, 0, 0, 1), (60, 0.0, 0, 0, 0, 1), (60, 0.0, 0, 1, 0, 0), (14, 0.0, 0, 1, 0, 0), (20, 0.0, 0, 0, 0, 1), (3, 0.0, 0, 1, 0, 0), (40, 0.0, 0, 1, 0, 0)),
    # a story: short and long paragraphs in turn, a list of shops after it
    ((1, 1.0, 0, 0, 0, 0), (1, 1.0, 0, 0, 0, 0), (5, 0.0, 0, 0, 1, 1), (44, 0.0, 0, 0, 0, 1), (9, 0.0, 0, 0, 0, 1), (12, 0.0, 0, 0, 0, 1), (31, 0.0, 0, 0, 0, 1), (6, 0.0, 0, 0, 0, 1), (4, 0.0, 0, 0, 0, 1), (10, 0.0, 0, 0, 0, 1),
     (60, 0.0, 0, 0, 0, 1), (11, 0.0, 0, 0, 0, 1), (13, 0.0, 0, 0, 0, 1), (1, 1.0, 0, 0, 0, 0), (2, 1.0, 0, 0, 0, 0), (1, 1.0, 0, 0, 0, 0)),
    # a letter: a short opening after the heading, a licence line at its end, marked boxes before and after
    ((3, 0.0, 0, 1, 0, 0), (14, 0.0, 0, 1, 0, 0), (7, 0.0, 0, 0, 1, 1), (8, 0.0, 0, 0, 0, 1), (37, 0.0, 0, 0, 0, 1), (21, 0.0, 0, 0, 0, 1), (12, 0.0, 0, 0, 0, 1), (2, 0.0, 0, 1, 0, 0), (8, 0.0, 0, 1, 0, 0), (5, 0.0, 0, 1, 1, 0), (13, 0.0, 0, 1, 0, 0)),
    # a shop without text: prices, notices and links
    ((4, 1.0, 0, 0, 0, 0), (2, 0.0, 0, 0, 0, 0), (8, 0.0, 0, 0, 0, 0), (2, 1.0, 0, 0, 0, 0), (11, 0.0, 0, 0, 0, 0), (3, 1.0, 0, 0, 0, 0), (6, 0.0, 0, 0, 0, 0), (1, 1.0, 0, 0, 0, 0), (5, 0.0, 0, 0, 1, 0), (4, 1.0, 0, 0, 0, 0)),
    # one long text; a form's labels; a notice alone
    ((60, 0.0, 0, 0, 0, 1),),
    ((2, 0.0, 0, 0, 0, 0), (2, 0.0, 0, 0, 0, 0), (3, 0.0, 0, 0, 0, 0), (1, 1.0, 0, 0, 0, 0)),
    ((7, 0.0, 0, 0, 0, 0), (4, 0.0, 0, 0, 1, 0), (2, 1.0, 0, 0, 0, 0)),
)


#: Copies of each labelled page that are learned from besides itself, with other lengths of blocks and some left out.
COPIES = 40


def _rows(page: list) -> np.ndarray:
    rows = describe([("", n, links, -1 if around else int(inside), heading) for n, links, inside, around, heading, _ in page])
    return np.concatenate([rows, np.array([[block[5]] for block in page], dtype=float)], axis=1)


def labelled_table() -> np.ndarray:
    """The labelled table: ``FEATURES`` of each block of ``PAGES``, then 1 for main text."""
    return np.concatenate([_rows(page) for page in PAGES])


def varied_table() -> np.ndarray:
    """The labelled table and copies of its pages: blocks up to a half shorter or longer, with up to a third fewer links, one in six left out. A cut that hangs on one page's lengths doesn't hold there."""
    rng, parts = np.random.default_rng(5), [labelled_table()]
    for page in PAGES:
        for _ in range(COPIES):
            some = [(max(1, round(n * rng.uniform(0.5, 1.5))), links * rng.uniform(0.7, 1.0), *rest) for n, links, *rest in page if rng.random() > 1 / 6]
            if some:
                parts.append(_rows(some))
    return np.concatenate(parts)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 14) -> tuple:
    """A binary decision tree by Gini impurity: (feature, cut, below, above) or a leaf (share of main text,)."""
    share = labels.mean()
    if depth == 0 or share in (0, 1):
        return (float(share),)
    best, n = None, len(labels)
    for f in range(rows.shape[1]):
        order = np.argsort(rows[:, f], kind="stable")
        value, main = rows[order, f], np.cumsum(labels[order])
        at = np.flatnonzero(value[1:] > value[:-1]) + 1  # so many rows lie below each possible cut
        if not len(at):
            continue
        low, all_ = main[at - 1], main[-1]
        impurity = low * (at - low) / at + (all_ - low) * (n - at - all_ + low) / (n - at)
        i = int(np.argmin(impurity))
        if best is None or impurity[i] < best[0] - 1e-9:
            best = (impurity[i], f, float(value[at[i] - 1] + value[at[i]]) / 2)
    if best is None:
        return (float(share),)
    _, f, cut = best
    low = rows[:, f] <= cut
    return f, cut, grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1)


@functools.cache
def train() -> tuple:
    """The tree of the varied table."""
    data = varied_table()
    return grow(data[:, :-1], data[:, -1])


def is_main(tree: tuple, row: np.ndarray) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0] > 0.5


def main_text(page: str | None, tree: tuple) -> str:
    """The page's main blocks, joined by an empty line."""
    found = blocks(page or "")
    return "\n\n".join(b[0] for b, row in zip(found, describe(found)) if is_main(tree, row))


def _extract(tree: tuple):
    def run(pages: list[str | None]) -> list[list]:
        texts = [main_text(p, tree) for p in pages]
        return [texts, [len(t) for t in texts]]

    return lambda: run


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``pages`` plus ``text`` and ``n_chars`` of the main text of its ``html``.

    A decision tree, trained on a small table of blocks judged by hand, tells main text by a block's words and link density,
    those of its neighbours, whether it is a heading, and how much text elements or names put in a better or worse place than its own. A block is what stands between block-level tags; line breaks and other white space
    inside it become one space. Unclosed and stray tags, comments, quoted angle brackets
    and cut-off pages are read as browsers do, roughly. Null and empty pages give an empty text.
    Whole pages of any length are read, in time linear in it, without a shuffle; an empty table gives no rows. Null keys and repeated rows are
    treated like others; further columns are ignored.
    """
    return map_texts(pages, keep, "html", _extract(train()), {"text": "string", "n_chars": "long"})


def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


QUERIES = {"op5_html_blocks": op5_html_blocks}
ORACLE_SQL: dict[str, str] = {}
