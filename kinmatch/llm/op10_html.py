"""Main text of web pages from flat text blocks, classified by a decision tree.

A page is read once, left to right, into blocks of text between block-level tags. Each block has its word count, its
link density, those of the blocks before and after it, whether it is a heading, a paragraph or bare text, and its place:
within an element that is named as a side part, outside the part that is named as the article, or in it, or on a page
that names none. A decision tree, grown from the small table of labelled_pages, tells the article's blocks from the rest.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow, only
from .labelled_pages import pages

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|select|svg|iframe|object|title|canvas|math|audio|video|button)\b(?>[^>\"']+|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^<>\"']+|\"[^\"]*\"|'[^']*')*)/?>"
    r"|<[!?/][^>]*>?|<[a-zA-Z][^<>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label|hidden|style)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|(?<![\w-])(hidden)(?![\w-])", re.I)
NAME_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+|\d+")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr input".split()
)
#: Elements whose open ones are kept track of; the rest end where the next block begins.
STRUCTURE = frozenset("article main nav header footer aside form menu div section ul ol li table td tr dl body figure dialog details blockquote fieldset head center".split())
SIDE = frozenset("nav header footer aside form menu dialog fieldset head".split())
#: Parts of class names and ids that tell what isn't the article, or is.
SIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promoted promotion cookie cookies consent gdpr "
    "notice notices notification alert nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar side aside widget widgets "
    "footer foot header masthead topbar toolbar comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup login search form popup modal overlay paywall copyright legal skip tags taglist toc".split()
)
#: Parts that are no sign of a side part where a name also has one of MAIN_NAMES.
WEAK_NAMES = frozenset("alert notice notices notification header head top toc tags legal promo search form social".split())
MAIN_NAMES = frozenset("article main post entry story content body text prose articlebody mainbody".split())
#: Parts of names that say how a part is laid out, or where, and not what it holds.
LAYOUT_NAMES = frozenset(
    "site page global main left right center top bottom upper lower inner outer primary secondary mini small large big first last box block list item items "
    "container wrapper wrap holder area section row col column columns grid panel pane bar inline link links icon icons button buttons group slot unit zone "
    "region module component div ul li nav id js fixed sticky floating mobile desktop default no new the by and for with more of us my all "
    "label text title posts articles stories news topics videos products reading read user users reader readers visitor google dfp gpt wp fb facebook twitter".split()
)
#: Names that begin the main part.
MAIN_PARTS = frozenset("article post entry story prose articlebody".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p li blockquote pre dd dt td th figcaption caption".split())

#: What the tree sees of a block. form: 0 bare text, 1 a paragraph, 2 a heading. place: 0 in a side part, 1 outside the
#: page's main part, 2 on a page without one, 3 in the main part.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "form", "place")
#: Renderings of each labelled pattern, and the least blocks of a leaf.
RENDERINGS, LEAF, SEED = 12, 8, 10


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple | float:
    """A decision tree by Gini impurity: (feature, threshold, at most, above), or the share of label 1."""
    n, best = len(y), None
    if depth == 0 or n < 2 * LEAF or y.min() == y.max():
        return float(y.mean())
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, ones = x[order, j], np.cumsum(y[order])
        at = np.arange(1, n)  # rows in the lower part
        a, b = ones[:-1], ones[-1] - ones[:-1]
        gini = a * (1 - a / at) + b * (1 - b / (n - at))
        gini[(v[1:] == v[:-1]) | (at < LEAF) | (n - at < LEAF)] = np.inf
        k = int(np.argmin(gini))
        if np.isfinite(gini[k]) and (best is None or gini[k] < best[0] - 1e-9):
            best = (gini[k], j, float((v[k] + v[k + 1]) / 2))
    if best is None:
        return float(y.mean())
    _, j, cut = best
    low = x[:, j] <= cut
    return j, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def table(seed: int = SEED, renderings: int = RENDERINGS, names: tuple[bool, ...] = (True, False)) -> tuple[np.ndarray, np.ndarray]:
    """The labelled blocks: features and labels."""
    x, y = [], []
    for html in pages(seed, renderings, names):
        found = blocks(html)
        x += features(found)
        y += [b[0].startswith("§") for b in found]
    return np.array(x, dtype=float), np.array(y, dtype=float)


@lru_cache
def tree() -> tuple | float:
    return grow(*table())


def accepts(at: tuple | float, row: tuple) -> bool:
    while isinstance(at, tuple):
        j, cut, low, high = at
        at = low if row[j] <= cut else high
    return at >= 0.5


#: How sure it is that an element begins a side part: not at all, as a form, which may also be put round a whole page, or otherwise.
NONE, FORM, SURE = 0, 1, 2


@lru_cache(maxsize=20_000)
def kind(tag: str, attributes: str) -> tuple[int, bool]:
    """Whether an element begins a side part of the page, and whether it begins the main part.

    A name is a sign of a side part if all of its parts are in SIDE_NAMES or speak of the layout only, or if two are: a
    section named ``related-work`` or ``search-algorithms`` isn't one, ``related-box`` and ``comment-form-3`` are.
    """
    side, main = FORM if tag == "form" else SURE if tag in SIDE else NONE, tag in ("article", "main")
    for name, value, bare in ATTRIBUTE.findall(attributes):
        name, value = (name or bare).lower(), value.strip("\"'")
        if name == "style":
            side = max(side, SURE * ("display:none" in value.replace(" ", "").lower()))
            continue
        if name == "hidden":
            side = SURE
            continue
        if name == "itemprop":
            main |= value.lower() == "articlebody"
            continue
        if name == "role":
            away = value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu")
            side = max(side, SURE * away)
            main |= value.lower() in ("main", "article")
            continue
        if tag == "form":  # whatever it is called
            continue
        for token in value.split():
            parts = {p.lower() for p in NAME_PART.findall(token)}
            signs = parts & SIDE_NAMES
            if parts & MAIN_NAMES:
                signs -= WEAK_NAMES
            other = {p for p in parts - SIDE_NAMES - LAYOUT_NAMES - MAIN_NAMES if not p.isdigit() and len(p) > 1}
            if other and len(signs) < 2:
                signs = set()
            side = max(side, SURE * (bool(signs) and tag not in ("article", "main", "body")))
            main |= not signs and bool(parts & MAIN_PARTS) and name in ("class", "id") and tag in ("div", "section", "td")
    return side, main


def blocks(html: str) -> list[tuple[str, float, bool, int, int]]:
    """The page's blocks in order: text, link density, whether it is in the main part, in a side part, and its form.

    Inline elements that are hidden, or named as a side part, are left out. An end tag without a start is passed over at
    once, so that the time is linear in the page's length, however deep it is nested.
    """
    found, text, linked, in_link = [], [], 0, False
    form, aside = 0, NONE  # of the block that is being read
    without = ""  # the inline element that is being left out
    stack: list[tuple[str, int, bool]] = []  # (tag, side, main) as they hold inside
    opened: Counter[str] = Counter()

    def end() -> None:
        nonlocal linked, text
        if text:
            clean = " ".join(unescape("".join(text)).split())
            if clean:
                side, main = stack[-1][1:] if stack else (NONE, False)
                found.append((clean, min(1.0, linked / max(1, len(clean))), main, max(side, aside), form))
        text, linked = [], 0

    def close(i: int) -> None:
        for tag, *_ in stack[i:]:
            opened[tag] -= 1
        del stack[i:]

    def close_last(tag: str, within: frozenset[str] = frozenset()) -> None:
        """Ends the innermost open element of that name, and what is open in it, unless an element of ``within`` has begun since."""
        if opened[tag]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in within:
                    return
                if stack[i][0] == tag:
                    return close(i)

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at and not without:
            part = html[at : m.start()]
            text.append(part)
            if in_link:
                linked += len(part.strip())
        at = m.end()
        tag = (m[3] or "").lower()
        if m[1]:
            if m[1].lower() not in ("svg", "canvas", "math"):
                text.append(" ")
            continue
        if not tag:
            continue
        if tag in INLINE:
            if without:
                without = "" if m[2] and tag == without else without
            elif tag == "a":
                in_link = not m[2]
            elif tag == "br":
                text.append(" ")
            elif not m[2] and tag not in ("wbr", "img", "input") and m[4].strip() and kind(tag, m[4])[0]:
                without = tag
            continue
        end()
        without = ""
        form = 0 if m[2] else 2 if tag in HEADINGS else 1 if tag in PARAGRAPHS else form if form == 2 else 0
        aside = kind(tag, m[4])[0] if not m[2] and tag not in STRUCTURE and m[4].strip() else NONE
        if tag not in STRUCTURE:
            continue
        in_link = False
        if m[2]:
            close_last(tag)
        else:
            if tag == "li":
                close_last("li", frozenset(("ul", "ol", "menu")))
            elif tag == "body" and stack and stack[-1][0] == "head":
                close(len(stack) - 1)
            side, main = kind(tag, m[4] or "")
            above = stack[-1] if stack else ("", NONE, False)
            if tag == "header" and above[2] and not above[1]:
                side = kind("div", m[4] or "")[0]  # an article's own head, unless its name says more than that
            if main:
                side = NONE
            over = NONE if main and above[1] == FORM else above[1]  # an article begins anew in a form that is put round it
            stack.append((tag, max(over, side), above[2] or main))
            opened[tag] += 1
    if at < len(html) and not without:
        text.append(html[at:])
    end()
    return found


def features(found: list[tuple[str, float, bool, int, int]]) -> list[tuple]:
    """FEATURES of each block of a page. A form that holds most of the page's paragraphs is put round the page, and no side part."""
    count = [b[0].count(" ") + 1 for b in found]
    prose = [sum(n for n, b in zip(count, found) if b[3] == level and b[4] == 1 and b[1] < 0.5) for level in (NONE, FORM)]
    side = [b[3] == SURE or b[3] == FORM and not (prose[FORM] >= 40 and prose[FORM] > 3 * prose[NONE]) for b in found]
    on_page = any(b[2] and not away for b, away in zip(found, side))
    words = [0, *count, 0]
    links = [0.0, *(b[1] for b in found), 0.0]
    places = [0 if away else 3 if b[2] else 1 if on_page else 2 for b, away in zip(found, side)]
    return [
        (words[i], links[i], words[i - 1], links[i - 1], words[i + 1], links[i + 1], b[4], place)
        for i, (b, place) in enumerate(zip(found, places), 1)
    ]


def main_text(html: str | None, rules: tuple | float | None = None) -> str:
    """The article's blocks, a line each; empty if there is none. ``rules`` is the tree, if not the usual one."""
    found, rules = blocks(html or ""), tree() if rules is None else rules
    return "\n".join(b[0] for b, row in zip(found, features(found)) if accepts(rules, row))


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``: the main text of the whole html of each row of ``pages (page_id, url, html)``.

    A null or empty page has an empty text; a page that breaks off is read as far as it goes; repeated rows give
    repeated results; an empty table gives an empty one.
    """

    rules = tree()

    def make():
        def each(batch):
            texts = [main_text(h, rules) for h in batch["html"]]
            return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return each

    kinds = {"page_id": T.LongType(), "url": T.StringType(), "text": T.StringType(), "n_chars": T.LongType()}
    schema = T.StructType([T.StructField(c, k) for c, k in kinds.items()])
    return map_arrow(only(pages, page_id="long", url="string", html="string"), make, schema)
