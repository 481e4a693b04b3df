"""The main text of web pages by scoring the tree: paragraphs pass points to their ancestors."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratasize.llm.common import bounded_batches

#: Fixed values of HTML: elements without an end tag, elements whose content is no text, elements that end a block.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key ends an open element of the values that is nearer than any other block.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements, roles, and words in class or id that stand around an article.
ASIDE = frozenset("nav footer aside form dialog menu search button select object canvas svg math audio video fieldset head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adsense advert advertisement adverts advertising banner breadcrumb breadcrumbs consent cookie cookies footer header login masthead menu modal nav "
    "navbar navigation newsletter overlay pager pagination popup promo promoted recommended related sidebar signup skip sponsor sponsored subscribe subscription "
    "toolbar widget widgets".split()
)
#: Words that articles use for their own sections as well; and words for what readers say, which may be longer than the article.
OPEN_WORDS = frozenset("legal notice notices search share sharing social".split())
TALK = frozenset("comment comments disqus replies".split())
#: What may stand beside those words in a name. A name with any other word (share-of-market) tells a subject, not a place.
PLACES = frozenset(
    "area article bar block body bottom box btn button buttons card col column container content count entry form group icon icons id inner item items js left "
    "link links list main message module outer page panel post reader region right row section site slot text thread title top unit user wrap wrapper".split()
)
#: A name costs an element so many points; a word of WORDS so large a part of what the article around it scores, if more.
NAME_POINTS, NAME_SHARE = 2.0, 0.3
#: From this share of link text on a named element goes.
LINK_SHARE = 0.5
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
#: The same without quotes, from where one never ends.
_SLOPPY = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}


def _looks_aside(tag: str, attributes: str) -> tuple[bool, int]:
    """Whether an element stands beside the text for certain (its kind), and what its class or id calls it: 1 a word that
    sections of an article may have as well, 2 something beside the text, 3 talk. A name counts if all its parts are
    such words or say where something stands."""
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    sure = tag in ASIDE or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(found.get("style", "")))
    called = 0
    for name in (found.get("class", "") + " " + found.get("id", "")).split():
        parts = {p.lower() for p in _PARTS.findall(name)}
        if parts and parts <= PLACES | WORDS | OPEN_WORDS | TALK:
            called = max(called, 3 if parts & TALK else 2 if parts & WORDS else int(bool(parts & OPEN_WORDS)))
    return sure, called


class Page:
    """A page's elements in page order, and its text in pieces of (element, block, text)."""

    def __init__(self, html: str):
        self.tag, self.parent, self.sure, self.named = ["#root"], [0], [False], [0]
        self.pieces: list[tuple[int, int, str]] = []
        block, at, markup = 0, 0, _MARKUP
        open_, blocks = [0], []  # open elements, and at which depths those are that end a block
        depths: dict[str, list[int]] = {}  # by tag

        def close_to(depth: int) -> None:
            for e in open_[depth:]:
                depths[self.tag[e]].pop()
            del open_[depth:]
            while blocks and blocks[-1] >= depth:
                blocks.pop()

        def ended(tags: tuple[str, ...]) -> None:
            while blocks and self.tag[open_[blocks[-1]]] in tags:
                close_to(blocks[-1])

        while at < len(html):
            m = markup.search(html, at)
            if m is None:
                self.pieces.append((open_[-1], block, html[at:]))
                break
            if m.start() > at:
                self.pieces.append((open_[-1], block, html[at : m.start()]))
            at = m.end()
            if not m[2]:
                continue
            if at == len(html) and html[-1] != ">" and markup is _MARKUP:  # a quote that never ends hides no text
                markup = _SLOPPY
                m = markup.match(html, m.start()) or m
                at = m.end()
            tag = m[2].lower()
            if tag in BLOCK:
                block += 1
            elif tag == "br":
                self.pieces.append((open_[-1], block, " "))
            if m[1]:
                if depths.get(tag):
                    close_to(depths[tag][-1])
                continue
            if tag in BLOCK:
                ended(("p",))
            if tag in ENDS:
                ended(ENDS[tag])
            if tag in RAW:
                end = _RAW_END[tag].search(html, at)
                at = end.end() if end else len(html)
            elif tag not in VOID and not m[3].endswith("/"):
                sure, named = _looks_aside(tag, m[3])
                self.tag.append(tag)
                self.parent.append(open_[-1])
                self.sure.append(sure)
                self.named.append(named)
                depths.setdefault(tag, []).append(len(open_))
                if tag in BLOCK:
                    blocks.append(len(open_))
                open_.append(len(self.tag) - 1)

    def inside(self, marks: list[bool]) -> list[bool]:
        """For each element, whether it or an ancestor is marked."""
        out = list(marks)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return out

    def summed(self, values: list[float]) -> list[float]:
        """For each element, the sum over it and all below it."""
        out = list(values)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out


def _blocks(page: Page, gone: list[bool]) -> tuple[list[tuple[int, float]], list[float], list[float]]:
    """(element, points) of each block of text, and the lengths of each element's text and of its links' text, by itself."""
    n = len(page.tag)
    linked = page.inside([t == "a" for t in page.tag])
    length, links = [0.0] * n, [0.0] * n
    blocks: dict[int, list] = {}
    for e, b, text in page.pieces:
        size = len(" ".join(text.split()))
        if not size or gone[e]:
            continue
        length[e] += size
        links[e] += size * linked[e]
        one = blocks.setdefault(b, [e, 0, 0, 0])
        one[1] += size
        one[2] += text.count(",")
        one[3] += size * linked[e]
    within = list(range(n))  # the nearest element that is a block of its own
    for e in range(1, n):
        if page.tag[e] not in BLOCK:
            within[e] = within[page.parent[e]]
    worth = [(within[e], (min(size / 100, 3.0) + (1 + commas if size >= 25 else size / 100)) * (1 - link / size)) for e, size, commas, link in blocks.values()]
    return [(e, w) for e, w in worth if page.tag[e] not in HEADINGS], length, links


def _scores(page: Page, gone: list[bool]) -> tuple[list[float], list[float], list[float]]:
    """Points of each element as a container, and the lengths of its text and of its links' text."""
    blocks, length, links = _blocks(page, gone)
    points = [0.0] * len(page.tag)
    for e, worth in blocks:
        at = e if page.tag[e] in ("div", "section", "article", "main", "body", "td", "#root") else page.parent[e]
        for share in (1.0, 0.5, 0.2, 0.1, 0.05):
            points[at] += worth * share
            if not at:
                break
            at = page.parent[at]
    return points, page.summed(length), page.summed(links)


def _beside(page: Page, sure: list[bool]) -> list[bool]:
    """Whether each element stands beside the text: for certain, or because its name costs it more than it scores.

    An element's score by itself is the sum of its blocks' points. A name that sections may have costs NAME_POINTS; one of
    something beside the text costs NAME_SHARE of what the article around it scores, if that is more, but not if all such
    elements would take half of the article; outside of an article it costs all. Talk goes at any score, and a named element of mostly link text too. An
    element that holds the article, or most of a page without one, isn't judged by its name.
    """
    n = len(page.tag)
    blocks, length, links = _blocks(page, page.inside(sure))
    own = [0.0] * n
    for e, worth in blocks:
        own[e] += worth
    own, length, links = page.summed(own), page.summed(length), page.summed(links)
    core = page.summed([float(t in ("article", "main") and not m) for t, m in zip(page.tag, page.named, strict=True)])
    around, top = [0] * n, [0] * n  # the article around each element; its outermost named element below that
    for e in range(1, n):
        up = page.parent[e]
        around[e] = up if page.tag[up] in ("article", "main") and not page.named[up] else around[up]
        top[e] = top[up] if around[e] == around[up] and top[up] else e * (page.named[e] > 0)
    may = [bool(m) and not core[e] and t not in ("html", "body", "main") and (core[0] > 0 or own[e] <= 0.5 * own[0]) for e, (m, t) in enumerate(zip(page.named, page.tag, strict=True))]
    small, total = [False] * n, [0.0] * n
    for e in range(1, n):
        small[e] = may[e] and page.named[e] == 2 and own[e] <= NAME_SHARE * own[around[e]]
        if small[e] and top[e] == e:
            total[around[e]] += own[e]
    out = list(sure)
    for e in range(1, n):
        if may[e] and not out[e]:
            few = small[e] and total[around[e]] <= 0.5 * own[around[e]]
            apart = page.named[e] == 2 and not around[e]
            out[e] = page.named[e] == 3 or apart or own[e] <= NAME_POINTS or few or links[e] > LINK_SHARE * length[e]
    return page.inside(out)


def main_text(html: str | None) -> str:
    """The page's article: blocks joined by one new line, white space inside a block as one space."""
    page = Page(html or "")
    n = len(page.tag)
    articles = page.inside([t == "article" for t in page.tag])
    sure = [s or (t == "header" and not a) for s, t, a in zip(page.sure, page.tag, articles, strict=True)]
    gone = _beside(page, sure)
    points, length, links = _scores(page, gone)
    menus = [t in ("ul", "ol", "dl") and length[e] > 0 and links[e] > 0.8 * length[e] for e, t in enumerate(page.tag)]
    # In an article's header only headings belong to the text.
    byline = page.inside([t == "header" for t in page.tag])
    heading = page.inside([t in HEADINGS for t in page.tag])
    gone = [g or m or (b and not h) for g, m, b, h in zip(gone, page.inside(menus), byline, heading, strict=True)]
    density = [links[e] / length[e] if length[e] else 0.0 for e in range(n)]
    bonus = {"article": 5.0, "main": 4.0}
    score = [-1.0 if gone[e] or not length[e] or (e and t not in BLOCK) else (points[e] + bonus.get(t, 0.0)) * (1 - density[e]) for e, t in enumerate(page.tag)]
    best = max(range(n), key=lambda e: (score[e], -e))
    if score[best] <= 0:
        return ""
    up = best
    while up and page.tag[up] not in ("article", "main"):
        up = page.parent[up]
    best = up or best
    kept = [False] * n
    kept[best] = True
    for e in range(1, n):
        if page.parent[e] == page.parent[best] and not gone[e] and best:
            kept[e] = kept[e] or score[e] >= max(1.0, 0.2 * score[best]) or (page.tag[e] == "p" and length[e] >= 80 and density[e] < 0.25) or (page.tag[e] in HEADINGS and e < best)
    kept = page.inside(kept)
    out: dict[int, list[str]] = {}
    for e, b, text in page.pieces:
        if kept[e] and not gone[e]:
            out.setdefault(b, []).append(text)
    lines = (" ".join(unescape("".join(parts)).split()) for parts in out.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, html_col: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text of each whole html and n_chars, its code points.

    Elements pass the points of their paragraphs (length and commas, less by the share of link text) to the ancestors,
    ever less; the container with the most points, less by its own link share, is kept, in a whole article or main
    element where it has one, with siblings that score well. Menus, headers, footers, sidebars, notices, adverts,
    forms and comments are known by element and role; a name in class or id is a term of an element's score (_beside()).
    Each page is read once from start to end, so hostile nesting or quotes cost no more than length;
    a very long page is read whole.

    Nulls and pages without text: an empty text. Markup that never ends closes with the page. Repeated rows get equal
    results; an empty table stays empty. Other columns pass through, except those with the names of the new ones.
    """

    @F.arrow_udf("string")
    def run(html: pa.Array) -> pa.Array:
        return pa.array([main_text(x) for x in html.to_pylist()], pa.string())

    return bounded_batches(pages).withColumn(text, run(F.col(html_col))).withColumn("n_chars", F.length(text).cast("long"))
