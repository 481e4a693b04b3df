"""Main text of pages: names that only hint, hostile markup, and scores against a plain recount."""

import time
from html.parser import HTMLParser

import pytest

from stratasize.llm import html_text
from stratasize.llm.html_text import main_text

TEXT = "<p>" + "The court held, in its long reasoning, that the parties agreed. " * 6 + "</p>"


def test_a_name_takes_no_large_part_of_an_article():
    lead = "<h1>Title</h1><p>A short lead of this text, here.</p>"
    want = main_text(f"<article>{lead}{TEXT * 6}</article>")
    assert want.count("The court") == 36
    assert main_text(f"<article>{lead}<div class='legal-analysis'>{TEXT * 6}</div></article>") == want
    assert main_text(f"<article>{lead}{''.join(f'<div class=legal-{i}>{TEXT}</div>' for i in range(6))}</article>") == want
    assert main_text(f"<article>{lead}{TEXT * 6}<div class='promo'>Buy it now</div><ul class='related'><li><a href=x>More to read</a></ul></article>") == want
    assert main_text(f"<article>{lead}{TEXT * 6}<section id='comments'>{TEXT.replace('court', 'reader') * 9}</section></article>") == want


PLAIN = "<p>The parties met again in spring and wrote down what both had agreed on before the long winter had begun that year. Nothing of it was signed.</p>"


@pytest.mark.parametrize("paragraphs", [1, 2, 4])
@pytest.mark.parametrize("name", ["chapter", "legal", "share-of-market", "search-results", "social-history", "comment-analysis", "headers-explained", "menuOfTheDay"])
def test_sections_keep_their_paragraphs(name, paragraphs):
    for lead in (TEXT, PLAIN):
        for outer in ("article", "div"):
            want = main_text(f"<body><{outer}><h1>Title</h1>{lead * 8}<section>{lead * paragraphs}</section></{outer}></body>")
            assert want.count("\n") == 8 + paragraphs
            for attribute in ("class", "id"):
                assert main_text(f"<body><{outer}><h1>Title</h1>{lead * 8}<section {attribute}='{name}'>{lead * paragraphs}</section></{outer}></body>") == want


@pytest.mark.parametrize(
    "beside",
    [
        "<div class='ad'>Buy it now, it is cheap.</div>", "<div class='cookie-notice'>We use cookies, as all do, to measure and to show you more. Accept</div>", "<div id='comments'>" + PLAIN * 12 + "</div>", "<ol class='comment-list'><li>" + PLAIN + "</li></ol>",
        "<div class='social-share'><a href=x>Share this with all your friends</a> <a href=y>Send</a></div>", "<div class='notice'>Only subscribers see all.</div>", "<div class='newsletter signup'>" + PLAIN + "</div>", "<div class='related-links'><p><a href=x>More of this and that to read</a></p></div>",
        "<aside>" + PLAIN + "</aside>", "<form>" + PLAIN + "</form>", "<div role='complementary'>" + PLAIN + "</div>", "<div style='display:none'>" + PLAIN + "</div>",
    ],
)
def test_what_stands_beside_goes(beside):
    for outer in ("article", "div"):
        want = main_text(f"<body><{outer}><h1>Title</h1>{TEXT * 8}</{outer}></body>")
        assert main_text(f"<body><{outer}><h1>Title</h1>{TEXT * 4}{beside}{TEXT * 4}</{outer}></body>") == want


@pytest.mark.parametrize("html", ["<div><i>" * 60_000, "<i>" * 90_000 + "<td></td>" * 9000, "<td><div>" + "<i>" * 90_000 + "<td></td>" * 9000, '<a "' * 100_001, "<a href='" * 100_001, "<p>x<i>" * 60_000 + "<hr>x" * 20_000, "<!--" * 90_000, "</div>" * 90_000])
def test_hostile_markup_is_linear(html):
    began = time.process_time()
    main_text(html)
    assert time.process_time() - began < 20  # a quadratic reading takes minutes


def plain_points(page, gone):
    """Each container's points, counted from its side: all blocks below it, by how far up they reach it."""
    linked = page.inside([t == "a" for t in page.tag])
    blocks = {}
    for e, b, text in page.pieces:
        if (size := len(" ".join(text.split()))) and not gone[e]:
            blocks.setdefault(b, []).append((e, size, text.count(","), size if linked[e] else 0))
    given = []
    for parts in blocks.values():
        e, size, commas, links = parts[0][0], sum(p[1] for p in parts), sum(p[2] for p in parts), sum(p[3] for p in parts)
        while e and page.tag[e] not in html_text.BLOCK:
            e = page.parent[e]
        if page.tag[e] not in html_text.HEADINGS:
            worth = (min(size / 100, 3.0) + (1 + commas if size >= 25 else size / 100)) * (1 - links / size)
            given.append((e if page.tag[e] in ("div", "section", "article", "main", "body", "td", "#root") else page.parent[e], worth))
    out = []
    for e in range(len(page.tag)):
        total = 0.0
        for at, worth in given:
            for share in (1.0, 0.5, 0.2, 0.1, 0.05):
                if at == e:
                    total += worth * share
                if not at:
                    break
                at = page.parent[at]
        out.append(total)
    return out


def test_points_on_the_given_pages(spark, small):
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        page = html_text.Page(r["html"] or "")
        for gone in ([False] * len(page.tag), html_text._beside(page, page.sure)):
            assert html_text._scores(page, gone)[0] == pytest.approx(plain_points(page, gone))


class Plain(HTMLParser):
    """The given pages read by rules of their kind: the blocks of their article, but for what is beside it."""

    VOID = {"br", "meta", "img", "link", "hr", "input"}
    BESIDE = {"nav", "aside", "footer", "form", "script", "style", "head", "header"}
    INLINE = {"a", "b", "i", "em", "strong", "span", "br", "u", "code", "small", "sup", "sub"}

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks = [], [""]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag not in self.INLINE:
            self.blocks.append("")
            if tag == "p" and "p" in self.open:
                del self.open[self.open.index("p") :]
        if tag == "br":
            self.handle_data(" ")
        if tag not in self.VOID:
            beside = tag in self.BESIDE or dict(attrs).get("class") in ("ad", "comments")
            self.open.append(f"beside {tag}" if beside else tag)

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.blocks.append("")
        depths = [i for i, name in enumerate(self.open) if name.split()[-1] == tag]
        if depths:
            del self.open[depths[-1] :]

    def handle_data(self, data):
        if "article" in self.open and not any(name.startswith("beside ") for name in self.open):
            self.blocks[-1] += data

    def text(self):
        return "\n".join(x for b in self.blocks if (x := " ".join(b.split())))


def test_given_pages_equal_a_plain_reader(spark, small):
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        assert main_text(r["html"]) == Plain(r["html"]).text()
