"""Main text against Python's own HTML parser, and pages that are not as they should be."""

from html.parser import HTMLParser

import pytest

from varcohort.llm import html_text

MODEL = html_text.fit([])


class Article(HTMLParser):
    """Text inside <article>, a block for each p or heading."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1", "br"):
            self.blocks += [""] if tag != "br" else []
            self.blocks[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_whole_table_against_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        a = Article()
        a.feed(r["html"])
        assert got[r["page_id"]] == " ".join(t for b in a.blocks if (t := " ".join(b.split())))


def texts(page):
    return [t for _, t in html_text.parse(page)[1]]


@pytest.mark.parametrize("tag", ["svg", "math", "select", "object", "canvas", "noscript", "template", "textarea", "title", "iframe", "b", "div", "section"])
def test_unclosed_elements_keep_the_page(tag):
    assert texts(f"<article><p>One.</p><{tag}><p>Two.</p><p>Three.</p></article>") == ["One.", "Two.", "Three."]


def test_unclosed_code_ends_at_the_next_tag():
    assert texts("<p>One.</p><script>var x = 1 < 2;<p>Two.</p>") == ["One.", "Two."]
    assert texts("<p>One.</p><style>p { }") == ["One."]


def test_formulas_run_on_in_the_line():
    assert texts("<p>As <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>") == ["As x=2 holds."]
    assert texts("<p>An <svg><title>icon</title><path d='M0'/></svg> icon.</p><p>Next.</p>") == ["An icon.", "Next."]


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0
    page = "<html><body><nav><a href=x>Menu</a></nav><article><h1>Head</h1><p>A sentence that is long enough to be one.</p></article></body></html>"
    rows = [(1, None, page, "clash", 7), (1, None, page, "clash", 7), (None, "u", page, None, None), (4, "u", None, None, None)]
    got = html_text.extract(spark.createDataFrame(rows, schema)).collect()
    assert [c for c in got[0].asDict()] == ["page_id", "url", "text", "n_chars"]
    want = "Head A sentence that is long enough to be one."
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got) == [("1", want, len(want)), ("1", want, len(want)), ("4", "", 0), ("None", want, len(want))]


@pytest.fixture(scope="module")
def fitted():
    """The model that the pages of sf0.01 give, as the query fits it."""
    import duckdb

    pages = duckdb.sql("SELECT html FROM read_parquet('/root/testdata/sf0.01/pages.parquet') ORDER BY page_id LIMIT 120").fetchall()
    return html_text.fit([p[0] for p in pages])


ONE = "The first sentence of the story is long enough to be read as one, and it goes on for a while."
TWO = "A second paragraph tells what came after that, in about as many words as the first one had."
OFF = "Sign up to our letter and never miss a thing that happens, with offers from our many partners."


@pytest.mark.parametrize("part", [
    f"<aside><p>{OFF}</p></aside>", f"<form><p>{OFF}</p><input name=q></form>", f"<button>{OFF}</button>", f'<div class="advert"><p>{OFF}</p></div>', f'<div class="cookie-notice">{OFF}</div>',
    f'<div class="sidebar"><ul><li>{OFF}</li></ul></div>', f'<section id="comments"><div><p>{OFF}</p></div></section>', f"<nav>{OFF}</nav>", f"<footer>{OFF}</footer>", f'<p><span class="ad">{OFF}</span></p>',
])
def test_foreign_parts_inside_the_article_go(fitted, part):
    page = f"<html><body><nav><a href=x>Home</a></nav><article><h1>Head</h1><p>{ONE}</p>{part}<p>{TWO}</p></article></body></html>"
    assert html_text.main_text(page, fitted) == f"Head {ONE} {TWO}"


MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Contact</a></li></ul>'
TEMPLATES = {
    "post": f'<div class="menu">{MENU}</div><div class="post"><h1>Head</h1><p>{ONE}</p><p>{TWO}</p></div><div class="footer"><p>{OFF}</p></div>',
    "content": f'<div id="header"><p>{OFF}</p></div><div id="content"><h1>Head</h1><p>{ONE}</p><p>{TWO}</p></div><div id="sidebar"><p>{OFF}</p></div>',
    "main": f"<header><p>{OFF}</p></header><main><h1>Head</h1><p>{ONE}</p><p>{TWO}</p></main><div><p>{OFF}</p></div>",
    "nested": f'<div class="page"><div class="navbar">{MENU}</div><div class="row"><div class="entry-content"><h1>Head</h1><div><p>{ONE}</p></div><div><p>{TWO}</p></div></div><div class="widget"><p>{OFF}</p></div></div></div>',
    "bare": f"<div>{MENU}</div><h1>Head</h1><p>{ONE}</p><p>{TWO}</p>",
    "table": f'<table class="nav"><tr><td><a href=x>Home</a></td></tr></table><div class="story"><h1>Head</h1><p>{ONE}</p><p>{TWO}</p></div><div class="share"><a href=y>Share</a></div>',
    "quotes": f'<article><h1>Head</h1><p>{ONE}</p><blockquote><p>{TWO}</p></blockquote></article><div class="related"><p>{OFF}</p></div>',
}


@pytest.mark.parametrize("name", TEMPLATES)
def test_other_templates(fitted, name):
    assert html_text.main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{TEMPLATES[name]}</body></html>", fitted) == f"Head {ONE} {TWO}"


def test_adverts_in_the_line(fitted):
    page = f'<article><p>{ONE} <span class="ad">Buy now!</span>{TWO}</p><p><em class="x">{TWO}</em></p></article>'
    assert html_text.main_text(page, fitted) == f"{ONE} {TWO} {TWO}"


def test_unclosed_comments_and_quotes():
    assert texts("<p>One.</p><!-- note <p>Two.</p><p>Three.</p>") == ["One.", "Two.", "Three."]
    assert texts("<p>One.</p><!-- a > b --><p>Two.</p>") == ["One.", "Two."]
    assert texts("<p>One.</p><p class=\"foo>Two.</p><p>Three.</p>") == ["One.", "Two.", "Three."]
    assert texts("<p>One.</p><!-->Two.<p>Three.</p>") == ["One.", "Two.", "Three."]
