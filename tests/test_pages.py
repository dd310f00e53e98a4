import pytest
from copyloom import schemas
from copyloom.operators.pages import page_facts, read_pages


@pytest.fixture
def facts(spark):
    def run(html, url="https://s.example/c"):
        return page_facts(spark.createDataFrame([(1, url, html)], schemas.PAGES)).first()

    return run


def test_h1_in_header_is_lost(facts):
    assert facts("<header><h1>A</h1></header><h1> B <i>c</i></h1><h1>D</h1>").h1 == "B c"


def test_titles_are_joined_but_not_those_of_drawings(facts):
    row = facts("<title> T</title><svg><title>X</title></svg><title>U </title>")
    assert row.title == "TU"


def test_no_separator_between_blocks(facts):
    assert facts("<body><p>a</p><p>b</p>c<br>d</body>").body_text == "abcd"


def test_white_space(facts):
    assert facts("<p>  a \t﻿ b \n</p>").body_text == "a b"


def test_meta_description(facts):
    assert facts("<p>x").meta_desc == ""
    assert facts('<meta name="description" content=" d "><meta name="description" content="e">').meta_desc == " d "
    assert facts('<meta name="Description" content="d">').meta_desc == ""


def test_body_is_cut(facts):
    assert len(facts("<p>" + "x" * 9000).body_text) == 8000
    # Trimmed first, cut second: the result may end in a blank.
    assert facts("<p>" + "x" * 7999 + " yy").body_text.endswith("x ")


def test_unclosed_tags(facts):
    assert facts("<p><b>a<br><p>b").body_text == "ab"
    # An open stripped element ends with its parent, and an inline end tag does not reach over it.
    assert facts("<div><nav>x</div>y").body_text == "y"
    assert facts("<span><nav>x</span>y</nav>z").body_text == "z"
    # A paragraph ends where a block begins, so its end tag does not close the block.
    assert facts("<p><nav>x</p>y</nav>z").body_text == "z"
    assert facts("<footer>x").body_text == ""


def test_stripped_content(facts):
    html = "<script>var a='<p>no</p>';</script><style>p{}</style><iframe>i</iframe><noscript>n</noscript>ok<!-- c -->"
    assert facts(html).body_text == "ok"


def test_head_text_is_not_body_text(facts):
    row = facts("<html><head>\n<title>T</title>\n</head>\n<body>a &amp; b &lt;c&gt;</body></html>")
    assert (row.title, row.body_text) == ("T", "a & b <c>")


def test_product_links(facts):
    html = (
        '<nav><a href="/products/n">n</a></nav>'
        '<a href="/products/a">1</a><a href="/products/a">2</a><a href="/products/a?v=1">3</a>'
        '<a href="https://o.example/products/b">4</a><a href="/Products/c">5</a><a>6</a>'
        '<a href="httpx/products/d">7</a><a href="products/e">8</a><a href="../x/products/f">9</a>'
    )
    row = facts(html)
    assert row.product_links == [
        "https://s.example/products/a",
        "https://s.example/products/a?v=1",
        "https://o.example/products/b",
        "httpx/products/d",
        "https://s.example/x/products/f",
    ]
    assert row.bad_links == 0


def test_bad_link_is_counted_not_fatal(facts):
    row = facts('<a href="//[x/products/a">1</a><a href="/products/b">2</a>')
    assert (row.success, row.bad_links, row.product_links) == (True, 1, ["https://s.example/products/b"])


def test_failed_pages_do_not_stop_the_job(spark):
    pages = spark.createDataFrame([(1, "https://a", None), (2, "https://b", "<h1>x</h1>"), (3, "https://c", "")], schemas.PAGES)
    rows = {r.page_id: r for r in page_facts(pages).collect()}
    assert (rows[1].success, rows[1].error, rows[1].title, rows[1].product_links) == (False, "no content", None, [])
    assert (rows[2].success, rows[2].h1) == (True, "x")
    assert (rows[3].success, rows[3].body_text) == (True, "")


def test_schema(spark):
    facts = page_facts(spark.createDataFrame([(1, "u", "h")], schemas.PAGES))
    assert [(f.name, f.dataType) for f in facts.schema] == [(f.name, f.dataType) for f in schemas.PAGE_FACTS]


def test_html_does_not_leave_the_job(spark):
    read = read_pages(spark.createDataFrame([(1, "u", "h")], schemas.PAGES))
    assert "html" not in read.columns


def test_other_columns_are_kept_in_their_types(spark):
    pages = spark.createDataFrame(
        [(1, "u", "<p>", True, None), (2, "v", None, None, 7)], "page_id int, url string, html string, flag boolean, n int"
    )
    rows = read_pages(pages).select("page_id", "flag", "n").orderBy("page_id").collect()
    assert [tuple(r) for r in rows] == [(1, True, None), (2, None, 7)]


def test_tags_and_references(facts):
    row = facts('<A HREF="/products/a?x=1&amp;y=2&copy=3&reg;" class=x>1</A><a href=/products/b>2</a>'
                "<a href = '/products/c' href='/products/d' / >3</a><p title='>'>x&ampy &nope; &#65; 1 < 2</p>")
    assert row.product_links == [
        "https://s.example/products/a?x=1&y=2&copy=3®", "https://s.example/products/b", "https://s.example/products/c",
    ]
    assert row.body_text == "123x&y &nope; A 1 < 2"
    assert facts("a<!-- <p>b --><!>c<!doctype x>d<?php e ?>f</>g</ h>i<p").body_text == "acdfgi"
    assert facts("<svg/>a<svg><style/><g/></svg>b<textarea><p>&lt;c</textarea>").body_text == "ab<p><c"
    assert facts("a<script>if (a</b/) '</scriptx>'</SCRIPT >b<style>x").body_text == "ab"


def test_options(spark):
    pages = spark.createDataFrame([(1, "https://s.example/c", '<p>a</p>b<br>c<a href="/products/é x">d</a>')], schemas.PAGES)
    row = page_facts(pages, separator=" ", encode=True).first()
    assert (row.body_text, row.product_links) == ("a b cd", ["https://s.example/products/%C3%A9%20x"])


@pytest.mark.parametrize("part", ["<", "<!--", "<a ", "</", '<a href="', "<![cdata[", "<p>", "<title>", "<div id='products'>", "<table><p>"])
def test_hostile_pages_stay_linear(part):
    import time

    from copyloom.operators.pages import _read_page

    start = time.time()
    assert _read_page("https://x", part * 50_000, True, True)["success"]
    assert time.time() - start < 5


def test_deeply_open_page_stays_linear(facts):
    assert facts("<b><i>x</u>" * 30_000).body_text == "x" * 8000
