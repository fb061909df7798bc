"""Main text of pages: the template of the given ones, other layouts, and odd input."""

import re
from html import unescape

import pytest

from staytide.llm.html_text import extract, main_text

LONG = "This paragraph is long enough to be the content of a page, with several words in it."

CASES = {
    "": "",
    "plain text": "plain text",
    "<p>a &amp; b&nbsp;c&#33;</p>": "a & b c!",
    "<article><p>a<p>b<br>c</article>": "a\nb c",
    f"<nav><a>Home</a></nav><div id=main-content><h2>T</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><footer>f</footer>": f"T\n{LONG}\nShort.\n{LONG}",
    f"<header>site</header><main><article><header><h1>T</h1></header><p>{LONG}</p></article><section class='comments'><p>{LONG}</p></section></main>": f"T\n{LONG}",
    f"<div class='cookie-notice'>{LONG}</div><aside>{LONG}</aside><article>{LONG}<script>var a='<p>x</p>';</script><form>f</form></article>": LONG,
    f"<article><p>{LONG}</p><div class='ad'>{LONG}<p>more</div><ul><li>one<li>two</ul></article><div>tail</div>": f"{LONG}\none\ntwo",
    "<article><!-- no --><h1>T</h1><p><b>B.<br><p>C</p></article><footer>&copy; x": "T\nB.\nC",
    "<nav><ul><li><a>x</a></li></ul></nav><script>only()</script>": "",
    "<p>unclosed <b>tags <i>here": "unclosed tags here",
}


@pytest.mark.parametrize("html", CASES)
def test_cases(html):
    assert main_text(html) == CASES[html]


BODY = f"<p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>"
TEXT = "\n".join([LONG] * 3)
WRAPPED = [
    f"<div class='content-sidebar-wrap'><article>{BODY}</article><div class='sidebar'><a>x</a></div></div>",
    f"<div class='page has-sidebar'><div>{BODY}</div><div class='sidebar-right'><p>short</p></div></div>",
    f"<article class='post category-social tag-advertising'>{BODY}</article>",
    f"<div id='main-with-comments'>{BODY}<div class='comments'><p>{LONG}</p></div></div>",
    f"<div class='no-sidebar'>{BODY}</div>",
    f"<article>{BODY}</article><div class='comments'>{BODY * 5}</div>",
    f"<div>{BODY}</div><div>" + "<article><a>Read</a><b>on</b></article>" * 6 + "</div>",
]


@pytest.mark.parametrize("html", WRAPPED)
def test_names_do_not_lose_the_article(html):
    got = main_text(f"<body><nav><a>Home</a></nav>{html}<footer>f</footer></body>")
    assert got == TEXT


def expected(html):
    """The article of the given template, taken apart by hand."""
    inner = re.search(r"<article>(.*)</article>", html, re.S).group(1)
    inner = re.sub(r"<(div|section|aside|form|ul)[^>]*(class|id)=[^>]*>.*?</\1>", "\n", inner, flags=re.S)
    blocks = re.split(r"</?(?:p|h\d|div|li|ul|article|section)[^>]*>", inner)
    texts = (" ".join(unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_given_pages(spark, sf):
    from staytide.llm.queries import QUERIES

    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op4_html_text"](spark, sf).collect()
    assert len(rows) == len(html)
    good = sum(r.text == expected(html[r.page_id]) for r in rows)
    assert good >= 0.99 * len(rows)
    assert all(r.n_chars == len(r.text) for r in rows)


def test_edges(spark):
    rows = [(1, "u", None, "old"), (None, None, "", "old"), (1, "u", "<p>x</p>" * 30000, "old"), (1, "u", None, "old")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 0, 59999]
    assert extract(df.limit(0)).count() == 0


def test_deep_and_broken():
    assert main_text("<div>" * 3000 + "x" + "</span>" * 10) == "x"
    assert main_text("<a <b>c</p></p>&#xfffffff;<<>") is not None


def test_depth_takes_time_in_proportion():
    import time

    text = "Words of the article, long enough to count as one. " * 20
    for tag in ("<div>", "<div class='wrap sidebar-left'>", "<span>", "<article>", "<li>", "<p>"):
        name = tag[1:].split()[0].rstrip(">")
        began = time.time()
        found = main_text(tag * 16_000 + text + f"</{name}>" * 16_000 + "<p>" * 100 + "</b>" * 16_000)
        assert time.time() - began < 2, tag
        assert found == text.strip(), tag
