"""Page text on small pages, and on all pages against what their articles hold."""

import html as H
import re
import time

import pytest

from riskloom.llm.html_extract import extract, extract_pages
from tests.conftest import SF_ORACLE


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain, text", "plain, text"),
        ("<p>a<p>b", "a\nb"),
        ("<body><nav><a href=x>menu, menu, menu</a></nav><article><h1>T</h1><p>One &amp; two</p></article><footer>f, f, f</footer>", "T\nOne & two"),
        ("<div class=sidebar><p>no, no, no</div><div id=content><p>One, two<p>Four <a href=x>five</a>.<ul><li>a<li>b</ul></div><div class='comments'><p>c, c, c, c, c</div>", "One, two\nFour five.\na\nb"),
        ("<article><p>One\n  two<br>three</p><script>var x='</p>';</script><style>p{}</style><form><p>form</p></form></article>", "One two three"),
        ("<article><p>cut &am", "cut &am"),
        ("<article><p>a < b &lt; c</p></article>", "a < b < c"),
        ("<main><section><h2>A</h2><p>Long, text</p></section><section><p>Other</p></section><aside>no</aside></main>", "A\nLong, text\nOther"),
        ("<article><p><b>bold<br><p>next</p><div role='complementary'>no</div></article>", "bold\nnext"),
        ("<nav><ul><li>x<li>y</ul></nav>", ""),
    ],
)
def test_pages(page, text):
    assert extract(page or "") == text


def test_all_pages(spark):
    pages = spark.read.parquet(f"{SF_ORACLE}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    got = extract_pages(pages).collect()
    assert len(got) == len(raw)
    for r in got:
        article = re.search(r"<article>(.*?)(</article>|\Z)", raw[r.page_id], re.S)[1]
        article = re.sub(r"</?b>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\x00", article)))
        blocks = (re.sub(r"\s+", " ", H.unescape(x)).strip() for x in article.split("\x00"))
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "u", "<p>a, b", "t", 3), (1, "u", "<p>a, b", "t", 3), (None, None, None, None, None), (2, "u", "<div>" * 3000 + "deep", "t", 1), (3, "u", "<p>" + "long, text " * 20_000, "t", 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted((str(r.page_id), r.n_chars) for r in extract_pages(frame).collect())
    assert got == [("1", 4), ("1", 4), ("2", 4), ("3", 219_999), ("None", 0)]
    assert extract_pages(frame.limit(0)).count() == 0


BODY = "<h1>T</h1><p>One, two, three</p><p>Four, five, six</p>"
PLAIN = "T\nOne, two, three\nFour, five, six"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><div class='content with-sidebar'>{BODY}</div></body>", PLAIN),
        (f"<body><div class='post social-post'><article>{BODY}</article><div class=comments><p>c, c, c</p></div></div></body>", PLAIN),
        (f"<body><form id=aspnet action=x><nav>n</nav><div>{BODY}</div><div class=sidebar><p>no, no</p></div></form></body>", PLAIN),
        (f"<body><form><fieldset><main>{BODY}</main></fieldset></form><footer>f</footer><p>imprint <a href=x>here</a></p></body>", PLAIN),
        (f"<article>{BODY}</article><div class=related><article><p>card, card, card</p></article></div><div class=comments><p>{'c, ' * 40}</p></div>", PLAIN),
        ("<div id=sidebar><ul><li>a<li>b</ul></div>", "a\nb"),
        ("<div hidden><p>a, b, c</p></div>", ""),
        (
            "<div><section><p>" + "Long, text. " * 40 + "</p></section><h2>Sub</h2><ul><li>a</ul><blockquote>q</blockquote><table><tr><td>t</table>"
            "<section><p>Short</p></section><div class=share><p>no</p></div><ul><li><a href=x>link</a></ul></div>",
            "Long, text. " * 39 + "Long, text.\nSub\na\nq\nt\nShort",
        ),
        ("<div><h3>Head</h3><div><p>" + "Long, text. " * 40 + "</p></div></div>", "Head\n" + "Long, text. " * 39 + "Long, text."),
        (f"<div class='content with-sidebar'>{BODY * 4}</div><section><article><a href=x>card</a></article></section>", "\n".join([PLAIN] * 4)),
    ],
)
def test_sections_in_doubt_and_siblings(page, text):
    assert extract(page) == text


LONG = "Long, text. " * 40
WHOLE = f"T\n{LONG.strip()}"


@pytest.mark.parametrize("name", ["nav", "header", "aside", "footer", "menu"])
def test_sections_without_an_end(name):
    article = f"<article><h1>T</h1><p>{LONG}</p></article>"
    assert extract(f"<body><{name}><a href=x>Home</a>{article}</body>") == WHOLE
    assert extract(f"<body><div><{name}><ul><li><a href=x>Home</a></div><div><h1>T</h1><p>{LONG}</p></div></body>") == WHOLE
    assert extract(f"<body><{name}><p>x</p></{name}>{article}<{name}>last") == WHOLE
    assert extract(f"<body><{name}><a href=x>a</a><main><h1>T</h1><p>{LONG}</p></main></{name}></body>") == WHOLE
    assert extract(f"<body>{article}<{name}><article><p>card, card</p></article></{name}>") == WHOLE
    assert extract(f"<{name}><p>{LONG}</p>") == LONG.strip()  # nothing else on the page


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><p>He said <span class='search-term'>hello world</span> to all</p><p>{LONG}</p></article>", f"He said hello world to all\n{LONG.strip()}"),
        (f"<article><p>He said <span class=share>hello to all<p>{LONG}</p></article>", f"He said hello to all\n{LONG.strip()}"),
        (f"<article><p>a <span hidden>b <span>c</span> d</span> e</p><p>{LONG}</p></article>", f"a e\n{LONG.strip()}"),
        (f"<article><p>a <span hidden>b</p><p>{LONG}</p></article>", f"a\n{LONG.strip()}"),
        (f"<article><p hidden>a<p>{LONG}</article>", LONG.strip()),
        (f"<article><ul class='search-tips'><li>a<li>b</ul><p>{LONG}</p></article>", f"a\nb\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p><div class='share-buttons'><p>no</p></div><div class='related posts'><p>no</p></div><div class='site-header'>no</div></article>", LONG.strip()),
        (f"<head><title>no</title><meta charset=utf-8><body><article><h1>T</h1><p>{LONG}</p></article>", WHOLE),
    ],
)
def test_names_and_inline_elements(page, text):
    assert extract(page) == text


@pytest.mark.parametrize("name", ["div", "div hidden", "li", "blockquote", "div class=share", "article", "nav"])
def test_nesting_takes_time_in_proportion(name):
    start = time.process_time()
    extract(f"<{name}>x, y" * 50_000 + f"<p>{LONG}</p>" + "</p></li></td>" * 50_000)
    assert time.process_time() - start < 20
