import html
import re
import time

import pytest
from paths import DATA

from siltworks.llm.html_text import extract, main_text


def plain(page):
    """The text of the page's article, by its tags alone."""
    own = re.search("<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", own))).split())


def test_pages_like_their_articles(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in extract(pages).collect()}
    want = {r.page_id: (t := plain(r.html), len(t)) for r in pages.collect()}
    assert got == want and len(got) >= 50


BODY = "<p>First paragraph, with commas, and enough words to be read as text.<p>Second <i>para</i>graph, much like the first, &amp; longer &lt;in words&gt; than that."
TEXT = "First paragraph, with commas, and enough words to be read as text. Second paragraph, much like the first, & longer <in words> than that."
MENU = "<ul><li><a href=/a>One</a><li><a href=/b>Two</a><li><a href=/c>Three</a></ul>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<html><body><header>Site</header><nav>{MENU}</nav><article><h1>Head</h1>{BODY}</article><footer>end</footer>", f"Head {TEXT}"),
        (f"<body><div id=main-content>{BODY}</div><div class='sidebar'><p>Other, things, and, more, commas, here.</div>", TEXT),
        (f"<body>{MENU}<div><h2>Head</h2><div>{BODY}</div><p>A tail.</p>{MENU}</div>", f"Head {TEXT} A tail."),
        (f"<main><article><section><p>Short.</section><section>{BODY}</section></article><div class=comments><p>I, for one, agree, as a reader.</div></main>", f"Short. {TEXT}"),
        (f"<article><script>if (a<b) document.write('<p>no</p>')</script>{BODY}<form><p>Your mail, please, and name</p><input></form><aside>see, also, this</aside></article>", TEXT),
        (f"<article>{BODY}<div hidden><p>unseen</div><p style='display:none'>unseen</p><div class='cookie-notice'>We use cookies</div>{MENU}</article>", TEXT),
        ("a <b>bold</b>er text<br>here", "a bolder text here"),
        ("<table><tr><td>a, b<td>c<tr><td>d</table>", "a, b c d"),
        ("x &amp y &notathing; &#233;&#xe9; 1 < 2 > 0", "x & y ¬athing; éé 1 < 2 > 0"),
        ("<p>open <!-- no end", "open"),
        ("<p>a  \n b</p>", "a b"),
        ("<script>only()", ""),
        ("", ""),
        (None, ""),
        ("<nav>only</nav>", ""),
    ],
)
def test_small_pages(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("page", ["<" * 500_000 + ">", "<a '" * 100_000, "<div>" * 100_000 + "x", "<p><b>" * 50_000 + "x", "<td>" + "<b>" * 30_000 + "<p></p>" * 30_000, "<!--" * 100_000, "<ul>" + "<li>a" * 50_000, '<a ">' * 100_000])
def test_long_odd_pages_take_linear_time(page):
    start = time.time()
    main_text(page)
    assert time.time() - start < 20


def test_table(spark):
    rows = [(1, "u", None, "k", "z"), (1, "u", None, "k", "z"), (None, None, f"<article>{BODY}</article>", "k", "z"), (2, "v", "word " * 200_000, None, None)]
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, N_CHARS string"))
    assert out.columns == ["page_id", "url", "text", "N_CHARS", "text_", "n_chars_"]
    got = sorted(((r.page_id or 0), r.text or "", r.text_, r.n_chars_) for r in out.collect())
    assert got == [(0, "k", TEXT, len(TEXT)), (1, "k", "", 0), (1, "k", "", 0), (2, "", ("word " * 200_000).strip(), 999_999)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
