from html import unescape

import numpy as np
import pytest

from tallyloom.llm import html
from tallyloom.llm.html import extracted, main_text, op9_line_blocks, parts_of, window_sums

LONG = "This is a sentence of a paragraph that is long enough to be one of the text."
PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Site &amp; name</header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie notice">We use cookies</div>
<article class="post"><h1>A title</h1><p>First   paragraph with <b>bold</b>
text &amp; more &#233;.</p><div class="ad">Buy now</div><p>Second<br>line.</p><aside>Related</aside><form><p>Mail</p></form></article>
<div id="comments"><p>Nice text, I liked it very much indeed, thank you for writing all of it</p></div><footer>Imprint</footer></body></html>"""


def test_an_article():
    assert main_text(PAGE) == "A title\n\nFirst paragraph with bold text & more é.\n\nSecond line."


def test_windows_surge_and_dive():
    lengths = np.array([9, 0, 0, 0, 30, 5, 40, 0, 2, 0, 0, 0, 7])
    brute = [int(lengths[i : i + html.WINDOW].sum()) for i in range(len(lengths))]
    assert window_sums(lengths).tolist() == brute
    # the surge is the first window over SURGE, the dive the first empty one
    assert parts_of(lengths) == [(4, 9, 75)]
    assert parts_of(np.array([3, 0, 0, 0, 4])) == [(0, 1, 3), (4, 5, 4)]
    assert parts_of(np.zeros(0, np.int64)) == [] and parts_of(np.zeros(5, np.int64)) == []


MENU = "<div><a href=1>One</a></div><div><a href=2>Two</a></div><div><a href=3>Three</a></div>"
BARE = f"<body>{MENU}<div>Site</div>{MENU}<h2><a href=x>A linked title</a></h2><p>{LONG}</p><p>Ok.</p><p>{LONG}</p>{MENU}<div>Imprint 2020</div></body>"


def test_without_an_article_the_distribution_decides():
    assert main_text(BARE) == f"A linked title\n\n{LONG}\n\nOk.\n\n{LONG}"
    # a further part counts if its peak is near enough to the highest
    assert main_text(BARE.replace("Imprint 2020", LONG)) == f"A linked title\n\n{LONG}\n\nOk.\n\n{LONG}\n\n{LONG}"


@pytest.mark.parametrize(("window", "surge"), [(1, 60), (3, 10**6), (3, 2), (50, 60)])
def test_window_and_surge_matter(monkeypatch, window, surge):
    pages = [BARE, f"<p>{LONG}</p>{MENU}<p>{LONG}{LONG}</p>", f"<p>Short words here.</p>{MENU}<p>{LONG}</p>"]
    before = [main_text(p) for p in pages]
    monkeypatch.setattr(html, "WINDOW", window)
    monkeypatch.setattr(html, "SURGE", surge)
    assert [main_text(p) for p in pages] != before


def test_broken_heads_and_elements():
    assert main_text(f"<html><head><title>T</title><body><p>{LONG}</p>") == LONG
    assert main_text(f"<html><head><title>T<body><p>{LONG}</p>") == LONG
    assert main_text(f"<p>{LONG}<svg/> after</p><p>{LONG}") == f"{LONG} after\n\n{LONG}"
    assert main_text(f"<p>{LONG}<svg><title>x</title><text>y</text></svg></p>") == LONG
    assert main_text(f"<p>{LONG} <math><mi>x</mi>=<mn>1</mn></math></p>") == f"{LONG} x=1"
    assert main_text(f"<div><p class=ad>Buy now<p>{LONG}</p><p>{LONG}</p></div>") == f"{LONG}\n\n{LONG}"
    assert main_text(f"<ul><li class=share>Tell<li>{LONG}<li>{LONG}</ul>") == f"{LONG}\n\n{LONG}"
    assert main_text(f"<table><tr><td>{LONG}<td>Two<tr><td>Three</table>") == f"{LONG}\n\nTwo\n\nThree"
    assert main_text("<article><p>One <b>two<p>three</article>") == "One two\n\nthree"
    assert main_text("<p title='a > b'>x < y &lt; z</p>") == "x < y < z"
    assert main_text(f"<p title=\"it's>\">{LONG}</p><a href='x>y</p>") .startswith(LONG)


@pytest.mark.parametrize("name", "share search social related banner has-sidebar no-ads with-comments comments layout".split())
def test_a_named_wrapper_never_hides_the_text(name):
    assert main_text(f"<body><nav><a href=x>Home</a></nav><div class='{name}'><p>{LONG}</p></div></body>") == LONG
    assert main_text(f"<body><div>Site</div><div class='page {name}'><article><h1>T</h1><p>{LONG}</p></article></div></body>") == f"T\n\n{LONG}"
    assert main_text(f"<div class='page {name}'><h1>T</h1><p>{LONG}</p><div class=sidebar>{LONG}</div></div>") == f"T\n\n{LONG}"


def test_what_surrounds_goes_even_if_it_is_longer():
    assert main_text(f"<h1>T</h1><p>{LONG}</p><div class=comments><p>{LONG * 9}</p></div>") == f"T\n\n{LONG}"
    assert main_text(f"<main><article><h1>T</h1></article><section id=comments><article class=comment>{LONG}</article></section></main>") == "T"
    assert main_text(f"<body><ul class=menu><li>a</li><li>b</li></ul><div><p>{LONG}</p><p>{LONG}</p></div><div class='footer'><p>{LONG}</p></div></body>") == f"{LONG}\n\n{LONG}"
    assert main_text(f"<div>{LONG * 5}</div><article><p>a</p><p>b</p></article>") == "a\n\nb"
    assert main_text(f"<form><div><p>{LONG}</p></div></form>") == LONG


@pytest.mark.parametrize("names", ["class=commentlist", "class='thread commentlist'", "id=commentsection", "class=comments"])
def test_reader_comments_go_within_the_text_too(names):
    shown = f"<main><h1>T</h1><p>{LONG}</p><ol {names}><li><p>Nice: {LONG}</p></li><li>Me too, {LONG}</li></ol></main>"
    assert main_text(shown) == f"T\n\n{LONG}"
    assert main_text(f"<article><p class=commentary>{LONG}</p></article>") == LONG


def test_nothing_to_extract():
    assert [main_text(p) for p in (None, "", "<html></html>", "<script>x</script>", "<!-- x", "<nav>a</nav>")] == [""] * 6
    assert main_text("plain words") == "plain words"


def test_very_long_pages():
    n = 20_000
    assert main_text("<div>" * n + LONG).endswith(LONG)
    assert main_text(f"<article>{f'<p>{LONG}</p>' * n}</article>").count("\n\n") == n - 1
    assert main_text(f"<p>{'word ' * 500_000}</p>").count(" ") == 499_999


def test_every_page_and_other_columns(spark):
    folder = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = op9_line_blocks(spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        page = pages[r["page_id"]]
        # these pages' articles hold blocks and nothing else
        article = page[page.index("<article>") + 9 : page.index("</article>")]
        for tag in ("<h1>", "</h1>", "<p>", "</p>"):
            article = article.replace(tag, "\0")
        blocks = [" ".join(unescape(b.replace("<br>", " ").replace("<b>", "").replace("</b>", "")).split()) for b in article.split("\0")]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
    df = spark.createDataFrame([(1, PAGE, "x", 3), (1, PAGE, "x", 3), (2, None, None, None)], "page_id long, html string, text string, other int")
    found = extracted(df)
    assert found.columns == ["page_id", "other", "text", "n_chars"]
    assert sorted(r["n_chars"] for r in found.collect()) == [0, len(main_text(PAGE)), len(main_text(PAGE))]
    assert extracted(df.limit(0)).count() == 0
