from html.parser import HTMLParser

import pytest

from logloom.llm.html import extract, main_text

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Home</a></li><li><a href="/y">News and more</a></li></ul></nav><header class="site-header"><h2>Site</h2></header>
<div class="cookie-notice">We use cookies</div><!-- ad 0 --><div class="ad">Buy now</div>
<article><header><h1>Title &amp; more</h1></header><p><b>Lead  text&nbsp;here.<br>
<p>Second&#160;para &lt;tag&gt;
 goes on.</p><p>Be.</p><ul><li>One <a href="z">two</a></li></ul><div class="share-buttons">Share this</div></article>
<aside>Side bar text that is quite long and has many words in it</aside><section id="comments"><p>First! I really like this article very much indeed.</p></section>
<form><p>Your mail</p></form><footer>&copy; x</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == "Title & more\n\nLead text here.\n\nSecond para <tag> goes on.\n\nBe.\n\nOne two"


def test_broken_markup():
    assert main_text("<body><nav><li>Menu</nav><article><p>A<p>B</p><p>C") == "A\n\nB\n\nC"
    assert main_text("<article><p>x < y & z</p></article>") == "x < y & z"
    assert main_text("<p>only &eacute;</p>") == "only é"


def test_without_article_marks():
    long = "This is a long paragraph of running text with a lot of words in it. " * 4
    page = f"<div><ul><li><a href=1>A</a></li><li><a href=2>B</a></li></ul><p>{long}</p><p>Short.</p><p>{long}</p></div><div class=footer>Imprint</div>"
    assert main_text(page) == "\n\n".join([long.strip(), "Short.", long.strip()])


def test_one_long_paragraph_silences_no_other():
    para = [f"{k} " + "words of an ordinary paragraph " * 10 for k in range(12)]
    text = ["start " * 2_000, *para[:6], "A", "B", "C", "D", "E", *para[6:]]
    page = "<div><ul><li><a href=1>Home</a></li></ul>" + "".join(f"<p>{x}</p>" for x in text) + "</div>" + "<p><a href=2>A link to more</a></p>" * 4 + "<p>Imprint</p>"
    assert main_text(page) == "\n\n".join(x.strip() for x in text)


def test_edges(spark):
    assert main_text(None) == main_text("") == main_text("<html></html>") == main_text("<nav>x</nav>") == ""
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "u", "<article>" + "<p>word</p>" * 20000 + "</article>", "y")], "page_id long, url string, html string, text string")
    rows = extract(df).collect()
    assert len(rows) == 4 and {r.n_chars for r in rows} == {0, len(main_text(PAGE)), 20000 * 4 + 19999 * 2}
    assert extract(df.limit(0)).count() == 0


P = "<p>This is a paragraph of the real body with a good number of words in it, long enough to count.</p>"
NAV = "<nav><a href=1>Home</a> <a href=2>News</a></nav>"
LINKY = "<p><a href=1>See the whole report of the committee here</a> now.</p>"
BODY = P[3:-4]


@pytest.mark.parametrize(
    "page, want",
    [
        (f'{NAV}<div class="content has-sidebar"><article>{P}{P}</article></div>', [BODY] * 2),
        (f"<form action=x>{NAV}<article>{P}{P}</article></form>", [BODY] * 2),
        (f"<form action=x>{NAV}<div>{P}{P}</div><input></form>", [BODY] * 2),
        (f"<div>{P}{P}</div><form><p>Your mail address, please, and your name too</p></form>", [BODY] * 2),
        (f"<article>{P}{LINKY}{P}</article>", [BODY, "See the whole report of the committee here now.", BODY]),
        (f"{NAV}<div>{P}{LINKY}{P}</div>", [BODY, "See the whole report of the committee here now.", BODY]),
        *[(f"<article>{P}<{x}>{P}</article>", [BODY] * 2) for x in ("object data=x", "svg width=1", "select><option", "iframe src=x")],
        (f'<article>{P}<section id="share-price">{P}</section><div class="share-buttons">Share</div></article>', [BODY] * 2),
        (f"{NAV}<div>{P * 3}<p>b.</p><p>c.</p><p>d.</p><p>Short end.</p></div><div class='site-footer'>x</div>", [BODY] * 3 + ["b.", "c.", "d.", "Short end."]),
        (f"{NAV}<div>{P}<p>a.</p><p>b.</p><p>c.</p><p>d.</p><p>e.</p>{P}</div>", [BODY, "a.", "b.", "c.", "d.", "e.", BODY]),
        (f'<article class="card"><p>Teaser</p></article><div class="main">{P * 3}</div>', [BODY] * 3),
        (f"<div><h1>Title</h1></div><div>{P}{P}</div>", ["Title", BODY, BODY]),
        ("<div>" * 3000 + P + "</div>" * 3000, [BODY]),
    ],
)
def test_pages_of_other_layouts(page, want):
    assert main_text(f"<html><body>{page}</body></html>") == "\n\n".join(want)


class _Article(HTMLParser):
    """The blocks of the article of a page of the tables, by another parser."""

    LINES = frozenset("p h1 h2 h3 h4 ul ol li div section article blockquote pre table tr td header footer".split())

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.on = self.skip = 0
        self.blocks = [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.on += tag == "article"
        self.skip += tag in ("script", "style")
        if tag in self.LINES:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in self.LINES:
            self.blocks.append("")
        self.on -= tag == "article"
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if self.on and not self.skip:
            self.blocks[-1] += data


def test_all_pages_of_a_table_against_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    want = {r.page_id: "\n\n".join(x for b in _Article(r.html or "").blocks if (x := " ".join(b.split()))) for r in pages.collect()}
    assert len(got) == len(want) and sum(got[k] != want[k] for k in want) == 0
