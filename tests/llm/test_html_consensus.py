"""Main texts of given pages, of other layouts, and of broken markup."""

import html
import re

from corpus_fixtures import table  # noqa: F401

from tillwright.llm import html_consensus as hc

PAGES = "page_id long, url string, html string, host string, text string, score double, path string"


def texts(spark, *sources, url="http://h.example/1"):
    rows = [(i, url, s, "x", "x", 0.0, "x") for i, s in enumerate(sources)]
    return [r.text for r in hc.main_texts(spark.createDataFrame(rows, PAGES)).orderBy("page_id").collect()]


def test_the_table(table):
    pages = table("pages")
    got = {r.page_id: (r.text, r.n_chars) for r in hc.main_texts(pages).collect()}
    for page in pages.collect():
        article = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|br|h1)>", " ", article))
        want = " ".join(html.unescape(plain).split())
        assert got[page.page_id] == (want, len(want))
    assert len(got) == pages.count()


CHROME = """<html><head><title>T</title><style>p{}</style></head><body>
<header class="site-header"><a href="/">Home</a></header><div id="top-menu"><ul><li>Menu<li>More</ul></div>
<div class="cookie-notice"><p>We use cookies, a long notice that tells nobody anything at all about them.</p></div>
<div class="wrap"><div class="post-content c12">%s</div>
<div class="sidebar"><p>Popular things to read in a sidebar with many words in it.</p></div>
<div id="comments"><div class="comment"><p>First! A reader wrote this comment and it is rather long, too.</p></div></div></div>
<form><p>Subscribe</p><input name=q></form><footer>&copy; us</footer><script>var a = "<p>not text</p>";</script></body></html>"""


def test_other_layouts(spark):
    body = "<h2>Head &amp; line</h2><p>One <b>bo</b>ld\n word&nbsp;here<br>next</p><!-- <p>no</p> --><div class='ad-box'>Buy!</div><ul><li>a<li>b</ul><p>1 &lt; 2"
    want = "Head & line One bold word here next a b 1 < 2"
    assert texts(spark, *[CHROME % body.replace("c12", f"c{i}") for i in range(3)]) == [want] * 3


def test_the_host_agrees_against_one_odd_page(spark):
    pages = [f"<body><div class=x{i}><p>The long text of the page {i}.</p><p>More of it, and on.</p></div><div class=extra><p>short {i}</p></div></body>" for i in range(8)]
    odd = "<body><div class=x9><p>Small.</p></div><div class=extra><p>A very long extra box on this page only, by far the longest.</p></div></body>"
    assert texts(spark, *pages, odd) == [*(f"The long text of the page {i}. More of it, and on." for i in range(8)), "Small."]


def test_broken_markup(spark):
    sources = [None, "", "   ", "plain words", "<p>a<p>b", "<article>x</article", "<article><p>a <b>c</article><p>", "<", "<script>no end <p>text</p>",
               "<article>" + "<div>" * 3_000 + "deep" + "</article>", '<article title="a > b"><p>q</p></article>', "<article><p>" + "w " * 200_000 + "</p></article>",
               "<article><table><tr><td>1<td>2<tr><td>3</table></article>", "<article><p>&#65;&bogus;&#x1F600;</article>"]
    got = texts(spark, *sources, url=None)
    assert got[:7] == ["", "", "", "plain words", "a b", "x", "a c"]
    assert got[9:11] == ["deep", "q"] and len(got[11]) == 399_999 and got[12:] == ["1 2 3", "A&bogus;😀"]


def test_joined_hosts_give_the_same(table, monkeypatch):
    pages = table("pages").limit(60)
    sent = sorted(map(tuple, hc.main_texts(pages).collect()))
    monkeypatch.setattr(hc, "SENT_HOSTS", 0)
    assert sorted(map(tuple, hc.main_texts(pages).collect())) == sent


def test_empty_table_and_null_ids(spark):
    assert hc.main_texts(spark.createDataFrame([], PAGES)).collect() == []
    rows = spark.createDataFrame([(None, None, "<p>a", None, None, None, None)] * 2, PAGES)
    assert [tuple(r) for r in hc.main_texts(rows).collect()] == [(None, None, "a", 1)] * 2
