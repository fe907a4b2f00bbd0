import re
from html.parser import HTMLParser

import pytest

from boardwise.llm import html_text as H
from boardwise.llm import queries
from boardwise.llm.page_samples import PAGES

from .cases import LONG, clashing

SF = "/root/testdata/sf0.001"


class Article(HTMLParser):
    """Lines of the article element, for pages that have just one."""

    def __init__(self):
        super().__init__()
        self.on, self.lines = False, [""]

    def handle_starttag(self, tag, attrs):
        self.on = self.on or tag == "article"
        if tag in ("p", "h1", "article"):
            self.lines.append("")

    def handle_endtag(self, tag):
        self.on = self.on and tag != "article"
        if tag in ("p", "h1"):
            self.lines.append("")

    def handle_data(self, data):
        if self.on:
            self.lines[-1] += data


def brute(page):
    a = Article()
    a.feed(page or "")
    a.close()
    lines = [re.sub("[ \t-\r]+", " ", x).strip(" ") for x in a.lines]
    return "\n".join(x for x in lines if x)


@pytest.fixture(scope="module")
def tree(spark):
    return H.train(H.labelled_blocks(spark))


def texts(spark, tree, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    return [r.text for r in H.extract_text(df, "page_id", tree=tree).orderBy("page_id").collect()]


def test_query_gives_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op11_html_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, brute(pages[r.page_id].html), len(r.text))


def test_labels_of_pages_left_out_of_the_training(spark):
    right = every = 0
    for k, page in enumerate(PAGES):
        own = H.train(H.labelled_blocks(spark, PAGES[:k] + PAGES[k + 1 :]))
        found = H.blocks(page)
        judged = own.judge(H.features(found))
        right, every = right + sum(bool(j) == b[6] for j, b in zip(judged, found)), every + len(found)
    assert right / every >= 0.9


def test_all_that_is_no_main_text_goes(spark, tree):
    page = """<!DOCTYPE html><html><head><title>T</title><script>if (a<b) document.write("<p>no</p>");</script><style>p{}</style></head><body class="post page">
    <header><a href=/>Logo</a><p>The best page of all that there are</p></header><nav><ul><li>One<li>Two</ul></nav>
    <div role="dialog" class=cookieConsent><p>This page keeps cookies on your machine, and there is nothing you can do.</p><button>Agree</button></div>
    <!-- <article><p>not this</p> --><article><header><h1>Caf&eacute; &amp; Bar</h1></header><p>One   two
    <b>thr</b>ee<br>four &#x263A; &lt;p&gt;</p><noscript>no</noscript><textarea><p>no</p></textarea><ul><li>Item <li><a href="x">Link</a></ul><p title="a > b">Short.</p>
    <div class="ad-box ad"><p>Buy this now, it is the best thing that you will ever see in your life.</p></div>
    <section id="comments"><p>I read the whole text and I do not agree with a single word of it.</p></section></article>
    <aside><p>Other texts that you might like to read, and there are many of them here.</p></aside>
    <form action=x><p>Write to us</p><select><option>no</select></form><footer>&copy; all of us</footer></body></html>"""
    assert texts(spark, tree, page) == ["Café & Bar\nOne two three four ☺ <p>\nItem\nLink\nShort."]


def test_pages_without_marks_go_by_words_and_links(spark, tree):
    long = "There is a long text in this place, of more than twenty words, which says what there is to be said of the matter at hand and a little more."
    page = f'<div><a href="/">Home</a> <a href="/n">News</a></div><div>{long}</div><div>{long} <a href="/s">Source</a></div><div><a href="/i">Imprint</a></div>'
    assert texts(spark, tree, page) == [f"{long}\n{long} Source"]


def test_broken_empty_and_long_pages(spark, tree):
    many = "".join(f"<p>{w}</p>" for w in LONG.split())
    open_quote = "<article><p>a</p><p class='x>b</p>" + "<p>c</p>" * 20000 + "</article>"
    got = texts(spark, tree, None, "", " ", "no markup", "<", "<article><p>cut off &am", f"<article>{many}</article>", "<article><p>a<script>never closed <p>b", "a" * 10 + "<" * 20000, open_quote)
    assert got[:3] == ["", "", ""] and got[5] == "cut off &am" and got[6] == "\n".join(LONG.split()) and got[7] == "a"
    assert got[9].startswith("a\nb\nc\nc") and len(got[9].split()) == 20002


def test_tables(spark, tree):
    df = spark.createDataFrame([(1, "u", PAGES[0]), (1, "u", PAGES[0]), (None, None, None)], "page_id long, url string, html string")
    got = H.extract_text(clashing(df), "page_id", "url", tree=tree)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted(r.n_chars > 0 for r in got.collect()) == [False, True, True]
    assert H.extract_text(df.limit(0), "page_id", tree=tree).count() == 0
