"""Page extraction: exact marginals, held-out pages, the table's articles and odd pages."""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from twinroute.llm import html_extraction as hx
from twinroute.llm import labelled_pages, page_tree, tables


def blocks(page, marked=False):
    tree = page_tree.parse(page)
    return page_tree.block_texts(tree, hx.labels(tree) if marked else [True] * len(tree.tag))


@settings(max_examples=40, deadline=None)
@given(st.data())
def test_marginals_equal_enumeration(data):
    n = data.draw(st.integers(1, 7))
    parent = np.array([-1, *(data.draw(st.integers(0, k)) for k in range(n - 1))])
    r = np.random.default_rng(data.draw(st.integers(0, 1000)))
    unary, pair, kind = r.normal(size=(n, 2)), r.normal(size=(hx.RELATIONS, 2, 2)), r.integers(0, hx.RELATIONS, n)
    depth = np.zeros(n, int)
    for v in range(1, n):
        depth[v] = depth[parent[v]] + 1
    none = np.zeros(0, np.int64)
    wood = hx.Forest(parent, [np.flatnonzero(depth == d) for d in range(depth.max() + 1)], kind, none, none, np.zeros(0), np.array([0, n]))
    p, edge = hx.sum_product(wood, unary, pair)
    want, want_edge = np.zeros((n, 2)), np.zeros((n, 2, 2))
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(unary[v, y[v]] for v in range(n)) + sum(pair[kind[v], y[parent[v]], y[v]] for v in range(1, n)))
        for v in range(n):
            want[v, y[v]] += w
            if v:
                want_edge[v, y[parent[v]], y[v]] += w
    total = want[0].sum()
    assert np.allclose(p, want / total) and np.allclose(edge, want_edge / total)


def test_held_out_pages():
    held = labelled_pages.pages(150, 4242)
    got = hx.main_texts(held, hx.trained())
    want = [blocks(p, marked=True) for p in held]
    met = sum(sum((Counter(w) & Counter(g.split("\n"))).values()) for w, g in zip(want, got))
    assert met > 0.97 * sum(map(len, want)) and met > 0.97 * sum(len(g.split("\n")) for g in got if g)


def test_query_equals_articles_of_the_table(spark, sf):
    def article(page):
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        inner = re.sub("</?b>", "", inner.replace("<br>", " "))
        return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in re.split("</?(?:p|h1)>", inner)) if x)

    got = {r["page_id"]: r for r in hx.op13_html_extraction(spark, sf).collect()}
    pages = tables.table(spark, sf, "pages").collect()
    assert {r["page_id"]: (r["url"], article(r["html"])) for r in pages} == {k: (r["url"], r["text"]) for k, r in got.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_parser():
    assert blocks("<p>a <b>b\n c</b><p>d&amp;&nbsp;e<br>f &#8364;") == ["a b c", "d& e f €"]
    assert blocks("<ul><li>x<ul><li>y<li>z</ul><li>w</ul>") == ["x", "y", "z", "w"]
    assert blocks("<table><tr><td>1<td>2<tr><th>3</table>tail") == ["1", "2", "3", "tail"]
    assert blocks("a<script>if (1 < 2) '</p>'</script>b<style>x</style><!-- <p>no --> c<textarea><b></textarea>d") == ["ab cd"]
    assert blocks("<div>a</span></p>b</div></div>c<") == ["a", "b", "c<"]
    assert blocks("<div hidden>no</div><div style='display: none'>no</div><p title='a>b'>yes</p><p data-x=1>1 < 2</p>") == ["yes", "1 < 2"]
    assert blocks("<dl><dt>t<dd>d</dl><h1>h<h2>i</h2>") == ["t", "d", "h", "i"]
    assert blocks("<html><head><title>t</title><body>x") == ["x"] and blocks("<div class=\"a>b</div>") == ["b"]


CASES = {
    "clear parts": (
        '<header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div id="cookie-consent"><p>We use cookies, as you know. You agree.</p></div>'
        "<main><h1>Title</h1><p>First part, with words. It goes on.</p><p>Short.</p></main><aside><p>Another story, here. Read it.</p></aside>"
        '<section class="comments"><h2>Comments</h2><div class="comment"><p>Great one! I liked it a lot, thanks.</p></div></section><footer>Copyright 2020</footer>',
        "Title\nFirst part, with words. It goes on.\nShort.",
    ),
    "inner parts": ('<div class="content"><h2>Head</h2>Text one.<br>Text two.<div class="share">Share on <a href=f>F</a></div><ul><li>One<li>Two</ul></div>', "Head\nText one. Text two.\nOne\nTwo"),
    "form in an article": ("<article><p>A &lt;b&gt; c&nbsp;d</p><form><p>Subscribe now to our newsletter.</p></form></article>", "A <b> c d"),
}


def test_cases():
    for page, text in CASES.values():
        assert hx.main_texts([page], hx.trained()) == [text]


def test_odd_pages_extra_columns_and_empty_table(spark):
    from pyspark.sql import functions as F

    long = "<article>" + "".join(f"<p>Line {k}, of many words. And one more.</p>" for k in range(20_000)) + "</article>"
    deep = "<article><p>top, of it. Yes.</p>" + "<div>" * 3000 + "x"
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<article><p>no id, no url. Fine.</p></article>"), (2, "u", long), (2, "u", long), (3, "u", deep), (4, "u", "<" * 5000), (5, "u", '<p a="' * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("text", "n_chars", "node", "label"):
        pages = pages.withColumn(name, F.lit("x"))
    got = hx.extract(pages).collect()
    assert len(got) == len(rows) and [r["text"] for r in got if r["page_id"] == 1] == ["", ""]
    assert [r["text"].count("\n") for r in got if r["page_id"] == 2] == [19_999] * 2
    assert next(r for r in got if r["page_id"] is None)["text"] == "no id, no url. Fine."
    assert next(r for r in got if r["page_id"] == 3)["text"].startswith("top, of it. Yes.")
    assert hx.extract(pages.limit(0)).count() == 0
