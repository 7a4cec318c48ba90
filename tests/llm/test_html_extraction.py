"""The parser, the decoding against all choices, held-out layouts, the table's own pages, and odd rows."""

import itertools
import random
import re
from html import unescape

import numpy as np
import pytest

from larkspur.llm import html_extraction as hx
from larkspur.llm.queries import op7_html

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def trees(spark):
    return hx.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def blocks(source):
    return [(hx.parse(source).tags[n], t) for n, t, _ in hx.parse(source).blocks]


def test_parser():
    assert blocks("<p>a <b>b</b>c<br>d<p>e&amp;f &copy;</p>tail") == [("p", "a bc d"), ("p", "e&f ©"), ("html", "tail")]
    assert blocks("<div><p><b>one<br><p>two</div><p>three") == [("p", "one"), ("p", "two"), ("p", "three")]
    assert blocks("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>x") == [("li", "a"), ("li", "b"), ("li", "c"), ("li", "d"), ("html", "x")]
    assert blocks("<script>var t='</p>';<p>x</script><style>p</style>y<!-- <p>no --><p title='a>b'>z") == [("html", "y"), ("p", "z")]
    assert blocks("a<p>b<!-- never ends <p>c") == [("html", "a"), ("p", "b")]
    assert blocks("plain < text & more") == [("html", "plain < text & more")]
    assert blocks(None) == blocks("") == []
    page = hx.parse("<div>" * 3000 + "deep")
    assert page.blocks[0][1] == "deep" and page.ends[0] == len(page.tags) == 3001


def test_decoding_is_the_best_choice():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randrange(2, 9)
        parents = [-1] + [rng.randrange(max(0, i - 3), i) for i in range(1, n)]
        # preorder numbers
        order, stack = [], [0]
        kids = {i: [j for j in range(n) if parents[j] == i] for i in range(n)}
        while stack:
            x = stack.pop()
            order.append(x)
            stack += reversed(kids[x])
        number = {x: k for k, x in enumerate(order)}
        par = [-1 if parents[x] < 0 else number[parents[x]] for x in order]
        ends = [0] * n
        for i in range(n - 1, -1, -1):
            ends[i] = max([i + 1, *(ends[j] for j in range(n) if par[j] == i)])
        page = hx.Page(["div"] * n, par, [frozenset()] * n, ends, [(i, "x" * rng.randrange(1, 300), 0) for i in range(n)])
        odds = np.array([rng.uniform(-3, 3) for _ in range(n)])
        weight = odds * (0.2 + np.minimum(np.array([len(t) for _, t, _ in page.blocks]) / 40, 4.0))
        allowed = [c for c in itertools.product([False, True], repeat=n) if c[0] and all(not c[i] or par[i] < 0 or c[par[i]] for i in range(n))]
        best = max(allowed, key=lambda c: sum(w if k else -w for w, k in zip(weight[1:], c[1:])))
        assert hx.decode(page, odds).tolist() == list(best)


def test_held_out_layouts(trees, spark):
    words = sorted({w for r in spark.read.parquet(f"{SF}/pages.parquet").limit(20).collect() for w in re.findall(r"\w+", r.html)})
    writer, good = hx._Writer(words, 99), 0
    for _ in range(150):
        source = writer.page()
        want = [t.replace(writer.MARK, "") for _, t, _ in hx.parse(source).blocks if writer.MARK in t]
        page = hx.parse(source.replace(writer.MARK, ""))
        good += hx.extract(page, trees.log_odds(hx.features(page))) == "\n\n".join(want)
    assert good >= 135


def test_query_on_the_tables_pages(spark):
    def plain(source):
        inner = source[source.index("<article>") + 9 : source.index("</article>")]
        parts = [" ".join(unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split("</?p>|</?h1>", inner)]
        return "\n\n".join(x for x in parts if x)

    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op7_html(spark, SF).collect()
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in rows)
    assert sum(r.text == plain(pages[r.page_id].html) for r in rows) >= 0.97 * len(rows)


def test_odd_rows(spark, trees):
    body = "<p>" + "The long story of the matter goes on. " * 8 + "</p>"
    texts = [None, "", "<html><nav><a href=1>x</a></nav></html>", f"<nav><a href=/>Home</a></nav><article>{body}</article><footer>&copy; x</footer>", "<article>" + body * 2000, "<<<>>><p", f"<article>{body}</article>"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "page_id long, html string, text int")
    out = {r.page_id: r.text for r in hx.main_text(df, trees).collect()}
    story = ("The long story of the matter goes on. " * 8).strip()
    assert out[0] == out[1] == "" and out[2] == "" and out[3] == out[6] == story and out[4] == "\n\n".join([story] * 2000)
    assert hx.main_text(df, trees).columns == ["page_id", "html", "text"] and hx.main_text(df.limit(0), trees).count() == 0
