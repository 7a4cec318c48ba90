"""The element tree, its selectors, and shop pages as rows."""

import json

import pytest
from pyspark.sql import functions as F

from larkspur.sources import dom, shops


def texts(html, selector):
    return [x.text() for x in dom.parse(html).select(selector)]


def test_open_elements_are_ended_where_they_have_to_be():
    page = "<ul id=a class='x y'><li class=i>one<li class=\"i j\" data-k='3'>two <b>bo</b>ld<ul><li>in</ul></ul><p>p1<p>p2<div>d</div></span>tail"
    assert texts(page, "#a > li") == ["one", "two bold in"] and texts(page, "p") == ["p1", "p2"] and texts(page, "ul ul > li") == ["in"]
    table = "<table><tr><th>A:<td>1<tr><th>B<td>2<table><tr><td>inner</table></table><p>after"
    assert texts(table, "tr > td") == ["1", "2 inner", "inner"] and texts(table, "p") == ["after"]
    assert texts("<dl><dt>n<dd>v<dt>m<dd>w</dl>", "dd") == ["v", "w"]
    assert texts("<select><option value=1>a<option>b</select>", "option") == ["a", "b"]
    assert dom.parse(None).text() == dom.parse("").text() == "" and dom.parse("a < b &amp; c<br/>d").text() == "a < b & c d"


def test_text_leaves_out_what_nobody_reads():
    page = "<div>see<script>if (a < b) { '<p>no</p>' }</script><style>p{}</style> it<!-- hidden --><template>x</template></div>"
    assert texts(page, "div") == ["see it"]
    assert texts("<p>a<b>b</b><br>c<div>d</div>", "p")[0] == "ab c"


@pytest.mark.parametrize("selector, want", [
    ("[data-a]", "1 2 3"), ("[data-a=x]", "1"), ('[data-a="x y"]', "2"), ("[data-a~=y]", "2"), ("[data-a^=x]", "1 2"), ("[data-a$='z']", "3"), ("[data-a*=' ']", "2"), ("i.k", "2"), ("i.k.l", "2"), (".k, #q", "2 3"),
    ("div i", "1 2 3"), ("div > i", "1"), ("div i > u", "u"), ("div > u", ""), ("*.k", "2"), ("DIV I#q", "3"), ("[data-a='']", ""), ("[Data-A=x]", "1"),
])
def test_selectors(selector, want):
    page = "<div><i data-a=x>1</i><b><i class='l k' data-a='x y'>2</i><i id=q data-a=wz data-a=x>3</i></b><i><u>u</u></i></div>"
    assert " ".join(x.text() for x in dom.parse(page).select(selector) if x.text() in "1 2 3 u" and (x.attrs or x.tag == "u")) == want


def test_selectors_that_are_none_are_refused():
    with pytest.raises(ValueError):
        dom.parse("<p>").select("p:hover")


def test_deep_pages_are_read():
    assert dom.parse("<div>" * 30_000 + "x").select("div > div > div")[-1].text() == "x"


def cards(spark, software, *pages):
    frame = spark.createDataFrame([(f"https://s.example/l{k}", p) for k, p in enumerate(pages)], "url string, html string")
    return sorted((r.external_key, r.title, r.price, r.available, r.url) for r in shops.cards(frame, software).collect())


def test_cards_of_odd_pages(spark):
    card = lambda key, inner: f"<article {key} class='x card'>{inner}</article>"
    named = "<h4 class=card-title><a href='/p/1?a=b'>A &amp; B</a></h4>"
    assert cards(spark, "bigcommerce", None, "", "no cards", card("data-entity-id=4", "<h4>no link</h4>"), card("", "<a href=/x></a>"), card("", named)) == [("4", "no link", None, True, None), ("path-p/1", "A & B", None, True, "https://s.example/p/1?a=b")]
    # two numbers inside tell nothing; a card in a card is part of it; a compare link is no product's
    two = card("", "<a href='/compare?x'>c</a>" + named + "<i data-product-id=7></i><i data-product-id=8></i>")
    nested = card("data-product-id=9", named + card("data-product-id=10", named))
    assert [c[0] for c in cards(spark, "bigcommerce", two, nested)] == ["9", "path-p/1"]
    sold = card("data-entity-id=5", "<h4>sold out of Springfield</h4><span class=price--withoutTax>$1,234.50</span>")
    gone = card("data-entity-id=6", "<h4>x</h4><span class=sold-out-text>Sold Out</span>")
    assert cards(spark, "bigcommerce", sold + gone) == [("5", "sold out of Springfield", 1234.5, True, None), ("6", "x", None, False, None)]


def test_prices(spark):
    item = "<li class='product type-product'><h2>t</h2><a data-product_id=1></a><span class=price>{}</span></li>"
    amount = "<span class='woocommerce-Price-amount'>${}</span>"
    for shown, want in ((amount.format("5"), 5.0), (f"<del>{amount.format(9)}</del><ins>{amount.format(7)}</ins>", 7.0), (f"{amount.format(3)} - {amount.format(8)}", 3.0), ("Call", None), (amount.format("0.00"), None)):
        assert cards(spark, "woocommerce", item.format(shown))[0][2] == want
    item = "<li class=product-item><a class=product-item-link href=/a>t</a>{}</li>"
    for shown, want in (("<span class=price>$1599<span class=decimal>99</span></span>", 1599.99), ("<span class=price>$15<sup>5</sup></span>", 15.05), ("<p data-price-amount='12.5'></p><span class=price>$9</span>", 12.5)):
        assert cards(spark, "magento", item.format(shown))[0][2] == want


def details(spark, software, html):
    return shops.details(spark.createDataFrame([("https://s.example/p", html)], "url string, html string"), software).first()


def test_variations_that_are_open_or_broken_are_none(spark):
    form = lambda v: f"<h1>t</h1><form class=variations_form data-product_variations='{v}'></form>"
    one = {"variation_id": 1, "attributes": {"attribute_a": "x"}, "display_price": 5}
    assert [c.label for c in details(spark, "woocommerce", form(json.dumps([one, {**one, "variation_id": 2, "attributes": {"attribute_a": "y"}}]))).choices] == ["x", "y"]
    for broken in ("false", "{", "[1]", "[]", json.dumps([one, {**one, "attributes": {"attribute_a": ""}}]), json.dumps([{"variation_id": 3}])):
        assert details(spark, "woocommerce", form(broken)).choices == []
    assert details(spark, "woocommerce", None).title is None


def test_menus_combine(spark):
    menu = lambda name, n: f"<div data-product-attribute=set-select><label>{name}:</label><select><option value=''>-{''.join(f'<option value={k}>{name}{k}' for k in range(n))}</select></div>"
    found = details(spark, "bigcommerce", menu("a", 2) + menu("b", 3) + "<div data-product-attribute=input-text></div>")
    assert found.asks == ["a", "b"] and [c.key for c in found.choices] == ["0-0", "0-1", "0-2", "1-0", "1-1", "1-2"] and found.choices[5].label == "a1 / b2"
    assert details(spark, "bigcommerce", menu("a", 15) + menu("b", 15)).choices == []


def test_which_choices_are_items(spark):
    rows = [
        ("one", [], [("a", 1.0, None)], False), ("prices", ["Model"], [("a", 1.0, None), ("b", 2.0, None)], True), ("same", ["Model"], [("a", 1.0, None), ("b", 1.0, None)], False), ("extra", ["Add a magazine"], [("a", 1.0, None), ("b", 2.0, None)], False),
        ("hand", ["Hand-select"], [("yes", 1.0, None), ("no", 2.0, None)], False), ("any", ["Model"], [("Any", 1.0, None), ("b", 2.0, None)], False), ("graded", ["x"], [("Very good", None, None), ("b", None, None)], True), ("numbered", ["x"], [("Pistol - 1", None, None), ("#2", None, None)], True),
        ("serials", ["x"], [("SN: B1", None, None), ("s/n B2", None, None)], True), ("pictures", ["x"], [("a", None, "u"), ("b", None, "v")], True), ("looks", ["Color"], [("red", None, "u"), ("blue", None, "v")], False), ("dearer", ["Finish"], [("red", 1.0, "u"), ("blue", 2.0, "v")], True),
        ("casing", ["Casing"], [("a", 1.0, None), ("b", 2.0, None)], True), ("none", None, None, False),
    ]
    made = [(n, asks, c and [(str(k), label, price, True, image, None) for k, (label, price, image) in enumerate(c)]) for n, asks, c, _ in rows]
    frame = spark.createDataFrame(made, f"n string, asks array<string>, choices array<{shops.CHOICE}>")
    assert {r.n: r.are for r in frame.select("n", shops.are_items(F.col("asks"), F.col("choices")).alias("are")).collect()} == {n: want for n, *_, want in rows}


def test_titles_of_choices(spark):
    rows = [("Polish P-64 Pistol", "P-64 Pistol - 20", "Polish P-64 Pistol #20"), ("Pistol", "#3", "Pistol #3"), ("Pistol", "Rifle 4", "Pistol - Rifle 4"), ("Pistol", "blue", "Pistol - blue")]
    frame = spark.createDataFrame(rows, "t string, l string, want string")
    assert frame.where(shops.choice_title(F.col("t"), F.col("l")) != F.col("want")).count() == 0


def test_next_page_stays_on_the_host(spark):
    pages = [("https://s.example/a", "<a rel=next href='?page=2'>"), ("https://s.example/b", "<a rel=next href='https://o.example/'>"), ("https://s.example/c", "<a rel=next href='/c'>"), ("https://s.example/d", "<li class='pagination-item--next'><a href='/d/2'></a>"), ("https://s.example/e", None)]
    out = shops.next_pages(spark.createDataFrame(pages, "url string, html string"), "bigcommerce")
    assert sorted(map(tuple, out.collect())) == [("https://s.example/a", "https://s.example/a?page=2"), ("https://s.example/d", "https://s.example/d/2")]


def test_pages_are_read_once_and_by_all_cores(spark):
    from larkspur import queries

    out = queries.queries()["views_wix"](spark, "/root/testdata/sf0.001")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_selectors_find_what_a_walk_finds():
    from larkspur.sources.dom import matches, parse

    page = parse("<div id=a class='x y'><p class=x><b data-k=1>1</b></p><div class=y><p id=q class='y x'>2</p><b>3</b></div></div><p class=x>4<b>5</b></p>")
    for scope in [page, *page.walk()]:
        for s in ("p, b", ".x", ".x.y", "#q", "div p", "div > b, p.x", "[data-k]", "*", "b, [data-k], .y p", "[class~=y]", "u"):
            found = [x for x in scope.walk() if matches(x, s, scope)]
            assert scope.select(s) == found and scope.first(s) is next(iter(found), None), s
