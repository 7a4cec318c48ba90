"""Feeds, pages, mail and exports as queries: bodies as shops write them are made of the tables' rows, and what is read back is checked against those rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .queries import query
from .reading_queries import cases
from .sources import feeds, shops, sinks
from .sources.tables import dealt, table
from .streaming.flows import shared_folder

_PRICE_SQL = "CASE WHEN p_partkey % 11 <> 0 AND p_retailprice > 0 THEN p_retailprice END"


def price() -> Column:
    """Every eleventh row has none."""
    return F.when(F.col("p_partkey") % 11 != 0, F.col("p_retailprice")).otherwise(0.0)


def in_stock() -> Column:
    return F.col("p_partkey") % 4 != 0


def shown_price() -> Column:
    return F.concat(F.lit("$"), F.format_number(price(), 2))


def key_text() -> Column:
    return F.col("p_partkey").cast("string")


def marked_name() -> Column:
    return F.concat(F.regexp_replace("p_name", " ", "&nbsp;"), F.lit(" &amp; co"))


def bodies(rows: DataFrame, part: Column, start: str = "", end: str = "", between: str = "") -> DataFrame:
    """Pages of twenty rows: their parts in the order of keys."""
    found = rows.groupBy(F.floor(F.col("p_partkey") / 20).alias("page")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", part.alias("x")))).alias("parts"))
    return found.select("page", F.concat(F.lit(start), F.array_join(F.transform("parts", lambda p: p["x"]), between), F.lit(end)).alias("body"))


@query(f"""SELECT p_partkey || '-' || v AS external_key, p_name || CASE v WHEN 1 THEN ' - S' ELSE ' - L' END AS title, {_PRICE_SQL} AS price, v = 1 AND p_partkey % 4 <> 0 AS available, '/products/h' || p_partkey AS url FROM part, (VALUES (1), (2)) t(v)""")
def feed_products(spark, folder):
    variant = lambda k, name, stock: F.struct(F.lit(k).alias("id"), F.lit(name).alias("title"), F.format_number(price(), 2).alias("price"), stock.alias("available"))
    product = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.regexp_replace("p_name", " ", "  ").alias("title"), F.concat(F.lit("h"), "p_partkey").alias("handle"), F.array(variant(1, "S", in_stock()), variant(2, "L", F.lit(None).cast("boolean"))).alias("variants")))
    return feeds.product_feed(bodies(table(spark, folder, "part"), product, '{"products": [', "]}", ","))


@query(f"SELECT p_partkey::VARCHAR AS external_key, p_name AS title, {_PRICE_SQL} AS price, p_partkey % 4 <> 0 AS available, 'u' || p_partkey AS url FROM part")
def feed_store(spark, folder):
    minor = F.bround(price() * 100).cast("long").cast("string")
    product = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("u"), "p_partkey").alias("permalink"), F.when(in_stock(), True).alias("is_in_stock"), F.struct(minor.alias("price"), F.lit("USD").alias("currency_code"), F.lit(2).alias("currency_minor_unit")).alias("prices")))
    return feeds.store_feed(bodies(table(spark, folder, "part"), product, "[", "]", ","))


@query(f"SELECT 'o' || p_partkey AS external_key, p_name AS title, {_PRICE_SQL} AS price, p_partkey % 4 <> 0 AS available, '/i/' || p_partkey AS url FROM part")
def feed_search(spark, folder):
    hit = F.to_json(F.struct(F.concat(F.lit("o"), "p_partkey").alias("objectID"), F.col("p_name").alias("name"), F.concat(F.lit("/i/"), "p_partkey").alias("url"), price().alias("price"), F.when(~in_stock(), False).alias("in_stock")))
    return feeds.search_feed(bodies(table(spark, folder, "part"), hit, '{"hits": [', "]}", ","))


def text(*parts) -> Column:
    """Columns and literal pieces, one after the other."""
    return F.concat(*[x if isinstance(x, Column) else F.lit(str(x)) for x in parts])


def tag(name: str, *attributes: tuple[str, object], inside: Column | str = "", close: bool = True) -> Column:
    """An element with its attributes in one of two orders and one of three ways of quoting, by the row's key."""

    def made(order: list, quote: str) -> Column:
        return text(f"<{name}", *[piece for k, v in order for piece in (f" {k}={quote}", v, quote)], ">")

    listed, key = list(attributes), F.col("p_partkey")
    opened = F.when(key % 3 == 0, made(listed, '"')).when(key % 3 == 1, made(listed[::-1], "'")).otherwise(made(listed[::-1], '"'))
    return text(opened, inside, f"</{name}>" if close else "")


def pages_of(spark, folder, part: Column, each: int = 20) -> DataFrame:
    """Listing pages of a shop, ``each`` cards on a page: navigation around them, and the way to the next page."""
    found = table(spark, folder, "part").groupBy(F.floor(F.col("p_partkey") / each).alias("page")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", part.alias("x")))).alias("parts"))
    body = F.array_join(F.transform("parts", lambda p: p["x"]), "\n")
    number = (F.col("page") + 2).cast("string")
    # a title like "sold out of" is no mark, and neither is one outside of the cards
    html = text("<html><body><nav><a href='/none'>Sold out</a></nav><ul class='products productGrid'>", body, "</ul><!-- <article class='card'>old</article> --><a rel='next' href='/list?page=", number, "'>Next</a></body></html>")
    return found.select(text("https://shop.example/list?page=", (F.col("page") + 1).cast("string")).alias("url"), html.alias("html"))


def name_in_words() -> Column:
    return text("Sold out of ", marked_name())


def unless_in_stock(*parts) -> Column:
    return F.when(~in_stock(), text(*parts)).otherwise("")


CARDS_SQL = f"""SELECT p_partkey::VARCHAR AS external_key, 'Sold out of ' || p_name || ' & co' AS title, {_PRICE_SQL} AS price, p_partkey % 4 <> 0 AS available,
  'https://shop.example/list?page=' || (p_partkey // 20 + 1) AS page, 'https://shop.example@' || p_partkey AS url FROM part"""


def card_rows(spark, folder, software: str, card: Column) -> DataFrame:
    return shops.cards(pages_of(spark, folder, card), software).select("external_key", "title", "price", "available", "page", "url")


@query(CARDS_SQL.replace("@", "/b/"))
def cards_bigcommerce(spark, folder):
    title = text("<h4 class='card-title'>", tag("a", ("href", text("/b/", key_text())), ("class", "x"), inside=name_in_words()), "</h4>")
    asked = text("<span class='price price--non-sale'>$9,999.00</span>", tag("span", ("class", "price price--withoutTax"), ("data-x", "1"), inside=shown_price()))
    sold = unless_in_stock("<a class='button card-figcaption-button'>Out of stock</a>")
    # the number on the card, or on the one button inside
    inner = tag("button", ("type", "button"), ("data-product-id", key_text()), inside="Quick view")
    body = text(title, asked, sold)
    card = F.when(F.col("p_partkey") % 2 == 0, tag("article", ("class", "card"), ("data-entity-id", key_text()), inside=body)).otherwise(tag("article", ("class", "card"), ("id", "c"), inside=text(body, inner)))
    return card_rows(spark, folder, "bigcommerce", text("<li class='product'>", card, "</li>"))


@query(CARDS_SQL.replace("@", "/m/"))
def cards_magento(spark, folder):
    amount = F.when(F.col("p_partkey") % 2 == 0, tag("span", ("data-price-amount", price().cast("decimal(12,2)").cast("string")), ("class", "price-wrapper"))).otherwise(text("<span class='price'>$", F.format_number(F.floor(price()), 0), "<sup>", F.lpad((F.bround(price() * 100) % 100).cast("int").cast("string"), 2, "0"), "</sup></span>"))
    card = tag("li", ("class", "item product product-item"), ("id", "x"), inside=text(tag("a", ("class", "product-item-link"), ("href", text("/m/", key_text())), inside=text("\n ", name_in_words(), " ")), amount, tag("div", ("data-product-id", key_text()), ("class", "price-box")), unless_in_stock("<div class='stock unavailable'><span>Out of stock</span></div>")))
    return card_rows(spark, folder, "magento", card)


@query(CARDS_SQL.replace("@", "/p/"))
def cards_prestashop(spark, folder):
    card = tag("article", ("class", "product-miniature js"), ("data-id-product", key_text()), inside=text("<h3 class='h3 product-title'>", tag("a", ("href", text("/p/", key_text())), ("title", "x"), inside=name_in_words()), "</h3><span class=price>", shown_price(), "</span>", unless_in_stock("<ul class='product-flags'><li class='product-flag out_of_stock'>Out-of-Stock</ul>")))
    return card_rows(spark, folder, "prestashop", card)


@query(CARDS_SQL.replace("@", "/product-page/"))
def cards_wix(spark, folder):
    asked = F.when(F.col("p_partkey") % 2 == 0, text("<span data-hook='product-item-price-before-discount'>$1</span>", tag("span", ("data-hook", "product-item-price-to-pay"), ("class", "z"), inside=shown_price()))).otherwise(text("<p>", tag("span", ("data-hook", "product-item-price-to-pay"), ("data-wix-price", "x"), inside=shown_price())))
    card = tag("li", ("data-hook", "product-list-grid-item"), ("class", "s"), inside=text(tag("a", ("href", text("/product-page/", key_text())), ("data-hook", "product-item-product-details-link"), inside="see"), tag("p", ("class", "n"), ("data-hook", "product-item-name"), inside=name_in_words()), asked, unless_in_stock("<span data-hook='product-item-out-of-stock'>Out of stock</span>")))
    return card_rows(spark, folder, "wix", card)


@query(CARDS_SQL.replace("@", "/wc/"))
def cards_woocommerce(spark, folder):
    symbol = text('<span class="woocommerce-Price-currencySymbol">&#36;</span>', F.format_number(price(), 2))
    amount = tag("span", ("class", "woocommerce-Price-amount amount"), ("data-a", "1"), inside=text("<bdi>", symbol, "</bdi>"))
    asked = text("<span class='price'>", F.when(F.col("p_partkey") % 2 == 0, text("<del><span class='woocommerce-Price-amount'>$9999</span></del> <ins>", amount, "</ins>")).otherwise(amount), "</span>")
    card = tag("li", ("class", "product type-product post"), ("id", "p"), inside=text(tag("a", ("class", "woocommerce-LoopProduct-link"), ("href", text("/wc/", key_text())), inside=tag("h2", ("class", "woocommerce-loop-product__title"), ("title", "t"), inside=name_in_words())), asked, tag("a", ("data-product_id", key_text()), ("class", "button")), unless_in_stock("<span class='outofstock'>Sold out</span>")))
    return card_rows(spark, folder, "woocommerce", card)


@query("SELECT DISTINCT 'https://shop.example/list?page=' || (p_partkey // 20 + 1) AS url, 'https://shop.example/list?page=' || (p_partkey // 20 + 2) AS next_url FROM part")
def listing_next_pages(spark, folder):
    return shops.next_pages(pages_of(spark, folder, F.lit("<li>x")), "prestashop")


@query(f"SELECT p_partkey::VARCHAR AS external_key, {_PRICE_SQL} AS price, p_partkey % 4 <> 0 AS available FROM part WHERE p_partkey IN (3, 44, 120)")
def single_reread(spark, folder):
    card = text('<article class="card" data-product-id="', key_text(), '"><h4 class="card-title"><a href="/b">x</a></h4><span class="price--withoutTax">', shown_price(), "</span>", unless_in_stock("<a class='card-figcaption-button'>Sold out</a>"), "</article>")
    return shops.reread(pages_of(spark, folder, card), "bigcommerce", ["3", "44", "120"])


# ------------------------------------------------------------------------------------------------------ product pages
#: Software, its marks for title, text, sold notice and picture, and what its pictures are called in full and small.
_VIEWS = {
    "bigcommerce": ('<h1 class="productView-title">', '<div id="tab-description">', '<div class="alertBox--error">', '<div class="productView-thumbnails">', "https://cdn.example/stencil/%s/", "100x100", "original"),
    "magento": ('<h1 class="page-title">', '<div class="product attribute description"><div class="value">', '<div class="stock unavailable">', '<div class="more-views">', "https://cdn.example/media%s", "/cache/1/0123456789abcdef0123456789abcdef/", "/"),
    "prestashop": ('<h1 itemprop="name">', '<div class="product-description">', '<span id="product-availability">', '<div class="product-images">', "https://cdn.example/7%s/", "-small_default", ""),
    "wix": ('<h1 data-hook="product-title">', '<pre data-hook="description">', '<div data-hook="product-out-of-stock">', '<div data-hook="product-image">', "https://cdn.example/media/", "", ""),
    "woocommerce": ('<h1 class="product_title entry-title">', '<div id="tab-description">', '<p class="stock out-of-stock">', '<div class="woocommerce-product-gallery">', "https://cdn.example/up/", "", ""),
}


def _facts_in(software: str) -> Column:
    """Two named facts as each software writes them, one of them twice."""
    brand, size = F.col("p_brand"), F.col("p_size").cast("string")
    row = {
        "bigcommerce": lambda n, v: text("<tr><td class='custom-field-label'>", n, ":</td><td class='custom-field-value'>", v, "</td></tr>"),
        "prestashop": lambda n, v: text("<dt class=name>", n, "<dd class=value>", v),
        "wix": lambda n, v: text("<div data-hook='info-section'><h2 data-hook='info-section-title'>", n, "</h2><div data-hook='info-section-description'>", v, "</div></div>"),
    }.get(software, lambda n, v: text("<tr><th scope=row>", n, "<td data-th='x'>", v, "</tr>"))
    around = {"bigcommerce": ("<table class='productView-custom-fields'>", "</table>"), "magento": ("<table id='product-attribute-specs-table'>", "</table>"), "prestashop": ("<dl class='data-sheet'>", "</dl>"), "wix": ("<section>", "</section>"), "woocommerce": ("<table class='woocommerce-product-attributes shop'>", "</table>")}[software]
    return text(around[0], row("Maker", text(brand, " &amp; sons")), row("Size", size), row("size:", "other"), around[1])


def _choices_in(software: str) -> Column:
    """Every third product has two numbered choices, the second one dearer by five and sold; BigCommerce's menus have no prices."""
    key = key_text()
    dearer = (F.col("p_retailprice") + 5).cast("decimal(12,2)").cast("string")
    plain = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    if software == "woocommerce":
        variation = lambda k, v, p, stock: text('{"variation_id": ', k, ', "attributes": {"attribute_item": "', v, '"}, "display_price": ', p, ', "is_in_stock": ', stock, ', "image": {"src": "/i/', v, '-300x200.jpg"}}')
        both = text("[", variation(1, "a", plain, "true"), ", ", variation(2, "b", dearer, "false"), "]")
        return text("<form class='variations_form' data-product_variations='", both, "'><label for='m'>Item</label><select id='m' data-attribute_name='attribute_item'><option value=''>Choose<option value='a'>#1<option value='b'>#2</select></form>")
    if software == "magento":
        both = text('{"7": {"1": {"title": "#1", "price": ', plain, '}, "2": {"title": "#2", "price": ', dearer, "}}}")
        return text("<dl><dt><label for='options_7_2'>Item *</label></dt><dd><input type=radio id='o1' name='options[7]' value='1'><label for=o1>first</label><input type=radio disabled id='o2' name='options[7]' value='2'><label for=o2>second</label></dd></dl><script>var o = new Product.Options(", both, ");</script>")
    if software == "bigcommerce":
        return text("<div data-product-attribute='set-select'><label>Item:</label><select><option value=''>Choose<option value='1'>#1</option><option value='2'>#2</option></select></div>")
    return F.lit("")


def product_views(spark, folder, software: str) -> DataFrame:
    title, told, gone, strip, cdn, small, _ = _VIEWS[software]
    picture = cdn % small if "%s" in cdn else cdn
    end = {"woocommerce": "-600x400.jpg", "wix": ".jpg/v1/fill/w_100/a.jpg"}.get(software, ".jpg")
    image = lambda name: tag("img", ("src", text(picture, key_text(), name, end)), ("alt", "x"), close=False)
    offer = text('<script type="application/ld+json">{"@graph": [{"@type": "WebPage"}, {"@type": ["Product"], "offers": [{"price": "', price().cast("decimal(12,2)").cast("string"), '", "availability": "https://schema.org/', F.when(F.col("p_partkey") % 8 == 0, "OutOfStock").otherwise("InStock"), '"}]}]}</script>')
    # of the products that are sold, every second one says so in its linked data, the others on the page
    notice = F.when((F.col("p_partkey") % 4 == 0) & (F.col("p_partkey") % 8 != 0), text(gone, "Sold out</div></p></span>")).otherwise("")
    close = {"magento": "</div></div>", "wix": "</pre>"}.get(software, "</div>")
    html = text("<html><head>", offer, "</head><body>", title, marked_name(), "</h1>", notice, "<div class='related'>Out of stock</div>", told, "<p>A <b>fine</b> ", F.col("p_type"), "</p><script>no()</script>", close, strip, image("a"), image("b"), image("a"), "</div>", _facts_in(software), F.when(F.col("p_partkey") % 3 == 0, _choices_in(software)).otherwise(""), "</body></html>")
    return dealt(table(spark, folder, "part")).select(text("https://shop.example/v/", key_text()).alias("url"), html.alias("html"))


def _view_sql(software: str) -> str:
    cdn, full = _VIEWS[software][4], _VIEWS[software][6]
    cdn = cdn % full if "%s" in cdn else cdn
    priced = software in ("woocommerce", "magento")
    keys = {"woocommerce": "['1', '2']", "magento": "['7-1', '7-2']", "bigcommerce": "['1', '2']"}.get(software)
    labels = "['#1', '#2']"
    image = "p_partkey || 'a.jpg'"
    split = f"p_partkey % 3 = 0 AND {'true' if keys else 'false'}"
    own = "CASE WHEN k = 2 THEN round(p_retailprice + 5, 2) ELSE p_retailprice END" if priced else _PRICE_SQL
    pictured = "'https://shop.example/i/' || CASE WHEN k = 2 THEN 'b' ELSE 'a' END || '.jpg'" if software == "woocommerce" else f"'{cdn}' || {image}"
    return f"""WITH n AS (SELECT *, unnest(CASE WHEN {split} THEN [1, 2] ELSE [0] END) AS k FROM part)
      SELECT p_partkey || CASE WHEN k > 0 THEN '#' || ({keys or "['', '']"})[k] ELSE '' END AS external_key, CASE WHEN k > 0 THEN p_partkey::VARCHAR END AS split_from,
             p_name || ' & co' || CASE WHEN k > 0 THEN ' ' || ({labels})[k] ELSE '' END AS title, CASE WHEN k > 0 THEN {own} ELSE {_PRICE_SQL} END AS price,
             CASE WHEN k > 0 THEN {"k = 1" if priced else "true"} ELSE p_partkey % 4 <> 0 END AS available, CASE WHEN k > 0 THEN {pictured} ELSE '{cdn}' || {image} END AS image,
             'A fine ' || p_type AS description, p_brand || ' & sons' AS maker, p_size::VARCHAR AS size, 2 AS pictures FROM n"""


def _views(software: str) -> None:
    def run(spark, folder):
        found = shops.details(product_views(spark, folder, software), software).withColumn("external_key", F.regexp_extract("url", r"(\d+)$", 1))
        told = found.withColumns({"maker": F.col("facts")["maker"], "size": F.col("facts")["size"], "pictures": F.size("images")})
        return shops.items(told, also=["description", "maker", "size", "pictures"])

    run.__name__ = run.__qualname__ = f"views_{software}"
    query(_view_sql(software))(run)


for _software in _VIEWS:
    _views(_software)


@query(f"""SELECT p_partkey, {_PRICE_SQL} AS price, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_brand || ' & sons' END AS maker, p_size::VARCHAR AS size, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice::DECIMAL(12,2)::VARCHAR END AS linked FROM part""")
def product_pages(spark, folder):
    """A product's page: the head's price, the table of named fields, and the linked data."""
    key = F.col("p_partkey")
    head = F.concat(F.lit('<head><meta property="product:price:amount" content="'), F.format_number(price(), 2), F.lit('"></head>'))
    fields = F.concat(F.lit("<dl><dt>Maker:</dt><dd>"), "p_brand", F.when(key % 2 == 0, "").otherwise(" &amp; sons"), F.lit("</dd><dt> Size </dt><dd>"), F.col("p_size").cast("string"), F.lit("</dd><dt>Size:</dt><dd>other</dd></dl>"))
    offer = F.concat(F.lit('{"price": "'), F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit('"}'))
    offers = F.when(key % 2 == 0, offer).otherwise(F.concat(F.lit("["), offer, F.lit(', {"price": "1"}]')))
    linked = F.when(key % 3 == 0, F.concat(F.lit('<script type="application/ld+json">{"name": "x", "offers": '), offers, F.lit("}</script>"))).otherwise("")
    page = table(spark, folder, "part").select("p_partkey", F.concat(head, fields, linked).alias("html"))
    found = feeds.custom_fields(F.col("html"))
    return page.select("p_partkey", feeds.meta_price(F.col("html")).alias("price"), found["maker"].alias("maker"), found["size"].alias("size"), feeds.linked_data(F.col("html"))["price"].alias("linked"))


cases("html_to_text", "html string", "words, prose BOOLEAN", [
    ("<p>A <b>fine</b>&nbsp;rifle &amp; sling</p><script>var x='<p>no</p>'</script>", "A fine rifle & sling", False), ("plain &lt; words &#8364; &#36;5", "plain < words € $5", True), ("&lt;p&gt;twice &amp;amp; escaped&lt;/p&gt;", "twice & escaped", True), ("#html-body [data-pb]{justify:flex;align:x}", "#html-body [data-pb]{justify:flex;align:x}", False),
    ("<!-- hidden --><style>p{}</style>seen", "seen", False), ("", "", False), (None, "", False), ("words only", "words only", True),
], lambda r: {"words": feeds.html_text(r.html), "prose": feeds.is_prose(r.html)})

cases("infobox_fields", "t string", "bullet, length, land", [
    ("x {{Infobox firearm cartridge\n| name = A\n| bullet = 7.92 mm\n| length = {{convert|57|mm|in}} about 57\n| origin = [[Germany|German Empire]]\n}} text | bullet = no", "7.92 mm", "about 57", "German Empire"), ("{{infobox x|bullet=.45|origin=[[France]]|bullet=second}}", ".45", None, "France"), ("no box", None, None, None), (None, None, None, None),
], lambda r: {"bullet": feeds.infobox(r.t)["bullet"], "length": feeds.infobox(r.t)["length"], "land": feeds.infobox(r.t)["origin"]})


@query("""SELECT c_custkey, 'shop' || (c_custkey % 9) || '.example' AS sender, 'News ' || c_custkey AS subject, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END::BIGINT AS links FROM customer""")
def mail_messages(spark, folder):
    key = F.col("c_custkey").cast("string")
    same = F.when(F.col("c_custkey") % 3 == 0, F.lit("https://a.example/x")).otherwise(F.concat(F.lit("https://a.example/"), key))
    text = F.concat(F.lit("From: The Shop <news@Shop"), (F.col("c_custkey") % 9).cast("string"), F.lit(".example>\r\nX-Note: https://no.example\r\nSubject: News "), key, F.lit("\r\n\r\nSee https://a.example/x and "), same)
    rows = table(spark, folder, "customer").select("c_custkey", text.alias("value"))
    read = feeds.mail(rows.select("value"))
    return read.select(F.regexp_extract("subject", r"(\d+)", 1).cast("long").alias("c_custkey"), "sender", "subject", F.size("links").cast("long").alias("links"))


@query("""SELECT c_custkey, label, rank::INT AS rank FROM customer, (VALUES ('Red ring', 1), ('All rings', 2), ('Home', 3), ('Elsewhere', 4), ('Unsubscribe', 9)) t(label, rank)""")
def ranked_mail_links(spark, folder):
    key = F.col("c_custkey").cast("string")
    link = lambda url, label: F.concat(F.lit("<a class=x href='"), url, F.lit(f"'>{label}</a>"))
    body = F.concat(link(F.concat(F.lit("https://www.shop.example/products/r"), key), "<b>Red&nbsp;ring</b>"), link(F.lit("https://shop.example/category/rings"), "All rings"), link(F.lit("https://shop.example/"), "Home"), link(F.lit("https://other.example/p/9"), "Elsewhere"), link(F.lit("https://shop.example/u"), "Unsubscribe"))
    mails = table(spark, folder, "customer").select("c_custkey", F.lit("shop.example").alias("shop"), body.alias("body"))
    return feeds.mail_links(mails, "shop", "body").select("c_custkey", "label", "rank")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey WHEN 2 THEN p_partkey - p_partkey % 2 END AS item FROM part""")
def url_match(spark, folder):
    part = table(spark, folder, "part")
    key = F.col("p_partkey")
    items = part.where(key % 4 != 3).select(key.alias("item"), F.concat(F.lit("https://www.shop.example/i/"), key, F.when(key % 4 == 1, "?v=2&a=1").otherwise("")).alias("url"))
    url = F.when(key % 4 == 0, F.concat(F.lit("HTTP://SHOP.example/i/"), key, F.lit("/?utm_source=mail#top"))).when(key % 4 == 1, F.concat(F.lit("https://shop.example/i/"), key, F.lit("?a=1&v=2"))).when(key % 4 == 2, F.concat(F.lit("https://shop.example/i/"), key, F.lit("?color=red"))).otherwise("https://shop.example/none")
    return feeds.url_match(part.select("p_partkey", url.alias("url")), items).select("p_partkey", "item")


@query("""WITH m AS (SELECT c_custkey AS mail, c_nationkey AS source, c_custkey % 5 <> 0 AS read, c_custkey % 7 = 0 AS confirms FROM customer), t AS (SELECT * FROM m WHERE read AND NOT confirms),
  e AS (SELECT source, count(*) AS emails FROM t GROUP BY 1), f AS (SELECT source, count(*) AS followed FROM t WHERE source % 3 = 0 AND mail % 2 = 0 GROUP BY 1)
  SELECT k AS source, CASE WHEN emails IS NULL THEN 'waiting' WHEN followed > 0 THEN 'followed' ELSE 'unresolved' END AS state, coalesce(emails, 0) AS emails, coalesce(followed, 0) AS followed FROM range(30) s(k) LEFT JOIN e ON k = e.source LEFT JOIN f ON k = f.source""")
def mail_link_status(spark, folder):
    customer, key = table(spark, folder, "customer"), F.col("c_custkey")
    mails = customer.select(key.alias("mail"), F.col("c_nationkey").cast("long").alias("source"), (key % 5 != 0).alias("read"), (key % 7 == 0).alias("confirms"))
    links = customer.where(key % 2 == 0).select(key.alias("mail"), F.when(F.col("c_nationkey") % 3 == 0, "https://a.example").alias("url"))
    return feeds.link_status(spark.range(30).select(F.col("id").alias("source")), mails, links)


@query("""WITH o AS (SELECT p_partkey, unnest(CASE p_partkey % 4 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN [NULL] WHEN 2 THEN [NULL] ELSE [NULL] END) AS choice, p_name, p_retailprice FROM part)
  SELECT CASE WHEN choice IS NULL THEN p_partkey::VARCHAR ELSE p_partkey || '#' || choice END AS external_key, CASE WHEN choice IS NULL THEN p_name ELSE p_name || ' ' || choice END AS title, CASE WHEN choice = 'b' THEN 5.0 ELSE p_retailprice END AS price, CASE WHEN choice IS NOT NULL THEN p_partkey::VARCHAR END AS split_from FROM o""")
def page_choices(spark, folder):
    """Pages of several choices: two that differ, one only, two that differ in nothing, none."""
    key, none = F.col("p_partkey"), F.lit(None).cast("double")
    option = lambda choice, title, price: F.struct(F.lit(choice).alias("choice"), title.alias("title"), price.alias("price"))
    named = lambda c: F.concat_ws(" ", "p_name", F.lit(c))
    blank = F.lit(None).cast("string")
    options = F.when(key % 4 == 0, F.array(option("a", named("a"), none), option("b", named("b"), F.lit(5.0)))).when(key % 4 == 1, F.array(option("a", blank, none))).when(key % 4 == 2, F.array(option("a", blank, F.lit(1.0)), option("b", blank, F.lit(1.0))))
    rows = table(spark, folder, "part").select(key.cast("string").alias("external_key"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"), options.alias("options"))
    return feeds.choices(rows, "external_key", "options").select("external_key", "title", "price", "split_from")


@query("SELECT 'csv' AS kind, p_partkey, p_name, p_retailprice FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'json', p_partkey, p_name, p_retailprice FROM part WHERE p_partkey % 3 = 0")
def export_and_read(spark, folder):
    """A search's rows as CSV and as JSON in the shared folder, read back."""
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice")
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/export-{uuid.uuid4().hex[:12]}"
    sinks.export(part.where("p_partkey % 2 = 0"), f"{path}/csv", most=10_000_000)
    sinks.export(part.where("p_partkey % 3 = 0"), f"{path}/json", "json", most=10_000_000)
    read = spark.read.schema(part.schema)
    return read.option("header", True).csv(f"{path}/csv").select(F.lit("csv").alias("kind"), "*").union(read.json(f"{path}/json").select(F.lit("json").alias("kind"), "*"))


@query("SELECT o_custkey AS reader, o_orderkey AS item, 'R' || o_custkey || ',' || o_orderstatus AS line FROM orders WHERE o_orderpriority = '1-URGENT'")
def collection_export(spark, folder):
    """A reader's kept items as lines of a sheet, read back from the file."""
    rows = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("reader"), F.col("o_orderkey").alias("item"), F.concat(F.lit("R"), "o_custkey", F.lit(","), "o_orderstatus").alias("line"))
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/sheet-{uuid.uuid4().hex[:12]}"
    sinks.export(rows, path, most=100_000_000)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("SELECT '2024-01-0' || k AS stamp, count(*) AS n, k < 3 AS pruned FROM part, (VALUES (1), (2), (3), (4)) t(k) WHERE p_partkey % k = 0 GROUP BY k")
def backup_snapshots(spark, folder):
    """Dated copies of a table, and which of them a pruning to the newest two removes."""
    part = table(spark, folder, "part").select("p_partkey")
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/backup-{uuid.uuid4().hex[:12]}"
    stamps = [f"2024-01-0{k}" for k in range(1, 5)]
    for k, stamp in enumerate(stamps, 1):
        sinks.snapshot(part.where(F.col("p_partkey") % k == 0), path, stamp)
    gone = sinks.snapshots_beyond(stamps, 2)
    kept = spark.read.option("basePath", path).schema("p_partkey long, stamp string").parquet(path)
    return kept.groupBy("stamp").agg(F.count("*").alias("n")).withColumn("pruned", F.col("stamp").isin(gone))
