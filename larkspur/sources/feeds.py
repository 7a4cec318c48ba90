"""Catalog feeds and pages as rows of ``external_key, title, price, available, url``, parsed by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import collapse_space, money, registrable_domain

_VARIANT = "id BIGINT, title STRING, price STRING, available BOOLEAN, sku STRING"
#: The parts of each feed's JSON that a listing is made of.
PRODUCTS = f"products ARRAY<STRUCT<id BIGINT, title STRING, handle STRING, body_html STRING, variants ARRAY<STRUCT<{_VARIANT}>>>>"
STORE = "ARRAY<STRUCT<id BIGINT, name STRING, permalink STRING, is_in_stock BOOLEAN, prices STRUCT<price STRING, currency_code STRING, currency_minor_unit INT>>>"
HITS = "hits ARRAY<STRUCT<objectID STRING, name STRING, url STRING, price DOUBLE, in_stock BOOLEAN>>"
OFFER = "STRUCT<price STRING, priceCurrency STRING, availability STRING>"


def product_feed(pages: DataFrame, body: str = "body") -> DataFrame:
    """A products feed: one row for each variant; a product of one variant keeps the product's title."""
    product = F.explode(F.from_json(body, PRODUCTS)["products"]).alias("p")
    rows = pages.select(product).select("p.*", F.size("p.variants").alias("n"), F.explode("p.variants").alias("v"))
    return rows.select(
        F.concat_ws("-", F.col("id"), F.col("v.id")).alias("external_key"),
        collapse_space(F.when(F.col("n") > 1, F.concat_ws(" - ", "title", "v.title")).otherwise(F.col("title"))).alias("title"),
        money(F.col("v.price")).alias("price"),
        F.coalesce("v.available", F.lit(False)).alias("available"),
        F.concat(F.lit("/products/"), "handle").alias("url"),
    )


def store_feed(pages: DataFrame, body: str = "body") -> DataFrame:
    """A store API's page: prices in minor units of their currency."""
    rows = pages.select(F.explode(F.from_json(body, STORE)).alias("p"))
    price = F.nullif(F.col("p.prices.price").cast("double") / F.pow(F.lit(10.0), F.coalesce("p.prices.currency_minor_unit", F.lit(2))), F.lit(0.0))
    return rows.select(F.col("p.id").cast("string").alias("external_key"), collapse_space(F.col("p.name")).alias("title"), price.alias("price"), F.coalesce("p.is_in_stock", F.lit(False)).alias("available"), F.col("p.permalink").alias("url"))


def search_feed(pages: DataFrame, body: str = "body") -> DataFrame:
    """Hits of a search service."""
    rows = pages.select(F.explode(F.from_json(body, HITS)["hits"]).alias("h"))
    return rows.select(F.col("h.objectID").alias("external_key"), collapse_space(F.col("h.name")).alias("title"), F.nullif("h.price", F.lit(0.0)).alias("price"), F.coalesce("h.in_stock", F.lit(True)).alias("available"), F.col("h.url").alias("url"))


def linked_data(html: Column) -> Column:
    """The first offer of a page's JSON-LD product: an object or the first of a list."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    one = lambda s: F.from_json(s, f"name STRING, offers {OFFER}")["offers"]
    many = lambda s: F.get(F.from_json(s, f"name STRING, offers ARRAY<{OFFER}>")["offers"], F.lit(0))
    found = F.transform(scripts, lambda s: F.when(F.get_json_object(s, "$.offers[0]").isNotNull(), many(s)).otherwise(one(s)))
    return F.get(F.filter(found, lambda o: o["price"].isNotNull()), F.lit(0))


def page_cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """What a page says of itself: title, language, number of links and of paragraphs, host and path."""
    source = F.col(html)
    return pages.select(
        "page_id",
        collapse_space(F.regexp_extract(source, r"<title>([^<]*)</title>", 1)).alias("title"),
        F.regexp_extract(source, r'<html lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_count(source, F.lit("<a href=")).cast("long").alias("links"),
        F.regexp_count(source, F.lit("<p>")).cast("long").alias("paragraphs"),
        F.regexp_extract("url", r"//([^/?#]+)", 1).alias("host"),
        F.regexp_extract("url", r"//[^/?#]+([^?#]*)", 1).alias("path"),
    )


def choices(rows: DataFrame, key: str, options: str) -> DataFrame:
    """A page of several choices as one row for each; what a choice does not say, it takes from the page.

    ``options``: array of structs (choice, title, price). Pages with fewer than two, or whose choices differ in
    nothing, stay one row.
    """
    several = (F.size(options) >= 2) & ((F.size(F.array_distinct(F.transform(options, lambda o: o["price"]))) > 1) | (F.size(F.array_distinct(F.transform(options, lambda o: o["title"]))) > 1))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("choice"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("double").alias("price")))
    out = rows.withColumn("_o", F.explode(F.when(F.coalesce(several, F.lit(False)), F.col(options)).otherwise(whole)))
    return out.withColumns({
        "split_from": F.when(F.col("_o.choice").isNotNull(), F.col(key)),
        key: F.when(F.col("_o.choice").isNotNull(), F.concat_ws("#", key, "_o.choice")).otherwise(F.col(key)),
        "title": F.coalesce("_o.title", "title"),
        "price": F.coalesce("_o.price", "price"),
    }).drop("_o", options)


def mail(files: DataFrame, text: str = "value") -> DataFrame:
    """Sender's domain, subject and links of mail files read as whole texts."""
    header = lambda name: F.trim(F.regexp_extract(text, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1))
    body = F.regexp_replace(text, r"(?s)^.*?\r?\n\r?\n", "")
    return files.select(
        F.lower(F.regexp_extract(header("From"), r"@([A-Za-z0-9.-]+)", 1)).alias("sender"),
        header("Subject").alias("subject"),
        F.array_distinct(F.regexp_extract_all(body, F.lit(r"(https?://[^\s\"'<>]+)"), 1)).alias("links"),
    )


def decoded(text: Column) -> Column:
    """Character references as characters: the common names, and all decimal numbers."""
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("ndash", "\u2013"), ("mdash", "\u2014")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(\d{1,5});"), 1))
    text = F.aggregate(numbers, text, lambda out, n: F.replace(out, F.concat(F.lit("&#"), n, F.lit(";")), F.decode(F.unhex(F.lpad(F.hex(n.cast("int")), 4, "0")), "UTF-16BE")))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def html_text(html: Column) -> Column:
    """The readable words of a piece of markup: no scripts or styles, references decoded, spaces collapsed; markup that was escaped twice is read twice."""

    def once(x: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(x, r"(?is)<(script|style|template|noscript)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)</?[a-zA-Z][^<>]*>", " ")
        return collapse_space(decoded(bare))

    first = once(F.coalesce(html, F.lit("")))
    return F.when(first.rlike(r"</[a-zA-Z][a-zA-Z0-9]*\s*>|<[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>"), once(first)).otherwise(first)


def is_prose(text: Column) -> Column:
    """Whether a description reads as words and not as code: there is something, and no rule of a stylesheet, no function, no tag."""
    code = text.rlike(r"\{[^{}]*:[^{}]*[;}]|function\s*\(|</?[a-z]+[ >]|[#.][\w-]+\s*\[[^\]]*\]")
    return F.coalesce((F.trim(text) != "") & ~code, F.lit(False))


def custom_fields(html: Column) -> Column:
    """A page's table of named fields (definition lists and two-column rows) as a map; the first value of a name counts."""
    names = F.regexp_extract_all(html, F.lit(r"(?is)<(?:dt|th)[^>]*>\s*([^<:]+):?\s*</(?:dt|th)>\s*<(?:dd|td)[^>]*>([^<]*)"), 1)
    values = F.regexp_extract_all(html, F.lit(r"(?is)<(?:dt|th)[^>]*>\s*([^<:]+):?\s*</(?:dt|th)>\s*<(?:dd|td)[^>]*>([^<]*)"), 2)
    pairs = F.zip_with(names, values, lambda n, v: F.struct(F.lower(collapse_space(n)).alias("key"), collapse_space(decoded(v)).alias("value")))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == i + 1)
    return F.map_from_entries(first)


def meta_price(html: Column) -> Column:
    """The price that a page's head states, of the markup vocabularies that shops use."""
    named = r"(?is)<meta[^>]*(?:property|name|itemprop)=[\"'](?:product:price:amount|og:price:amount|price)[\"'][^>]*content=[\"']([^\"']+)"
    return money(F.nullif(F.regexp_extract(html, named, 1), F.lit("")))


def infobox(text: Column) -> Column:
    """The named parameters of an article's infobox as a map: templates in values are taken out, of links the shown words stay."""
    flat = F.coalesce(text, F.lit(""))
    body = F.regexp_extract(flat, r"(?is)\{\{\s*infobox[^|{}]*((?:[^{}]|\{\{(?:[^{}]|\{\{[^{}]*\}\})*\}\})*)\}\}", 1)  # two levels of templates
    for _ in range(2):
        body = F.regexp_replace(body, r"\{\{[^{}]*\}\}", " ")
    body = F.regexp_replace(F.regexp_replace(body, r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1"), r"\[\[([^\[\]]*)\]\]", "$1")
    parts = F.filter(F.split(body, r"\|"), lambda p: p.contains("="))
    pairs = F.transform(parts, lambda p: F.struct(F.lower(collapse_space(F.substring_index(p, "=", 1))).alias("key"), collapse_space(F.regexp_replace(p, "(?s)^[^=]*=", "")).alias("value")))
    stated = F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))
    first = F.filter(stated, lambda p, i: F.array_position(F.transform(stated, lambda q: q["key"]), p["key"]) == i + 1)
    return F.map_from_entries(first)


def mail_links(mails: DataFrame, shop: str, body: str) -> DataFrame:
    """``url, label, rank`` of the links of letters: 1 a product's, 2 a section's, 3 the shop's front, 4 another host's, 9 what unsubscribes or shares."""
    anchors = F.regexp_extract_all(body, F.lit(r"(?is)<a[^>]*href=[\"'](https?://[^\"']+)[\"'][^>]*>(.*?)</a>"), 0)
    rows = mails.select("*", F.explode(anchors).alias("_a"))
    url = F.regexp_extract("_a", r"(?is)href=[\"'](https?://[^\"']+)", 1)
    path = F.lower(F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1))
    label = collapse_space(decoded(F.regexp_replace(F.regexp_extract("_a", r"(?is)<a[^>]*>(.*?)</a>", 1), r"<[^<>]*>", " ")))
    rank = (
        F.when(F.lower(F.concat_ws(" ", url, label)).rlike("unsubscribe|preferences|view in browser|facebook|twitter|instagram"), 9)
        .when(~registrable_domain(url).eqNullSafe(F.col(shop)), 4)
        .when(path.rlike("/(?:products?|items?|p)/[^/]+"), 1)
        .when(path.rlike("^/?$"), 3)
        .otherwise(2)
    )
    return rows.withColumns({"url": url, "label": label, "rank": rank}).drop("_a")


def plain_url(url: Column, query: bool = True) -> Column:
    """A URL as two shops' spellings of it share it: no scheme, ``www.``, fragment, tracking or slash at the end; without ``query`` no parameters at all."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1)), r"^www\.|:80$|:443$", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike("^(?:utm_[a-z]+|mc_[a-z]+|gclid|fbclid|ref)=")))
    return F.when(F.lit(query) & (F.size(kept) > 0), F.concat(host, path, F.lit("?"), F.array_join(kept, "&"))).otherwise(F.concat(host, path))


def url_match(links: DataFrame, items: DataFrame, key: str = "item") -> DataFrame:
    """``links`` (url) with the item (``item, url``) that they lead to: the same URL, else the same without parameters; of several the first key."""
    by = lambda q: items.groupBy(plain_url(F.col("url"), q).alias("_u")).agg(F.min(key).alias("_item"))
    out = links.withColumns({"_a": plain_url(F.col("url")), "_b": plain_url(F.col("url"), False)})
    out = out.join(by(True).toDF("_a", "_exact"), "_a", "left").join(by(False).toDF("_b", "_loose"), "_b", "left")
    return out.withColumn(key, F.coalesce("_exact", "_loose")).drop("_a", "_b", "_exact", "_loose")


def link_status(sources: DataFrame, mails: DataFrame, links: DataFrame) -> DataFrame:
    """``source, state, emails, followed``: whether the links in a source's mail led anywhere; mails that ask to confirm say nothing.

    ``mails``: mail, source, read, confirms; ``links``: mail, url (null: not resolved).
    """
    told = mails.where(F.col("read") & ~F.col("confirms"))
    counts = told.groupBy("source").agg(F.count("*").alias("emails"))
    led = links.where("url is not null").join(told.select("mail", "source"), "mail").groupBy("source").agg(F.count("*").alias("followed"))
    out = sources.select("source").join(counts, "source", "left").join(led, "source", "left").na.fill(0, ["emails", "followed"])
    return out.select("source", F.when(F.col("emails") == 0, "waiting").when(F.col("followed") > 0, "followed").otherwise("unresolved").alias("state"), "emails", "followed")
