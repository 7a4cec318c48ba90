"""Feeds, pages, mail, choices and exports."""

import json

import pytest
from pyspark.sql import functions as F

from larkspur.sources import feeds, sinks


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_product_feed(spark):
    body = {"products": [{"id": 1, "title": " Red  ring", "handle": "red", "variants": [{"id": 10, "title": "S", "price": "1,250.00", "available": True}, {"id": 11, "title": "L", "price": "0.00"}]}, {"id": 2, "title": "Bolt", "handle": "b", "variants": [{"id": 20, "title": "Default", "price": "5", "available": False}]}]}
    df = spark.createDataFrame([(json.dumps(body),), ("not json",), (None,), ('{"products": []}',)], "body string")
    assert rows(feeds.product_feed(df)) == [("1-10", "Red ring - S", 1250.0, True, "/products/red"), ("1-11", "Red ring - L", None, False, "/products/red"), ("2-20", "Bolt", 5.0, False, "/products/b")]


def test_store_and_search_feeds(spark):
    store = [{"id": 7, "name": "A  b", "permalink": "u", "is_in_stock": True, "prices": {"price": "12345", "currency_minor_unit": 2}}, {"id": 8, "name": "c", "permalink": "v", "prices": {"price": "0"}}]
    assert rows(feeds.store_feed(spark.createDataFrame([(json.dumps(store),)], "body string"))) == [("7", "A b", 123.45, True, "u"), ("8", "c", None, False, "v")]
    hits = {"hits": [{"objectID": "x", "name": "n", "url": "w", "price": 3.5}, {"objectID": "y", "name": "m", "price": 0, "in_stock": False}]}
    assert rows(feeds.search_feed(spark.createDataFrame([(json.dumps(hits),)], "body string"))) == [("x", "n", 3.5, True, "w"), ("y", "m", None, False, None)]


def test_linked_data(spark):
    page = lambda offers: f'<p>x</p><script type="application/ld+json">{json.dumps({"name": "a", "offers": offers})}</script>'
    df = spark.createDataFrame([(0, page({"price": "9.50", "priceCurrency": "USD"})), (1, page([{"price": "1"}, {"price": "2"}])), (2, "<p>none</p>"), (3, None)], "i int, html string")
    got = {r.i: r.o for r in df.select("i", feeds.linked_data(F.col("html")).alias("o")).collect()}
    assert (got[0].price, got[0].priceCurrency, got[1].price, got[2], got[3]) == ("9.50", "USD", "1", None, None)


def test_choices(spark):
    kind = "external_key string, title string, price double, options array<struct<choice:string,title:string,price:double>>"
    data = [("p", "Ring", 1.0, [("s", "Ring S", None), ("l", "Ring L", 2.0)]), ("q", "Bolt", 3.0, [("a", None, None)]), ("r", "Nut", 4.0, [("a", None, 4.0), ("b", None, 4.0)]), ("t", "Cap", 5.0, None)]
    out = feeds.choices(spark.createDataFrame(data, kind), "external_key", "options")
    assert rows(out.select("external_key", "title", "price", "split_from")) == [("p#l", "Ring L", 2.0, "p"), ("p#s", "Ring S", 1.0, "p"), ("q", "Bolt", 3.0, None), ("r", "Nut", 4.0, None), ("t", "Cap", 5.0, None)]


def test_mail(spark):
    text = "From: Shop <news@Shop.example>\r\nSubject: New  stock\r\nX: https://no.example\r\n\r\nSee https://a.example/1 and <a href=\"https://a.example/2\">x</a> https://a.example/1"
    out = feeds.mail(spark.createDataFrame([(text,), ("",)], "value string")).collect()
    assert (out[0].sender, out[0].subject, out[0].links) == ("shop.example", "New  stock", ["https://a.example/1", "https://a.example/2"])
    assert out[1].links == []


def test_export_refuses_rather_than_cuts(spark, tmp_path):
    df = spark.range(10)
    with pytest.raises(sinks.TooManyRows):
        sinks.export(df, str(tmp_path / "x"), most=9)
    assert not (tmp_path / "x").exists()
    sinks.export(df, str(tmp_path / "x"), most=10)
    sinks.export(df, str(tmp_path / "y"), "json")
    assert spark.read.option("header", True).csv(str(tmp_path / "x")).count() == spark.read.json(str(tmp_path / "y")).count() == 10


def test_snapshots(spark, tmp_path):
    for stamp in ("2024-01-01", "2024-01-03", "2024-01-02"):
        sinks.snapshot(spark.range(2), str(tmp_path / "s"), stamp)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 6
    assert sinks.snapshots_beyond(["2024-01-01", "2024-01-03", "2024-01-02"], 2) == ["2024-01-01"]
