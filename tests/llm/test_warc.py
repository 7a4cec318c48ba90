"""The query against SQL, the as-of join against brute force, canonical URLs, headers, and files."""

import gzip
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur.llm import warc
from larkspur.llm.queries import OP8_SQL, op8_warc

SF = "/root/testdata/sf0.01"
COLUMNS = "record_id long, url string, ts long, revisit boolean, etag string, last_modified string, digest string, headers map<string,string>, body string"


def test_query_against_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS FROM '{SF}/pages.parquet'")
    key = lambda r: tuple(map(str, r))
    got = sorted(op8_warc(spark, SF).collect(), key=key)
    assert list(map(key, got)) == sorted(map(key, duckdb.sql(OP8_SQL).fetchall()))
    assert {r.verdict for r in got} >= {"confirmed"}


def test_canonical_urls(spark):
    same = ["http://www.Example.com:80/a/?b=2&a=1#top", "https://example.com/a?a=1&b=2&utm_source=x", "//EXAMPLE.com/a/?ref=1&a=1&b=2"]
    df = spark.createDataFrame([(u,) for u in [*same, "https://m.example.com/a", None]], "url string")
    got = [r[0] for r in df.select(warc.canonical_url(F.col("url"))).collect()]
    assert got == ["example.com/a?a=1&b=2"] * 3 + ["m.example.com/a", None]


@pytest.mark.parametrize("slice_rows", [3, 200_000])
def test_as_of_join_by_brute_force(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(warc, "SLICE_ROWS", slice_rows)
    rng = random.Random(4)
    rows = [(i, f"http://h/{rng.choice('aaab')}", rng.randrange(60), rng.random() < 0.5, None, None, None, {}, None) for i in range(150)]
    rows += [(900, None, 5, True, None, None, None, {}, None), (901, "http://h/a", None, True, None, None, None, {}, None), (902, "http://h/z", 5, True, "x", None, None, None, None)]
    rows.append(rows[0])
    out = warc.resolve_revisits(spark.createDataFrame(rows, COLUMNS)).collect()
    assert len(out) == sum(r[3] for r in rows)
    for r in out:
        own = next(x for x in rows if x[0] == r.record_id)
        old = max(((x[2], x[0]) for x in rows if not x[3] and x[1] == own[1] and own[1] and None not in (x[2], own[2]) and x[2] < own[2]), default=None)
        assert (r.response_ts, r.response_id) == (old or (None, None))
        assert r.verdict == ("unchecked" if old else "unresolved") and r.body is None


def test_slices_are_even_where_times_are_not(spark, monkeypatch):
    """One far-off time, and half of all rows at one moment: no key has more points in a slice than the slices are meant to have."""
    monkeypatch.setattr(warc, "SLICE_ROWS", 500)
    rows = [(i, "http://h/hot", 10**9 if i == 0 else 7 if i % 2 else i, i % 3 > 0, None, None, None, {}, None) for i in range(4000)]
    captures = spark.createDataFrame(rows, COLUMNS)
    sizes = []
    window = warc.Window.partitionBy
    monkeypatch.setattr(warc.Window, "partitionBy", staticmethod(lambda *c: sizes.append(c) or window(*c)))
    out = warc.resolve_revisits(captures)
    assert len(sizes) == 2  # in the slice, and over the slices
    got = {r.record_id: r.response_ts for r in out.collect()}
    times = sorted({t for _, _, t, again, *_ in rows if not again})
    assert got == {i: max((t for t in times if t < own), default=None) for i, _, own, again, *_ in rows if again}
    strange = captures.selectExpr("record_id as _slice", "url as _k", "ts", "revisit as found")
    assert warc.as_of(strange, "_k", "ts", ~F.col("found"), F.col("_slice")).columns == ["_slice", "_k", "ts", "found"]


def test_validators_and_headers(spark):
    full = (1, "http://a/x", 10, False, '"v1"', "mon", "sha1:A", {"content-type": "text/html", "date": "1", "etag": '"v1"', "vary": "x"}, "BODY")
    revisits = [
        (2, "http://a/x/", 11, True, 'W/"v1"', "tue", None, {"date": "2", "content-length": "0"}, None),
        (3, "http://a/x", 12, True, '"v1"', None, "sha1:B", {"date": "3"}, None),
        (4, "http://a/x", 13, True, None, "mon", None, {}, None),
        (5, "http://a/x", 10, True, '"v1"', None, None, {"expires": "9"}, None),
    ]
    out = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame([full, *revisits], COLUMNS)).collect()}
    assert [out[i].verdict for i in (2, 3, 4, 5)] == ["confirmed", "changed", "confirmed", "unresolved"]
    assert out[2].headers == {"content-type": "text/html", "date": "2", "etag": '"v1"', "vary": "x"} and out[2].body == "BODY"
    assert out[3].headers == {"date": "3"} and out[3].body is None and out[5].headers == {"expires": "9"}
    assert warc.resolve_revisits(spark.createDataFrame([], COLUMNS)).count() == 0


def record(kind, date, block, extra=""):
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://a/x\r\nWARC-Date: {date}\r\n{extra}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_files(spark, tmp_path):
    full = record("response", "2024-01-01T00:00:00Z", b"HTTP/1.1 200 OK\r\nETag: \"1\"\r\nContent-Type: text/html\r\n\r\n<p>hi</p>")
    again = record("revisit", "2024-01-02T00:00:00Z", b"HTTP/1.1 304 Not Modified\r\nETag: \"1\"\r\nDate: now\r\n\r\n")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record("warcinfo", "2024-01-01T00:00:00Z", b"x")) + gzip.compress(full))
    (tmp_path / "b.warc").write_bytes(again + b"WARC/1.1\r\nContent-Le")
    rows = warc.read(spark, str(tmp_path))
    assert sorted(r.record_type or "" for r in rows.collect())[-3:] == ["response", "revisit", "warcinfo"]
    out = warc.resolve_revisits(warc.captures(rows)).collect()
    assert [(r.verdict, bytes(r.body), r.headers) for r in out] == [("confirmed", b"<p>hi</p>", {"etag": '"1"', "content-type": "text/html", "date": "now"})]
