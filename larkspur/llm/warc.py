"""WARC captures: reading records, and resolving not-modified revisits to the full responses that they stand for.

A revisit (an answer 304, or a record of the type ``revisit``) is joined as of its time to the latest earlier full
response with the same canonical URL. Its validators are checked against that response: a digest of the payload
counts most, then the entity tag (weak comparison), then the date of the last change; the first that both have
decides. A confirmed revisit takes the headers and the body of the response, and of its own headers those that a
304 may update.

The as-of join is two aggregates and two small windows: time is cut into slices of about ``SLICE_ROWS`` rows of the
whole table, the latest response is found within (URL, slice), and the latest of each earlier slice is carried on, a
row for each URL and slice. So a URL with a third of all captures is spread over as many tasks as its slices fill.

Defined cases: without an earlier response the verdict is ``unresolved``; without a validator that both have, it is
``unchecked``; both leave the body null. Responses at the revisit's own moment are not earlier; of several
at the latest earlier moment the largest id counts. Rows with a null URL or time are unresolved; repeated rows are resolved each;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut

SLICE_ROWS = 200_000
#: Fixed value: header fields that a 304 answer may update.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Fixed value: query parameters that name a visit, not a page.
TRACKING = ["fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]


def canonical_url(url: Column) -> Column:
    """Scheme and ``www.`` dropped, host in lower case without a default port, no fragment, no tracking parameters, the others in order, no closing slash."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), r"^www\.|:80$|:443$", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.array_sort(F.split(query, "&")), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(TRACKING))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def as_of(rows: DataFrame, key: str, time: str, is_source: Column, value: Column) -> DataFrame:
    """``rows`` with ``found``: the largest of ``struct(time, value)`` of the sources of the same key strictly before.

    ``time`` is a long. ``found`` is null where there is none, and for rows without key or time. Time is cut into the ranges
    that Spark's range partitioning samples, so that a slice has about SLICE_ROWS rows however uneven times are, and so has a key in
    a slice; what a key's earlier slices hold is carried along as their latest source. Rows of one key and time are one point, however many they are.
    """
    p = "_"
    while any(c.startswith(p) for c in rows.columns):
        p += "_"
    slices = max(1, rows.where(F.col(time).isNotNull()).count() // SLICE_ROWS)
    source = F.when(is_source, F.struct(F.col(time).alias("at"), value.alias("of")))
    points = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(F.col(key).alias(f"{p}k"), F.col(time).alias(f"{p}t")).agg(F.max(source).alias(f"{p}own"))
    if slices > 1:  # Spark samples the ranges; a time is in one of them, and what is written stays where it is
        points = cut(points.repartitionByRange(slices, f"{p}t").withColumn(f"{p}slice", F.spark_partition_id()), "slices")
    else:
        points = points.withColumn(f"{p}slice", F.lit(0))
    here = Window.partitionBy(f"{p}k", f"{p}slice").orderBy(f"{p}t").rowsBetween(Window.unboundedPreceding, -1)
    placed = points.withColumn(f"{p}here", F.max(f"{p}own").over(here))
    if slices > 1:
        latest = points.groupBy(f"{p}k", f"{p}slice").agg(F.max(f"{p}own").alias(f"{p}latest"))
        before = Window.partitionBy(f"{p}k").orderBy(f"{p}slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = latest.select(f"{p}k", f"{p}slice", F.max(f"{p}latest").over(before).alias(f"{p}carried"))
        placed = placed.join(carried, [f"{p}k", f"{p}slice"], "left")
    found = F.coalesce(f"{p}here", f"{p}carried") if slices > 1 else F.col(f"{p}here")
    answers = placed.select(f"{p}k", f"{p}t", found.alias("found"))
    kept = [c for c in rows.columns if c != "found"]
    joined = rows.select(*kept).join(answers, (F.col(key) == F.col(f"{p}k")) & (F.col(time) == F.col(f"{p}t")), "left")
    return joined.select(*kept, "found")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Every revisit of ``captures`` with its response.

    ``captures``: record_id (long), url, ts (long), revisit (boolean), etag, last_modified, digest, headers (map of
    lower-case names), body. Gives record_id, url_key, response_id, response_ts, verdict, headers, body.
    """
    rows = captures.select("record_id", canonical_url(F.col("url")).alias("url_key"), "ts", F.coalesce("revisit", F.lit(False)).alias("revisit"), "etag", "last_modified", "digest", "headers")
    facts = F.struct("record_id", "etag", "last_modified", "digest", F.map_entries("headers").alias("headers"))
    joined = as_of(rows, "url_key", "ts", ~F.col("revisit") & F.col("record_id").isNotNull(), facts).where("revisit")
    old = F.col("found.of")
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    pairs = [(F.col("digest"), old["digest"]), (weak(F.col("etag")), weak(old["etag"])), (F.col("last_modified"), old["last_modified"])]
    same = F.coalesce(*[a == b for a, b in pairs])
    verdict = F.when(F.col("found").isNull(), "unresolved").when(same.isNull(), "unchecked").when(same, "confirmed").otherwise("changed")
    own = F.map_filter(F.coalesce("headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: k.isin(PERMITTED))
    kept = F.map_filter(F.map_from_entries(F.coalesce(old["headers"], F.array().cast("array<struct<key:string,value:string>>"))), lambda k, v: ~F.array_contains(F.map_keys(own), k))
    out = joined.select("record_id", "url_key", old["record_id"].alias("response_id"), F.col("found.at").alias("response_ts"), verdict.alias("verdict"), own.alias("own"), F.map_concat(kept, own).alias("merged"))
    # a revisit without a response goes by its own id, so that such ones don't meet in one task
    bodies = captures.where(~F.coalesce("revisit", F.lit(False))).select(F.col("record_id").alias("_id"), F.lit(True).alias("_has"), "body").dropDuplicates(["_id"])
    out = out.withColumns({"_id": F.coalesce("response_id", "record_id"), "_has": F.col("response_id").isNotNull()}).join(bodies, ["_id", "_has"], "left")
    confirmed = F.col("verdict") == "confirmed"
    return out.select("record_id", "url_key", "response_id", "response_ts", "verdict", F.when(confirmed, F.col("merged")).otherwise(F.col("own")).alias("headers"), F.when(confirmed, F.col("body")).alias("body"))


# ------------------------------------------------------------------------------------------------ WARC files

RECORD = "record_type string, target string, date string, digest string, refers_to string, status int, headers map<string,string>, body binary"


def _fields(lines: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _records(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, gzipped (as a whole or by record) or not; a torn last record ends the file."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            lines = []
            while (line := stream.readline()).strip():
                lines.append(line.decode("utf-8", "replace"))
            warc = _fields(lines)
            block = stream.read(int(warc.get("content-length", 0)))
            status, headers, body = None, {}, block
            if block.startswith(b"HTTP/"):
                head, _, body = block.partition(b"\r\n\r\n")
                first, *rest = head.decode("latin-1").split("\r\n")
                code = re.match(r"HTTP/\S+ (\d{3})", first)
                status, headers = int(code[1]) if code else None, _fields(rest)
            yield {"record_type": warc.get("warc-type"), "target": warc.get("warc-target-uri", "").strip("<>") or None, "date": warc.get("warc-date"), "digest": warc.get("warc-payload-digest"), "refers_to": warc.get("warc-refers-to"), "status": status, "headers": headers, "body": body}
    except (EOFError, OSError):
        return


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files (each of a size that a task can hold, as crawlers write them)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for data in part["content"]:
                rows = []
                for record in _records(bytes(data)):
                    rows.append(record)
                    if len(rows) == 200:
                        yield pd.DataFrame(rows)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """Records of :func:`read` as the captures of :func:`resolve_revisits`; ids follow from URL, date and type."""
    revisit = (F.col("record_type") == "revisit") | (F.col("status") == 304)
    rows = records.where(F.col("record_type").isin("response", "revisit"))
    return rows.select(
        F.xxhash64("target", "date", "record_type").alias("record_id"),
        F.col("target").alias("url"),
        F.unix_seconds(F.to_timestamp("date")).alias("ts"),
        revisit.alias("revisit"),
        F.col("headers")["etag"].alias("etag"),
        F.col("headers")["last-modified"].alias("last_modified"),
        "digest",
        "headers",
        "body",
    )
