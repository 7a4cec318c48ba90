"""Streams with state and timers, and the outbox: the same as batches, whatever runs again."""

import os
import time

from pyspark.sql import functions as F

from larkspur.operators.state import cooldown
from larkspur.streaming import outbox as O
from larkspur.streaming import stateful as S

RUNS = "source long, at timestamp, seq long, failed boolean"


def put(spark, folder, k, rows):
    """Rows as the k-th file of a folder, in the order of names and times."""
    os.makedirs(folder, exist_ok=True)
    work = f"{folder}-w{k}"
    spark.createDataFrame(rows, "source long, s double, seq long, failed boolean").select("source", F.timestamp_millis((F.col("s") * 1000).cast("long")).alias("at"), "seq", "failed").coalesce(1).write.parquet(work)
    name = next(f for f in os.listdir(work) if f.startswith("part"))
    os.rename(f"{work}/{name}", f"{folder}/{k}.parquet")
    os.utime(f"{folder}/{k}.parquet", (time.time() - 1000 + k, time.time() - 1000 + k))


def stream(spark, folder):
    return spark.readStream.schema(RUNS).option("maxFilesPerTrigger", 1).parquet(folder)


def rows(df):
    return sorted(map(tuple, df.select("source", "at_ms", "seq", "kind", "held", "wait").collect()))


def test_cooldown_stream_is_the_batch_and_restarts(spark, tmp_path):
    # waits of 60, 120, 240 seconds: refusals in a row, successes in between, a source that never comes again, equal times
    runs = [(1, 0, True), (1, 30, True), (1, 300, True), (1, 310, False), (2, 5, True), (3, 10, False), (2, 64, True), (3, 700, True), (1, 900, True), (3, 900, True), (3, 900, False), (4, 1000, True), (1, 2000, False), (1, 5000, True), (9, 90_000, False)]
    made = [(source, at + 1_000_000.0, k, failed) for k, (source, at, failed) in enumerate(sorted(runs, key=lambda r: r[1]))]
    folder, work = str(tmp_path / "in"), str(tmp_path / "work")
    for k in range(3):
        put(spark, folder, k, made[3 * k : 3 * k + 3])
    first = S.run_cooldown(spark, stream(spark, folder), work)
    assert first.count() > 0
    for k in range(3, 5):
        put(spark, folder, k, made[3 * k : 3 * k + 3])
    log = rows(S.run_cooldown(spark, stream(spark, folder), work))  # goes on from its checkpoint
    table = spark.read.parquet(folder)
    want = rows(S.cooldown_log(table))
    assert [r for r in log if r[3] == "held"] == [r for r in want if r[3] == "held"]
    # the latest row is far behind all waits
    assert [r for r in log if r[3] == "released"] == [r for r in want if r[3] == "released"]
    last = {r.source: r.held for r in cooldown(table, 60.0, 3600.0).collect()}
    state = {r.source: r.held for r in S.cooldown_log(table).where("kind = 'held'").groupBy("source").agg(F.max_by("held", F.struct("at_ms", "seq")).alias("held")).collect()}
    assert state == last


def news(spark, rows):
    return spark.createDataFrame(rows, "reader long, item long, told string, title string, price double")


def test_outbox_tells_once(spark, tmp_path):
    sink, folder = O.outbox(str(tmp_path / "out"), most=2), str(tmp_path / "out")
    one = news(spark, [(1, 10, "CHEAPER", "Ring", 5.0), (1, 10, "CHEAPER", "Ring", 5.0), (1, 11, "SOLD", None, None), (2, 10, "CHEAPER", "Ring", 5.0), (None, 1, "x", "t", 1.0)])
    two = news(spark, [(1, 10, "CHEAPER", "Ring", 4.0), (1, 10, "SOLD", "Ring", None), (1, 12, "NEW", "A", 1.0), (1, 13, "NEW", "B", 1234.5), (3, 12, "NEW", "A", 1.0)])
    sink(one, 0)
    sink(one, 0)
    sink(two, 1)
    got = {(r.batch, r.reader): (r.subject, r.body) for r in O.messages(spark, folder).collect()}
    assert got == {
        (0, 1): ("2 pieces of news", "CHEAPER: Ring for $5.00\nSOLD: (no title)"), (0, 2): ("1 piece of news", "CHEAPER: Ring for $5.00"),
        (1, 1): ("3 pieces of news", "SOLD: Ring\nNEW: A for $1.00\nand 1 more"), (1, 3): ("1 piece of news", "NEW: A for $1.00"),
    }
    sink(two, 1)  # again after its commit: nothing of its own counts as told before
    assert {(r.batch, r.reader): (r.subject, r.body) for r in O.messages(spark, folder).collect()} == got
    O.receipt(O.unsent(spark, folder).where("reader = 1"), folder)
    assert sorted(r.reader for r in O.unsent(spark, folder).collect()) == [2, 3]


def test_batch_that_died_is_not_sent(spark, tmp_path):
    folder = str(tmp_path / "out")
    sink = O.outbox(folder)
    rows = news(spark, [(1, 10, "NEW", "A", 1.0)])
    sink(rows, 0)
    os.remove(f"{folder}/done/0")  # as if it had died before its marker
    assert O.messages(spark, folder).count() == 0
    sink(rows, 0)
    assert O.messages(spark, folder).count() == 1


def test_outbox_of_a_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    kind = "reader long, item long, told string, title string, price double"
    for k in range(3):
        news(spark, [(r, i, "NEW", f"t{i}", 1.0) for r in range(3) for i in range(k + 1)]).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)
    O.stream_outbox(stream(), str(tmp_path / "out"), str(tmp_path / "c"))
    O.stream_outbox(stream(), str(tmp_path / "out"), str(tmp_path / "c"))
    assert O.messages(spark, str(tmp_path / "out")).agg(F.sum("items")).first()[0] == 9


def test_prices_in_messages_are_plain(spark):
    rows = news(spark, [(1, 10, "NEW", "A", 1234.5), (1, 11, "NEW", "B", 0.5), (1, 12, "NEW", "C", 1234567.0)])
    assert O.rendered(rows, 0).first().body == "NEW: A for $1234.50\nNEW: B for $0.50\nNEW: C for $1234567.00"
