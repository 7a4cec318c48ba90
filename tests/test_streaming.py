"""Streams give what batches give."""

from pyspark.sql import functions as F

from larkspur.operators.state import change_log
from larkspur.sources.tables import price_changes
from larkspur.streaming import flows

SF = "/root/testdata/sf0.001"


def split(spark, tmp_path, parts=4):
    """The events in several files, in the order of time (as names and times of change go)."""
    import os
    import time

    rows = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").toPandas()
    os.makedirs(tmp_path / "in")
    for k in range(parts):
        part = rows.iloc[len(rows) * k // parts : len(rows) * (k + 1) // parts]
        name = tmp_path / "in" / f"{k}.parquet"
        spark.createDataFrame(part).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        os.rename(next((tmp_path / f"w{k}").glob("part*.parquet")), name)
        os.utime(name, (time.time() - 1000 + k, time.time() - 1000 + k))
    return str(tmp_path / "in")


def read(df):
    return df.select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.col("value").alias("price"), F.col("event_type").alias("type"))


def test_change_log_by_micro_batches(spark, tmp_path):
    folder = split(spark, tmp_path)
    schema = spark.read.parquet(folder).schema
    log = flows.stream_changes(spark, folder, schema, read, str(tmp_path / "work"))
    want = change_log(price_changes(spark, SF))
    key = lambda r: (r.item, r.seq)
    assert sorted(map(key, log.collect())) == sorted(map(key, want.collect()))


def test_batch_again_logs_once(spark, tmp_path):
    rows = price_changes(spark, SF)
    sink = flows.keep_changes(str(tmp_path / "state"), str(tmp_path / "log"))
    sink(rows, 0)
    sink(rows, 0)
    assert spark.read.parquet(str(tmp_path / "log")).count() == change_log(rows).count()


def test_generations_of_last_prices(spark, tmp_path):
    """Many batches, one run twice, with the state made anew every third one; old tables go."""
    import os

    rows = price_changes(spark, SF).toPandas().sort_values(["at", "seq"])
    sink = flows.keep_changes(str(tmp_path / "state"), str(tmp_path / "log"), 3)
    for k in range(11):
        part = spark.createDataFrame(rows.iloc[len(rows) * k // 11 : len(rows) * (k + 1) // 11]).withColumn("at", F.col("at").cast("timestamp_ntz"))
        for _ in range(2 if k in (3, 7, 9) else 1):
            sink(part, k)
    key = lambda r: (r.item, r.seq)
    assert sorted(map(key, spark.read.parquet(str(tmp_path / "log")).collect())) == sorted(map(key, change_log(price_changes(spark, SF)).collect()))
    assert sorted(os.listdir(tmp_path / "state")) == sorted(["all-6", "all-9", "6", "7", "8", "9", "10"])


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Fake

    import pytest

    session = lambda master, folder=None: Fake(conf=Fake(get=lambda key, default: folder), sparkContext=Fake(master=master))
    with pytest.raises(ValueError):
        flows.shared_folder(session("spark://host:7077"))
    assert flows.shared_folder(session("spark://host:7077", "file:///shared/")) == "file:///shared"
    assert flows.shared_folder(session("local[8]")).startswith("file:///tmp/")


def test_tumbling_windows_of_a_stream(spark, tmp_path):
    folder = split(spark, tmp_path)
    stream = read(spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)).withColumn("at", F.col("at").cast("timestamp"))
    query = flows.tumbling(stream, "1 day", "1 hour").writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {tuple(r) for r in spark.sql("select * from days").collect()}
    batch = {tuple(r) for r in flows.tumbling(price_changes(spark, SF).withColumn("at", F.col("at").cast("timestamp")), "1 day").collect()}
    assert got and got <= batch and len(batch - got) <= 10  # the last days stay open
