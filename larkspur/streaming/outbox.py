"""An outbox of messages to readers: each piece of news is told once, whatever runs again.

A piece of news has a key: the reader, the item and what is told of it. A micro-batch takes out what was told in earlier
batches, renders one message for each reader and writes both, the told keys and the messages, under its own number: a
batch that runs again finds what it found before and overwrites what it wrote. A message is there when its batch's commit marker
is; a batch that died halfway has none, so nobody sends what it left.

Sending is somebody else's: :func:`unsent` gives the messages without a receipt, and receipts are appended by the sender. A
message's id is a hash of its batch and reader, so a sender that sends again after a crash can be told apart by its receiver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["reader", "item", "told"]
TOLD = "reader long, item long, told string, batch long"
MESSAGES = "message string, reader long, subject string, body string, items long, batch long"


def rendered(news: DataFrame, batch: int, most: int = 20) -> DataFrame:
    """``message, reader, subject, body, items, batch``: one message for each reader; the first ``most`` items are lines, the rest a number.

    ``news``: reader, item, told, title, price. Lines are in the order of items, prices plain (``1234.50``); a message is small, however much there is to tell.
    """
    place = Window.partitionBy("reader").orderBy("item", "told")
    lines = news.withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= most)
    line = F.concat(F.col("told"), F.lit(": "), F.coalesce("title", F.lit("(no title)")), F.when(F.col("price").isNotNull(), F.concat(F.lit(" for $"), F.expr("format_number(price, '0.00')"))).otherwise(""))
    shown = lines.groupBy("reader").agg(F.array_sort(F.collect_list(F.struct("_k", line.alias("line")))).alias("_lines"))
    counts = news.groupBy("reader").agg(F.count("*").alias("items"))
    body = F.concat(F.array_join(F.transform("_lines", lambda x: x["line"]), "\n"), F.when(F.col("items") > most, F.concat(F.lit("\nand "), (F.col("items") - most).cast("string"), F.lit(" more"))).otherwise(""))
    subject = F.concat(F.col("items").cast("string"), F.when(F.col("items") == 1, " piece of news").otherwise(" pieces of news"))
    message = F.sha2(F.concat_ws("-", F.lit(batch), "reader"), 256)
    return counts.join(shown, "reader").select(message.alias("message"), F.col("reader").cast("long").alias("reader"), subject.alias("subject"), body.alias("body"), "items", F.lit(batch).cast("long").alias("batch"))


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _committed(spark: SparkSession, folder: str, before: int | None = None) -> list[int]:
    """The numbers of the batches whose marker is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/done")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = [int(x.getPath().getName()) for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in numbers if before is None or n < before)


def _read(spark: SparkSession, folder: str, kind: str, schema: str, numbers: list[int]) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{folder}/{kind}/{n}" for n in numbers]) if numbers else spark.createDataFrame([], schema)


def outbox(folder: str, most: int = 20) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: news (reader, item, told, title, price) into messages, each piece once."""

    def sink(news: DataFrame, number: int) -> None:
        spark = news.sparkSession
        told = _read(spark, folder, "told", TOLD, _committed(spark, folder, number))
        fresh = news.where("reader is not null and item is not null and told is not null").dropDuplicates(KEY).join(told.select(KEY), KEY, "left_anti")
        fresh.select(*KEY, "title", "price", F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{folder}/fresh/{number}")
        kept = spark.read.parquet(f"{folder}/fresh/{number}")  # which of two equal pieces stayed is settled now
        kept.select(*[F.col(c).cast(t) for c, t in (("reader", "long"), ("item", "long"))], "told", "batch").write.mode("overwrite").parquet(f"{folder}/told/{number}")
        rendered(kept, number, most).write.mode("overwrite").parquet(f"{folder}/messages/{number}")
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/done/{number}")
        done.getFileSystem(spark._jsc.hadoopConfiguration()).create(done, True).close()

    return sink


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """The messages of all committed batches."""
    return _read(spark, folder, "messages", MESSAGES, _committed(spark, folder))


def unsent(spark: SparkSession, folder: str) -> DataFrame:
    """The messages that no receipt (``folder/receipts``: message) is there for."""
    path = f"{folder}/receipts"
    receipts = spark.read.schema("message string").parquet(path) if _there(spark, path) else spark.createDataFrame([], "message string")
    return messages(spark, folder).join(receipts.distinct(), "message", "left_anti")


def receipt(sent: DataFrame, folder: str) -> None:
    """Notes messages (message) as sent."""
    sent.select("message").write.mode("append").parquet(f"{folder}/receipts")


def stream_outbox(news: DataFrame, folder: str, checkpoint: str, most: int = 20) -> None:
    """Runs the outbox over a stream of news as far as it goes."""
    news.writeStream.foreachBatch(outbox(folder, most)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
