"""The same questions of streams: windows with watermarks, sessions, and the change log by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cents
from ..operators.state import change_log
from ..written import shared_folder  # noqa: F401


def tumbling(events: DataFrame, length: str, late: str | None = None) -> DataFrame:
    """Counts and sums by window and type; with ``late``, windows close that long after the latest event."""
    rows = events.withWatermark("at", late) if late else events
    out = rows.groupBy(F.window("at", length).alias("w"), "type").agg(F.count("*").alias("n"), F.sum(cents(F.col("price"))).alias("cents"))
    return out.select(F.col("w.start").alias("start"), "type", "n", "cents")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """An item's events with less than ``gap`` between neighbours, as sessions."""
    out = events.groupBy(F.session_window("at", gap).alias("w"), "item").agg(F.count("*").alias("n"), F.max(cents(F.col("price"))).alias("most"))
    return out.select("item", F.col("w.start").alias("start"), "n", "most")


#: Batches after which the last prices are written as one table again.
GENERATION = 16
_LAST = "item long, seq long, at timestamp_ntz, price double, type string"


def _remove(spark: SparkSession, *paths: str) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("item").agg(F.max_by(F.struct("seq", "at", "price", "type"), F.struct("at", "seq")).alias("x")).select("item", "x.*")


def keep_changes(state_path: str, log_path: str, generation: int = GENERATION) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` that appends an item's observations to the log when its price changed.

    A batch writes the last prices of its own items only, beside a table of all of them that is made anew once a
    ``generation``; the tables of the generation before the last one are removed. A batch that runs again finds what it
    found before, overwrites its own prices and its own part of the log, and so logs each observation once.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        begin = number // generation * generation

        def known(start: int, end: int) -> DataFrame:
            paths = [f"{state_path}/all-{start}"] * (start > 0) + [f"{state_path}/{k}" for k in range(start, end)]
            return spark.read.schema(_LAST).parquet(*paths) if paths else spark.createDataFrame([], _LAST)

        if number == begin and number:
            _newest(known(begin - generation, begin)).write.mode("overwrite").parquet(f"{state_path}/all-{begin}")
            _remove(spark, f"{state_path}/all-{begin - 2 * generation}", *[f"{state_path}/{k}" for k in range(begin - 2 * generation, begin - generation)]) if begin >= 2 * generation else None
        rows = batch.select("item", "seq", F.col("at").cast("timestamp_ntz").alias("at"), "price", "type")
        last = _newest(known(begin, number).join(rows.select("item").distinct(), "item", "left_semi"))
        both = last.withColumn("_new", F.lit(False)).unionByName(rows.withColumn("_new", F.lit(True)))
        change_log(both).where("_new").drop("_new").write.mode("overwrite").parquet(f"{log_path}/batch={number}")
        _newest(both.drop("_new")).write.mode("overwrite").parquet(f"{state_path}/{number}")

    return sink


def stream_changes(spark: SparkSession, source: str, schema, read: Callable[[DataFrame], DataFrame], work: str, files: int = 1) -> DataFrame:
    """Runs the change log over the files of ``source`` as they come, and returns the log when all are read.

    Files have to come in the order of their events; the log is the batch form's. A single file is given as a pattern
    (``event[s].parquet``), as a stream reads folders.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    sink = keep_changes(f"{work}/state", f"{work}/log")
    query = read(stream).writeStream.foreachBatch(sink).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{work}/log").drop("batch")
