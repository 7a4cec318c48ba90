"""Sources that refuse, as a stream with state and timers: how much is held against each, and when it is asked again.

The state of a source is one small row in the state store (the level, and until when the source is left alone), kept
across batches and restarts. A timer in event time tells when a wait is over, also if the source never comes again.
The rows of a source are put in order within a micro-batch; between micro-batches they have to come in order, as the
watermark waits for a second only (rows that it drops as late never count).

What comes out does not depend on how the rows are cut into batches; :func:`cooldown_log` gives the same of a whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..functions.columns import backoff

ROW = "source long, at_ms long, seq long, failed boolean"
LOG = "source long, at_ms long, seq long, kind string, held long, wait double"
#: Seconds of the first wait and of the longest one.
FIRST, MOST = 60.0, 3600.0


def waits(held: int, first: float = FIRST, most: float = MOST) -> float:
    """The wait after so many refusals held: each doubles it."""
    return min(first * 2.0 ** (held - 1), most) if held > 0 else 0.0


class Cooldown(StatefulProcessor):
    """One more for a refusal, one less (never under zero) for a success; a row ``held`` for each run, one ``released`` when a wait is over."""

    def __init__(self, first: float = FIRST, most: float = MOST):
        self.first, self.most = first, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "held long, until long, seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs = pd.concat(list(rows)).sort_values(["at_ms", "seq"])  # of one source in one micro-batch
        held, until, last = self.state.get() if self.state.exists() else (0, 0, 0)
        if until:
            self.handle.deleteTimer(until)
        out = []
        for at, seq, failed in zip(runs["at_ms"].tolist(), runs["seq"].tolist(), runs["failed"].tolist()):
            if until and at >= until:
                out.append((key[0], until, last, "released", held, 0.0))
                until = 0
            held = held + 1 if failed else max(held - 1, 0)
            wait = waits(held, self.first, self.most)
            until, last = (at + int(wait * 1000) if held else 0), seq
            out.append((key[0], at, seq, "held", held, wait))
        self.state.update((held, until, last))
        if until:
            self.handle.registerTimer(until)
        yield self.rows(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, until, last = self.state.get()
        if until and expiredTimerInfo.getExpiryTimeInMs() == until:
            self.state.update((held, 0, last))
            yield self.rows([(key[0], until, last, "released", held, 0.0)])

    @staticmethod
    def rows(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["source", "at_ms", "seq", "kind", "held", "wait"]).astype({"source": "int64", "at_ms": "int64", "seq": "int64", "held": "int64", "wait": "float64"})

    def close(self) -> None:
        pass


def cooldown_stream(runs: DataFrame, first: float = FIRST, most: float = MOST, late: str = "1 second") -> DataFrame:
    """``runs`` (a stream: source, at, seq, failed) as the log of what is held and released."""
    rows = runs.select(F.col("source").cast("long").alias("source"), F.col("at").cast("timestamp").alias("at"), F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms"), F.col("seq").cast("long").alias("seq"), "failed")
    return rows.withWatermark("at", late).groupBy("source").transformWithStateInPandas(Cooldown(first, most), LOG, "Append", "eventTime")


def cooldown_log(runs: DataFrame, first: float = FIRST, most: float = MOST) -> DataFrame:
    """The same log of a whole table: levels by running sums, releases where the next run comes after the wait (or there is none)."""
    rows = runs.select(F.col("source").cast("long").alias("source"), F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms"), F.col("seq").cast("long").alias("seq"), "failed")
    own = Window.partitionBy("source").orderBy("at_ms", "seq")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = rows.withColumn("_sum", F.sum(F.when(F.col("failed"), 1).otherwise(-1)).over(upto)).withColumn("_low", F.least(F.lit(0), F.min("_sum").over(upto)))
    level = level.select("source", "at_ms", "seq", (F.col("_sum") - F.col("_low")).cast("long").alias("held"), F.lead("at_ms").over(own).alias("_next"))
    level = level.withColumn("wait", backoff(F.col("held"), first, most)).withColumn("_until", F.col("at_ms") + (F.col("wait") * 1000).cast("long"))
    over = (F.col("held") > 0) & (F.col("_next").isNull() | (F.col("_next") >= F.col("_until")))
    both = F.array(F.struct(F.col("at_ms"), F.lit("held").alias("kind"), F.col("wait")), F.when(over, F.struct(F.col("_until").alias("at_ms"), F.lit("released").alias("kind"), F.lit(0.0).alias("wait"))))
    return level.select("source", "seq", "held", F.explode(F.array_compact(both)).alias("x")).select("source", "x.at_ms", "seq", "x.kind", "held", "x.wait")


def run_cooldown(spark: SparkSession, runs: DataFrame, work: str, first: float = FIRST, most: float = MOST) -> DataFrame:
    """Runs the stream over what is there, from where it stopped the last time, and returns its whole log so far.

    The log is written by a sink that commits each micro-batch once; the last waits stay open until something comes after them.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = cooldown_stream(runs, first, most).writeStream.format("parquet").option("path", f"{work}/log").option("checkpointLocation", f"{work}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(LOG).parquet(f"{work}/log")
