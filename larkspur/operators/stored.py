"""State kept in bucketed tables: a day's run meets it without a shuffle of the state.

The table is cut by a hash of its key into a fixed number of buckets, each sorted, so a join on the key reads both sides
bucket by bucket: what is shuffled is the run's rows alone. A merge writes the next generation beside the present one, also in
buckets, and a pointer row names the one that counts; the generation before stays until the next merge, so a reader that has
begun is not disturbed and a merge that fails changes nothing.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..written import own_path
from .state import merge


class StateTable:
    """A table of state in the session's catalog. ``buckets`` is fixed when it is made: choose it for the size that the state will have."""

    def __init__(self, spark: SparkSession, name: str, key: str, buckets: int):
        self.spark, self.name, self.key, self.buckets = spark, name, key, buckets

    def _generation(self) -> int:
        known = [t.name for t in self.spark.catalog.listTables() if t.name.startswith(f"{self.name}_g")]
        return max((int(n.rsplit("_g", 1)[1]) for n in known), default=0)

    def write(self, rows: DataFrame) -> None:
        """Makes ``rows`` (one for each key) the next generation; the one before the last goes."""
        now = self._generation() + 1
        path = own_path(self.spark, f"{self.name}-{now}")
        # one task for each bucket, so that a bucket is one file
        (rows.repartition(self.buckets, self.key).sortWithinPartitions(self.key).write.bucketBy(self.buckets, self.key).sortBy(self.key)
             .option("path", path).format("parquet").saveAsTable(f"{self.name}_g{now}"))
        if now > 2:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_g{now - 2}")

    def read(self) -> DataFrame:
        return self.spark.table(f"{self.name}_g{self._generation()}")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """A run's rows by the table's buckets."""
        return rows.repartition(self.buckets, self.key)

    def merged(self, read: DataFrame, now: datetime) -> DataFrame:
        """The listings after a run (:func:`larkspur.operators.state.merge`): the state is read where it lies."""
        return merge(self.read(), self._dealt(read), self.key, now)

    def lookup(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """``rows`` with columns of the state."""
        return self._dealt(rows).join(self.read().select(self.key, *columns), self.key, "left")

    def apply(self, read: DataFrame, now: datetime) -> DataFrame:
        """Merges a run into the table; returns ``key, change`` of the run."""
        out = self.merged(read, now)
        self.write(out)
        changed = self.read().select(self.key, "change")
        return changed.where(F.col("change") != "unseen")


def shuffles_of(df: DataFrame, columns: set[str]) -> list[str]:
    """The exchanges of a plan whose rows have all of these columns: what a plan moves of a table."""
    found, stack = [], [df._jdf.queryExecution().executedPlan()]
    while stack:
        plan = stack.pop()
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            stack.append(plan.inputPlan())
            continue
        if plan.getClass().getSimpleName() == "ShuffleExchangeExec":
            names = {plan.output().apply(i).name() for i in range(plan.output().size())}
            if columns <= names:
                found.append(plan.simpleString(200))
        stack.extend(plan.children().apply(i) for i in range(plan.children().size()))
    return found
