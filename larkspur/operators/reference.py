"""Keeping the reference tables: proposals, promotions, renames, undone merges, and the log that allows it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .market import instant
from .matching import rule_hits


def mentions(rows: DataFrame, key: str, text: str, spellings: DataFrame) -> DataFrame:
    """``key, value``: the rows whose text has a spelling of a reference row: the ones to read again when it changes."""
    rules = spellings.select(F.lit(0).alias("position"), F.col("spelling"), F.col("value"))
    return rule_hits(rows, key, text, rules).select(key, "value").distinct()


def propose(candidates: DataFrame, known: DataFrame, name: str, least: int) -> DataFrame:
    """Names seen often enough that no reference row has (by its spelling without case and punctuation)."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    counts = candidates.groupBy(plain(F.col(name)).alias("_p")).agg(F.min(name).alias(name), F.count("*").alias("sightings")).where((F.col("sightings") >= least) & (F.col("_p") != ""))
    return counts.join(known.select(plain(F.col(name)).alias("_p")).distinct(), "_p", "left_anti").drop("_p")


def rename(table: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """``table`` (key, name, aliases) with new primary names (key, new): the old name becomes an alias, the new one stops being one."""
    joined = table.join(names, key, "left")
    change = F.col("new").isNotNull() & (F.col("new") != F.col("name"))
    aliases = F.array_sort(F.array_distinct(F.filter(F.concat("aliases", F.array("name")), lambda a: a != F.col("new"))))
    return joined.withColumns({"aliases": F.when(change, aliases).otherwise(F.col("aliases")), "name": F.when(change, F.col("new")).otherwise(F.col("name"))}).drop("new")


def logged(before: DataFrame, key: str, action: str, seq: int) -> DataFrame:
    """What a change is about to replace, as rows of the append-only log: key, action, seq, state (JSON)."""
    rest = [c for c in before.columns if c != key]
    return before.select(key, F.lit(action).alias("action"), F.lit(seq).alias("seq"), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("state"))


def reverted(table: DataFrame, log: DataFrame, key: str, seq: int) -> DataFrame:
    """``table`` as it was before the logged change ``seq``: logged rows come back whole, the others stay."""
    rest = [c for c in table.columns if c != key]
    kind = table.select(*rest).schema
    old = log.where(F.col("seq") == seq).select(key, F.from_json("state", kind).alias("_s"))
    both = table.join(old, key, "full_outer")
    return both.select(key, *[F.when(F.col("_s").isNotNull(), F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c) for c in rest])


def rekeyed(known: DataFrame, read: DataFrame, key: str, within: Sequence[str] = ()) -> DataFrame:
    """``known`` with the keys that a run's rows replace (read: key, replaces) taken over; a key that is read itself stays.

    Keys are unique ``within`` the named columns of both tables (a shop's keys are its own), and so is what they replace; a null there is a value.
    Of several new keys that claim an old one, the smallest has it; of several old ones that a new key claims, the first seen.
    """
    scope = F.struct(*within) if within else F.lit(0)  # a struct with nulls in it is no null
    known, read = known.withColumn("_w", scope), read.withColumn("_w", scope)
    claims = read.select("_w", F.col(key).alias("_new"), F.explode("replaces").alias(key)).join(read.select("_w", key).distinct(), ["_w", key], "left_anti")
    claims = claims.join(known.select("_w", F.col(key).alias("_new")).distinct(), ["_w", "_new"], "left_anti").groupBy("_w", key).agg(F.min("_new").alias("_new"))
    first = Window.partitionBy("_w", "_new").orderBy("first_seen", key)
    held = known.select("_w", key, "first_seen").join(claims, ["_w", key]).withColumn("_k", F.row_number().over(first)).where("_k = 1").select("_w", key, "_new")
    return known.join(held, ["_w", key], "left").withColumn(key, F.coalesce("_new", key)).drop("_new", "_w")


def inherit_first_seen(rows: DataFrame, key: str, parent: str) -> DataFrame:
    """Rows split from another one are as old as it is."""
    parents = rows.select(F.col(key).alias("_p"), F.col("first_seen").alias("_f"))
    return rows.join(parents, F.col(parent) == F.col("_p"), "left").withColumn("first_seen", F.least("first_seen", "_f")).drop("_p", "_f")


def queue(rows: DataFrame, attempts: str, most: int, n: int, key: str) -> DataFrame:
    """The next work: fewest attempts first, none beyond ``most``."""
    return rows.where(F.col(attempts) < most).orderBy(attempts, key).limit(n)


def reaped(runs: DataFrame, now: datetime, hours: int) -> DataFrame:
    """Runs with those that have been running for too long marked as failed."""
    stale = (F.col("status") == "running") & (F.col("started_at") < instant(now) - F.make_dt_interval(hours=F.lit(hours)))
    return runs.withColumns({"finished_at": F.when(stale, instant(now)).otherwise(F.col("finished_at")), "status": F.when(stale, "failed").otherwise(F.col("status"))})


def usage(reference: DataFrame, rows: DataFrame, key: str, group: str, kind: str) -> DataFrame:
    """By group of a reference table: its entries, their kinds, how many of them have rows, and how many rows these are."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    joined = reference.select(key, group, kind).join(counts, key, "left")
    return joined.groupBy(group).agg(F.count_distinct(key).alias("models"), F.count_distinct(kind).alias("kinds"), F.count_if(F.col("_n") > 0).alias("listed"), F.coalesce(F.sum("_n"), F.lit(0)).alias("listings"))
