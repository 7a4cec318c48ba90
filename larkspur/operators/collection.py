"""What readers keep: wishes, collections, saved searches, and their totals and news."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.filters import FilterSpec
from .market import departed, for_sale, instant


def paired_totals(rows: DataFrame, keys: list[str], cost: str, value: str) -> DataFrame:
    """Sums of cost and value over the rows that have both, and how many have not."""
    both = F.col(cost).isNotNull() & F.col(value).isNotNull()
    return rows.groupBy(*keys).agg(F.sum(F.when(both, F.col(cost))).alias("cost"), F.sum(F.when(both, F.col(value))).alias("value"), F.count_if(both).alias("paired"), F.count_if(~both).alias("unpaired"))


def snapshots_due(values: DataFrame, taken: DataFrame, key: str, now: datetime, days: int = 7) -> DataFrame:
    """Values to record now: those of keys without a snapshot in the last ``days``."""
    recent = taken.where(F.col("recorded_at") > instant(now) - F.make_dt_interval(days=F.lit(days))).select(key).distinct()
    return values.join(recent, key, "left_anti").withColumn("recorded_at", instant(now))


def series(taken: DataFrame, day: Column, value: str) -> DataFrame:
    """Sum and number of the values of each day."""
    return taken.groupBy(day.alias("day")).agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def comparables(listings: DataFrame, wanted: DataFrame, key: str, most: int = 50) -> DataFrame:
    """For each wanted key its latest departures and its cheapest rows on the shelf, ``most`` of each."""
    gone = departed(listings).withColumn("basis", F.lit("departed")).withColumn("_o", -F.unix_micros(F.coalesce("sold_at", "delisted_at").cast("timestamp")).cast("double"))
    shelf = for_sale(listings).where("price > 0").withColumn("basis", F.lit("shelf")).withColumn("_o", F.col("price"))
    rows = gone.unionByName(shelf).join(wanted.select(key).distinct(), key, "left_semi")
    order = Window.partitionBy(key, "basis").orderBy("_o", "item")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("_o")


def saved_matches(rows: DataFrame, specs: Mapping[str, FilterSpec], searched: tuple[str, ...] = ("title",)) -> DataFrame:
    """``search, item`` of every saved search that a row matches, in one scan over the rows."""
    hits = F.array_compact(F.array(*[F.when(s.predicate(searched=searched), F.lit(k)) for k, s in specs.items()]))
    return rows.select(F.explode(hits).alias("search"), "item")


def untold(matches: DataFrame, told: DataFrame) -> DataFrame:
    """Matches that were not announced before."""
    return matches.join(told.select("search", "item").distinct(), ["search", "item"], "left_anti")


def want_hits(rows: DataFrame, specs: Mapping[str, FilterSpec], since: Mapping[str, datetime], told: DataFrame, searched: tuple[str, ...] = ("title",)) -> DataFrame:
    """``rows`` that a search has to announce, with ``search``: available ones that match, are new, cheaper or back since the search's moment, and were not told.

    A search without a moment announces nothing. What a search says of availability doesn't count. One scan over the rows for all searches.
    """
    live = {k: replace(s, availability="available") for k, s in specs.items() if since.get(k) is not None}

    def news(moment: datetime) -> Column:
        from_then = lambda c: F.coalesce(F.col(c) >= instant(moment), F.lit(False))
        cheaper = F.coalesce(F.col("price") < F.col("previous_price"), F.lit(False))
        return from_then("first_seen") | (from_then("price_changed_at") & cheaper) | from_then("restocked_at")

    hits = [F.when(s.predicate(searched=searched) & news(since[k]), F.lit(k)) for k, s in live.items()]
    found = rows.select("*", F.explode(F.array_compact(F.array(*hits).cast("array<string>"))).alias("search"))
    return found.join(told.select("search", "item").distinct(), ["search", "item"], "left_anti")


def want_news(hits: DataFrame, specs: Mapping[str, FilterSpec], most: int = 10) -> DataFrame:
    """``search, item, place, fresh``: the first ``most`` hits of each search in the search's own order, and how many it has in all.

    Searches of one order are ranked together; Spark keeps the first of each search before it shuffles.
    """
    total = hits.groupBy("search").agg(F.count("*").alias("fresh"))
    shown = hits.select("search", "item").withColumn("place", F.lit(0)).limit(0)
    for sort in sorted({s.sort for s in specs.values()}):
        own = [k for k, s in specs.items() if s.sort == sort]
        place = F.row_number().over(Window.partitionBy("search").orderBy(*FilterSpec(sort=sort).order()))
        shown = shown.union(hits.where(F.col("search").isin(own)).select("search", "item", place.alias("place")).where(F.col("place") <= most))
    return shown.join(total, "search").select("search", "item", "place", "fresh")


def wish_totals(wishes: DataFrame, listings: DataFrame, shipping: DataFrame, fee: float, waived_from: float) -> DataFrame:
    """By reader: what the wished items cost at the door. A source's fee is due once an order, and not from a sum on; a wish counts once."""
    rows = wishes.select("reader", "item").distinct().join(listings.select("item", "source", "price", "active", "sold"), "item").join(shipping, "source", "left")
    live = rows.where(F.col("active") & ~F.col("sold") & (F.col("price") > 0))
    orders = live.groupBy("reader", "source").agg(F.sum("price").alias("goods"), F.sum(F.coalesce("shipping", F.lit(0.0))).alias("sent"), F.count("*").alias("n"), F.max(F.col("shipping").isNull()).alias("open"))
    due = F.when(F.col("goods") >= waived_from, 0.0).otherwise(fee)
    return orders.groupBy("reader").agg(F.sum("n").alias("items"), F.bround(F.sum("goods"), 2).alias("goods"), F.bround(F.sum(F.col("goods") + F.col("sent") + due), 2).alias("delivered"), (~F.max("open")).alias("complete"))


def fits(owned: DataFrame, accessories: DataFrame, most: int = 12) -> DataFrame:
    """For each owned item the accessories with a line that names its model, in stock first, then by price.

    Items of the same models have the same accessories: these are ranked once for each set of models, and only the first ``most`` meet the items.
    """
    lines = accessories.select("accessory", "price", "in_stock", F.explode("lines").alias("model"))
    items = owned.groupBy("owned").agg(F.sort_array(F.collect_set("model")).alias("_models"))
    found = items.select("_models").distinct().select("_models", F.explode("_models").alias("model")).join(lines, "model")
    found = found.groupBy("_models", "accessory").agg(F.min("price").alias("price"), F.max("in_stock").alias("in_stock"))
    order = Window.partitionBy("_models").orderBy(F.desc("in_stock"), F.col("price").asc_nulls_last(), "accessory")
    first = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return items.join(first, "_models").select("owned", "accessory", "price", "in_stock", "place")
