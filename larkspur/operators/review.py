"""What changed and what is waiting: weekly reviews, digests, deals under the new price, alerts, backlogs, and counts of states."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import cents, holds
from ..functions.ranks import nearest_ranks
from .market import SHELF, instant


def weekly_shelf(changes: DataFrame, items: DataFrame, now: datetime, weeks: int = 26, least: int = 5) -> DataFrame:
    """``value, week, listings`` and the band of the prices asked for what was for sale at the end of each week.

    ``items``: item, value, first_seen, gone (null while there). An item's price is its last one up to then, and it counts
    only if it was seen by then and had not gone. Each change meets only the weeks that it covers.
    """
    ends = [now - timedelta(days=7 * k) for k in range(weeks - 1, -1, -1)]
    own = Window.partitionBy("item").orderBy("at", "seq")
    spans = changes.select("item", "price", "at", F.lead("at").over(own).alias("until")).join(items, "item")
    there = lambda w: (w >= F.col("at")) & (F.col("until").isNull() | (w < F.col("until"))) & (w >= F.col("first_seen")) & (F.col("gone").isNull() | (w < F.col("gone")))
    points = spans.select("price", "value", F.explode(F.filter(F.array(*[instant(e) for e in ends]), there)).alias("week"))
    ranks = nearest_ranks(points, ["value", "week"], "price", SHELF)
    return ranks.where(F.col("n") >= least).select("value", "week", F.col("n").alias("listings"), *SHELF)


def under_new(rows: DataFrame, variants: DataFrame, least: float = 25.0, most: float = 65.0) -> DataFrame:
    """Available rows of exactly one variant that are far enough, and not too far, under its new price (``variant, new_price``)."""
    live = rows.where(F.col("active") & ~F.col("sold") & (F.col("price") > 0) & F.col("variant").isNotNull())
    under = 100.0 * (F.col("new_price") - F.col("price")) / F.col("new_price")
    return live.join(variants.where("new_price > 0").select("variant", "new_price"), "variant").withColumn("under_new", under).where(F.col("under_new").between(least, most))


def all_deals(peers: DataFrame, new: DataFrame) -> DataFrame:
    """``item, price, median, discount, new_price, under_new``: deals by either rule, one row each."""
    a = peers.select("item", "price", "median", "discount")
    b = new.select("item", F.col("price").alias("_p"), "new_price", "under_new")
    return a.join(b, "item", "full_outer").select("item", F.coalesce("price", "_p").alias("price"), "median", "discount", "new_price", "under_new")


#: Orders of deals; the item decides between equals.
DEAL_ORDERS = {
    "discount": lambda: F.coalesce("discount", "under_new").desc_nulls_last(),
    "saving": lambda: (F.coalesce("median", "new_price") - F.col("price")).desc_nulls_last(),
    "price_asc": lambda: F.col("price").asc_nulls_last(),
    "price_desc": lambda: F.col("price").desc_nulls_last(),
    "newest": lambda: F.col("first_seen").desc_nulls_last(),
}


def deals_in_order(deals: DataFrame, order: str, most: int) -> DataFrame:
    return deals.orderBy(DEAL_ORDERS[order](), F.col("item").asc()).limit(most)


def price_dropped(price: Column, previous: Column) -> Column:
    """Whether the price is lower than the one before, in whole cents; unknown prices never are."""
    return holds(cents(price) < cents(previous))


def week_in_review(listings: DataFrame, changes: DataFrame, sources: DataFrame, since: datetime, until: datetime, least: float = 5.0) -> DataFrame:
    """What each source did in ``(since, until]``: added, sold, gone, reduced, the reductions' total, and whether it was silent.

    An item is reduced if its last change in the window took ``least`` or more off. Every enabled source has a row, others only
    if they did something. ``changes``: item, source, at, seq, price; ``sources``: source, enabled.
    """
    inside = lambda c: (F.col(c) > instant(since)) & (F.col(c) <= instant(until))
    counts = listings.groupBy("source").agg(F.count_if(inside("first_seen")).alias("added"), F.count_if(inside("sold_at")).alias("sold"), F.count_if(inside("delisted_at")).alias("gone"))
    steps = changes.select("item", "source", "at", "seq", "price", F.lag("price").over(Window.partitionBy("item").orderBy("at", "seq")).alias("was")).where(inside("at"))
    last = steps.groupBy("source", "item").agg(F.max(F.struct("at", "seq", "was", "price")).alias("x"))
    drop = F.col("x.was") - F.col("x.price")
    cuts = last.where(drop >= least).groupBy("source").agg(F.count("*").alias("reduced"), F.bround(F.sum(drop.cast("decimal(18,2)")).cast("double"), 2).alias("reduction"))
    out = sources.join(counts, "source", "left").join(cuts, "source", "left").na.fill(0, ["added", "sold", "gone", "reduced"]).na.fill(0.0, ["reduction"])
    out = out.withColumn("silent", (F.col("added") == 0) & (F.col("sold") == 0) & (F.col("gone") == 0) & (F.col("reduced") == 0))
    return out.where(F.col("enabled") | ~F.col("silent"))


def arrivals(listings: DataFrame, since: datetime, until: datetime, most: int = 8) -> DataFrame:
    """The dearest rows that came in the window."""
    came = listings.where((F.col("first_seen") > instant(since)) & (F.col("first_seen") <= instant(until)))
    return came.orderBy(F.col("price").desc_nulls_last(), "item").limit(most)


def digest_drops(rows: DataFrame, since: datetime, least: float, most: int) -> DataFrame:
    """By source the latest price drops since a moment, of at least an amount: ``source, place, item``."""
    live = rows.where(F.col("active") & ~F.col("sold") & (F.col("changed_at") > instant(since)) & price_dropped(F.col("price"), F.col("previous")) & (F.col("previous") - F.col("price") >= least))
    order = Window.partitionBy("source").orderBy(F.desc("changed_at"), "item")
    return live.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def wish_alert(told_state: Column, told_price: Column, state: Column, price: Column) -> Column:
    """SOLD, GONE or BACK where the state is another than the one told; else CHEAPER or DEARER than told; null for no news."""
    turned = F.when(state == "sold", "SOLD").when(state == "gone", "GONE").otherwise("BACK")
    moved = F.when(price < told_price, "CHEAPER").when(price > told_price, "DEARER")
    return F.when(told_state.isNotNull(), F.when(state != told_state, turned).when(state == "for_sale", moved))


def excused(last_success: Column, interval_minutes: Column, now: datetime, grace: timedelta = timedelta(hours=24), scans: int = 3) -> Column:
    """Whether a resting source is excused: read within the grace, or within a few of its own intervals if these are longer."""
    allowed = F.greatest(F.lit(grace.total_seconds()), F.coalesce(interval_minutes, F.lit(0)) * (60.0 * scans))
    rested = (F.unix_micros(instant(now).cast("timestamp")) - F.unix_micros(last_success.cast("timestamp"))) / 1e6
    return holds(rested <= allowed)


def reload_cost(bullet: Column, case: Column, powder: Column, primer: Column) -> Column:
    """What one round costs, reloaded; null until all four parts are known."""
    return F.bround(bullet + case + powder + primer, 4)


def bullet_cost(weights: Column, wanted: Column, usual: Column) -> Column:
    """The price at the wanted weight (``array<struct<grains, cost>>``, within half a grain), or the usual one."""
    fits = F.filter(weights, lambda w: (F.abs(w["grains"] - wanted) < 0.5) & (w["cost"] > 0))
    return F.coalesce(F.get(fits, F.lit(0))["cost"], usual)


def freshness(rows: DataFrame, key: str, updated: Column) -> DataFrame:
    """One row that changes whenever the table does: its size, its largest key, its last change."""
    return rows.agg(F.count("*").alias("n"), F.max(key).alias("last_key"), F.max(updated).alias("last_change"))


def pending(tables: dict[str, DataFrame], condition: Column) -> DataFrame:
    """How many rows of each table wait: ``name, n``, a table without any too."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count_if(condition).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def state_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status", "enabled").agg(F.count("*").alias("n"))


#: What a reader of a reference table may ask to see.
STATUS_VIEWS = {
    "everything": lambda: F.lit(True),
    "approved": lambda: (F.col("status") == "approved") & F.col("enabled"),
    "pending": lambda: F.col("status") == "pending",
    "disabled": lambda: ~F.col("enabled"),
}


def backlog(photos: DataFrame, items: DataFrame) -> DataFrame:
    """By source: photos that wait, that are stored and that failed, of active items, and how many items have none stored."""
    rows = items.where("active").select("item", "source").join(photos, "item", "left")
    per_item = rows.groupBy("source", "item").agg(F.count_if(F.col("state") == "waiting").alias("waiting"), F.count_if(F.col("state") == "stored").alias("stored"), F.count_if(F.col("state") == "failed").alias("failed"))
    return per_item.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("waiting", "stored", "failed")], F.count_if(F.col("stored") == 0).alias("bare"))


def sole_makers(bridge: DataFrame) -> DataFrame:
    """``model, maker`` of the models that exactly one maker is known for."""
    return bridge.distinct().groupBy("model").agg(F.count("*").alias("_n"), F.min("maker").alias("maker")).where("_n = 1").drop("_n")


def runs_straight(evidence: DataFrame, least: int = 8, backward: float = 0.1) -> DataFrame:
    """``model, n, backward, straight``: whether serials rise with the years, few neighbours running backward (``serial, first, last``)."""
    order = Window.partitionBy("model").orderBy("serial", "first")
    steps = evidence.select("model", (F.col("last") < F.lag("first").over(order)).cast("int").alias("back"))
    counts = steps.groupBy("model").agg(F.count("*").alias("n"), F.coalesce(F.sum("back"), F.lit(0)).alias("backward"))
    return counts.withColumn("straight", (F.col("n") >= least) & (F.col("backward") <= backward * (F.col("n") - 1)))


def mentioned(*parts: DataFrame) -> DataFrame:
    """The sources that any of the parts names, once each."""
    out = parts[0].select("source")
    for p in parts[1:]:
        out = out.union(p.select("source"))
    return out.distinct()


def dated_by_serial(points: DataFrame, ranges: DataFrame, widest: int = 2, bucket: int = 1000) -> DataFrame:
    """``item, first, last``: the years of the range that holds a serial of the same model and prefix; null where ranges disagree by more than ``widest`` years.

    ``points``: item, model, maker, prefix, serial; ``ranges``: model, maker (null: any), prefix, low, high, year_from, year_to.
    A range of the item's own maker goes before one of any maker. Ranges meet by buckets of serials.
    """
    cut = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col("low") / bucket), F.floor(F.col("high") / bucket)))).withColumnRenamed("maker", "_maker")
    met = points.withColumn("_b", F.floor(F.col("serial") / bucket)).join(cut, ["model", "prefix", "_b"])
    met = met.where(F.col("serial").between(F.col("low"), F.col("high")) & (F.col("_maker").isNull() | F.col("_maker").eqNullSafe(F.col("maker"))))
    best = met.withColumn("_any", F.max(F.col("_maker").isNotNull()).over(Window.partitionBy("item"))).where(F.col("_maker").isNotNull() == F.col("_any"))
    years = best.groupBy("item").agg(F.min("year_from").alias("first"), F.max("year_to").alias("last"))
    return years.where(F.col("last") - F.col("first") <= widest)


def filled(rows: DataFrame, donors: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``rows`` with the empty fields of each taken from its donor (``key, donor``), and the names of the fields filled."""
    given = rows.select(F.col(key).alias("donor"), *[F.col(f).alias(f"_{f}") for f in fields])
    out = rows.join(donors.select(key, "donor"), key, "left").join(given, "donor", "left")
    empty = lambda f: F.col(f).isNull() & F.col(f"_{f}").isNotNull()
    took = F.array_compact(F.array(*[F.when(empty(f), F.lit(f)) for f in fields]))
    return out.select(*[F.coalesce(c, f"_{c}").alias(c) if c in fields else c for c in rows.columns], took.alias("filled"))


def usual_weights(offers: DataFrame, key: str, weight: str) -> DataFrame:
    """The weight most offered for each key (the lighter of equals), for those that ask for none."""
    counts = offers.where(F.col(weight).isNotNull()).groupBy(key, weight).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.max_by(F.col(weight), F.struct("n", -F.col(weight))).alias(weight))


def watch_history(history: DataFrame, polled: DataFrame) -> DataFrame:
    """What a poll of watched items adds to the price history: a row for each whose price is another than the last one (``source`` = watch)."""
    last = history.groupBy("item").agg(F.max_by("price", F.struct("at", "seq")).alias("_last"))
    new = polled.join(last, "item", "left").where(F.col("price").isNotNull() & ~cents(F.col("price")).eqNullSafe(cents(F.col("_last"))))
    return new.select("item", "at", "price", F.lit("watch").alias("source"))


def transitions(reference: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Reference rows after ``wanted`` (key, action) changes of status: promote, send_back, disable, enable; and whether each changed.

    The spellings of a row that changed are what :func:`larkspur.operators.reference.mentions` is asked about next.
    """
    out = reference.join(wanted.select(key, "action"), key, "left")
    status = F.when(F.col("action") == "promote", "approved").when(F.col("action") == "send_back", "pending").otherwise(F.col("status"))
    enabled = F.when(F.col("action") == "disable", False).when(F.col("action").isin("enable", "promote"), True).otherwise(F.col("enabled"))
    changed = ~status.eqNullSafe(F.col("status")) | ~enabled.eqNullSafe(F.col("enabled"))
    made = {"status": status, "enabled": enabled}
    return out.select(*[made.get(c, F.col(c)).alias(c) for c in reference.columns], changed.alias("changed"))


def tidy_plan(reference: DataFrame, key: str, name: str) -> DataFrame:
    """``loser, winner``: names that are one without case, spaces and punctuation; the row with the most uses wins, then the smaller key.

    Nothing is changed: the plan is read first, and given to :func:`larkspur.operators.matching.merge_rows` to apply.
    """
    plain = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    rows = reference.select(F.col(key).alias("_k"), "uses", plain.alias("_plain")).where("_plain <> ''")
    best = rows.groupBy("_plain").agg(F.min(F.struct((-F.col("uses")).alias("u"), F.col("_k").alias("k"))).alias("w"))
    return rows.join(best, "_plain").where(F.col("_k") != F.col("w.k")).select(F.col("_k").alias("loser"), F.col("w.k").alias("winner"))


def product_matches(products: DataFrame, entries: DataFrame) -> DataFrame:
    """``product, entry, how``: by number and set of words, where one entry has them; else by the number alone, where it is one product's and one entry's.

    Both sides: their key, ``number`` and ``words`` (array).
    """
    p = products.select("product", "number", F.array_sort(F.array_distinct("words")).alias("words"))
    e = entries.select("entry", "number", F.array_sort(F.array_distinct("words")).alias("words"))
    one = e.groupBy("number", "words").agg(F.count("*").alias("_n"), F.min("entry").alias("entry")).where("_n = 1").drop("_n")
    exact = p.join(one, ["number", "words"]).select("product", "entry", F.lit("exact").alias("how"))
    left = p.join(exact.select("product"), "product", "left_anti")
    alone = left.groupBy("number").agg(F.count("*").alias("_n"), F.min("product").alias("product")).where("_n = 1").drop("_n")
    single = e.groupBy("number").agg(F.count("*").alias("_n"), F.min("entry").alias("entry")).where("_n = 1").drop("_n")
    return exact.union(alone.join(single, "number").select("product", "entry", F.lit("number").alias("how")))
