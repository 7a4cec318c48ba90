"""Changes over time: merging what was read into what is known, and telling what is news."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import backoff, cents
from .market import instant

HALF_CENT = 0.005


def last_write(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row for each key, the last written; found by a maximum, which is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("x"), F.count("*").alias("writes"))
    return best.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest], "writes")


def change_log(rows: DataFrame, key: str = "item", order: tuple[str, ...] = ("at", "seq")) -> DataFrame:
    """Observations at which the price, in whole cents, differs from the item's last one; and each first one."""
    own = Window.partitionBy(key).orderBy(*order)
    before = F.lag(cents(F.col("price"))).over(own)
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != cents(F.col("price")))).drop("_before")


def merge(known: DataFrame, read: DataFrame, key: str, now: datetime) -> DataFrame:
    """The listings after a run: new ones come in, read ones are updated without losing what is not stated again.

    ``known``: key, title, price, previous_price, sold, active, first_seen, last_seen, sold_at, restocked_at,
    price_changed_at. ``read``: key, title, price, sold (the run's last write for each key). Both meet on the key in one
    full outer join; ``change`` says what became of a row.
    """
    k, r, at = known.alias("k"), read.alias("r"), instant(now)
    both = k.join(r, F.col(f"k.{key}") == F.col(f"r.{key}"), "full_outer")
    was, here = F.col(f"k.{key}").isNotNull(), F.col(f"r.{key}").isNotNull()
    moved = was & here & F.col("r.price").isNotNull() & ~cents(F.col("r.price")).eqNullSafe(cents(F.col("k.price")))
    sold_now = here & F.coalesce("r.sold", F.lit(False))
    change = (
        F.when(~was, "new").when(~here, "unseen").when(~F.coalesce("k.active", F.lit(False)), "reactivated")
        .when(sold_now & ~F.col("k.sold"), "sold").when(~sold_now & F.col("k.sold"), "restocked").when(moved, "repriced").otherwise("same")
    )
    return both.select(
        F.coalesce(f"k.{key}", f"r.{key}").alias(key),
        F.coalesce("r.title", "k.title").alias("title"),
        F.coalesce("r.price", "k.price").alias("price"),
        F.when(moved, F.col("k.price")).otherwise(F.col("k.previous_price")).alias("previous_price"),
        F.when(here, sold_now).otherwise(F.col("k.sold")).alias("sold"),
        (here | F.coalesce("k.active", F.lit(False))).alias("active"),
        F.coalesce(F.col("k.first_seen"), at).alias("first_seen"),
        F.when(here, at).otherwise(F.col("k.last_seen")).alias("last_seen"),
        F.when(sold_now & ~F.coalesce("k.sold", F.lit(False)), at).when(here & ~sold_now, F.lit(None)).otherwise(F.col("k.sold_at")).alias("sold_at"),
        F.when(here & was & ~sold_now & F.col("k.sold"), at).otherwise(F.col("k.restocked_at")).alias("restocked_at"),
        F.when(moved, at).otherwise(F.col("k.price_changed_at")).alias("price_changed_at"),
        change.alias("change"),
    )


def delisting(active: DataFrame, seen: DataFrame, keys: list[str], group: str, share: float = 0.5, guarded_from: int = 20) -> DataFrame:
    """Active rows that a run did not see, by source; a source that would lose too large a share of many rows loses none."""
    missing = active.join(seen.select(*keys).distinct(), keys, "left_anti")
    sizes = active.groupBy(group).agg(F.count("*").alias("_all"))
    going = missing.groupBy(group).agg(F.count("*").alias("_going"))
    held = sizes.join(going, group).where((F.col("_all") >= guarded_from) & (F.col("_going") > share * F.col("_all"))).select(group)
    return missing.join(held, group, "left_anti")


def peak_since(told: DataFrame, changes: DataFrame) -> DataFrame:
    """``told`` (item, price, told_at) with ``peak``: the highest price seen after telling; null without one."""
    after = changes.join(told.select("item", "told_at"), "item").where(F.col("at") > F.col("told_at"))
    return told.join(after.groupBy("item").agg(F.max("price").alias("peak")), "item", "left")


def is_news(price: Column, told: Column, told_at: Column, peak: Column, now: datetime, days: int = 30) -> Column:
    """Worth telling (again): never told, long ago, a new low, or back down after having been dearer."""
    old = (told_at <= instant(now) - F.make_dt_interval(days=F.lit(days))) if days > 0 else F.lit(False)
    rebound = F.coalesce((peak > told + HALF_CENT) & (price <= told + HALF_CENT), F.lit(False))
    return F.coalesce(told.isNull() | old | (price < told - HALF_CENT) | rebound, F.lit(True))


#: The order in which kinds of watch news are shown.
NEWS = ["SOLD", "GONE", "BACK", "TARGET", "CHEAPER", "DEARER"]


def watch_news(since: Column) -> Column:
    """What to tell of a watched row: target, price, previous_price, sold, active, last_seen, price_changed_at, restocked_at."""
    changed = F.coalesce(F.col("price_changed_at") > since, F.lit(False))
    aimed = F.col("target").isNotNull()
    return (
        F.when(F.col("sold"), F.when(F.coalesce("price_changed_at", "last_seen") > since, "SOLD"))
        .when(~F.col("active"), "GONE")
        .when(F.coalesce(F.col("restocked_at") > since, F.lit(False)), "BACK")
        .when(changed & aimed, F.when(F.col("price") <= F.col("target"), "TARGET"))
        .when(changed & (F.col("price") < F.col("previous_price")), "CHEAPER")
        .when(changed & (F.col("price") > F.col("previous_price")), "DEARER")
    )


def digest(listings: DataFrame, since: datetime, per_source: int = 5) -> DataFrame:
    """The newest available arrivals of each source since a moment, capped for each source."""
    fresh = listings.where((F.col("first_seen") > instant(since)) & F.col("active") & ~F.col("sold"))
    newest = Window.partitionBy("source").orderBy(F.desc("first_seen"), "item")
    return fresh.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= per_source)


def episodes(runs: DataFrame, key: str = "source", order: tuple[str, ...] = ("at", "seq")) -> DataFrame:
    """Runs of failures of each source: when each began and ended (null if it goes on), and how many runs failed."""
    own = Window.partitionBy(key).orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    healthy = F.sum((~F.col("failed")).cast("int")).over(upto)
    marked = runs.withColumn("_block", healthy).withColumn("_next", F.lead("at").over(own))
    failed = marked.where("failed").groupBy(key, "_block")
    out = failed.agg(F.min("at").alias("began"), F.count("*").alias("failures"), F.max(F.struct(*order, F.col("_next"))).alias("last"))
    return out.select(key, "began", F.col("last._next").alias("ended"), "failures")


def cooldown(runs: DataFrame, first: float, most: float, key: str = "source", order: tuple[str, ...] = ("at", "seq")) -> DataFrame:
    """Refusals held against each source after its runs (one more for a refusal, one less, never under zero, for a success), and its wait.

    The count after a sequence of steps of +1 and -1 with a floor at zero is the running sum less its lowest value so far.
    """
    own = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("failed"), 1).otherwise(-1)
    level = runs.withColumn("_sum", F.sum(step).over(own)).withColumn("_low", F.least(F.lit(0), F.min("_sum").over(own)))
    last = level.groupBy(key).agg(F.max(F.struct(*order, (F.col("_sum") - F.col("_low")).alias("held"))).alias("x"))
    return last.select(key, F.col("x.held").cast("long").alias("held"), backoff(F.col("x.held"), first, most).alias("wait"))


def keep_newest(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The rows beyond the newest ``n`` of each group: what a pruning removes."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_k") > n).drop("_k")
