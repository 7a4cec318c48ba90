"""Market statistics over listings (``item, source, model, price, first_seen, sold, active, sold_at, delisted_at`` and facets)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import days_between, half_even, whole_days
from ..functions.ranks import linear_percentiles, nearest_ranks, spread
from ..written import cut

MIN_SAMPLE, CONCENTRATED = 5, 0.70
#: Ranks in a block that sources and prices meet by.
BLOCK = 64
SHELF = {"low": 0.10, "median": 0.50, "high": 0.90}
QUARTILES = {"low": 0.25, "median": 0.50, "high": 0.75}


def instant(moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def for_sale(listings: DataFrame) -> DataFrame:
    return listings.where(F.col("active") & ~F.col("sold") & F.col("price").isNotNull())


def bands(rows: DataFrame, dimension: str, fractions: dict[str, float] = SHELF, least: int = MIN_SAMPLE) -> DataFrame:
    """Price band of each value of a dimension: size, percentiles, number of sources, the largest source's share."""
    rows = rows.where(F.col(dimension).isNotNull() & (F.col(dimension).cast("string") != "") & F.col("price").isNotNull())
    counts = cut(rows.groupBy(dimension, "source", "price").agg(F.count("*").alias("_n")), "bands")  # one pass over the rows feeds both
    ranks = nearest_ranks(counts, [dimension], "price", fractions, "_n").where(F.col("n") >= least)
    shares = spread(counts, [dimension], "source", "_n")
    out = ranks.join(shares, dimension)
    return out.select(F.col(dimension).alias("value"), F.col("n").alias("listings"), *fractions, "sources", "top_share", (F.col("top_share") >= CONCENTRATED).alias("concentrated"))


def thin_groups(rows: DataFrame, dimension: str, least: int = MIN_SAMPLE) -> DataFrame:
    """What the bands leave out: one row with the rows considered, and the small groups and their rows."""
    sizes = rows.where(F.col(dimension).isNotNull() & (F.col(dimension).cast("string") != "")).groupBy(dimension).agg(F.count("*").alias("n"))
    small = F.col("n") < least
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("considered"), F.count_if(small).alias("thin_groups"), F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)).alias("thin_listings"))


def departed(listings: DataFrame) -> DataFrame:
    """Listings that left the shelf at a known price after being seen on it."""
    left = F.coalesce("sold_at", "delisted_at")
    return listings.where((F.col("price") > 0) & left.isNotNull() & (left > F.col("first_seen")))  # the second needs no join


def time_to_sell(listings: DataFrame, watching: DataFrame, dimension: str, least: int = MIN_SAMPLE) -> DataFrame:
    """Days on the shelf by value: quartiles (one digit), of listings that came after their source was first read.

    ``watching``: source, since. What leaves first counts, sold or taken down.
    """
    left = F.least("sold_at", "delisted_at")
    rows = listings.where(left.isNotNull()).join(watching, "source").where(F.col("first_seen") > F.col("since"))
    rows = cut(rows.select(dimension, "source", days_between(left, F.col("first_seen")).alias("days")).where("days > 0"), "days")  # read three times
    ranks = nearest_ranks(rows, [dimension], "days", {"fast_days": 0.25, "median_days": 0.5, "slow_days": 0.75}, split=True).where(F.col("n") >= least)
    out = ranks.join(spread(rows, [dimension], "source"), dimension)
    return out.select(F.col(dimension).alias("value"), F.col("n").alias("sold"), *[half_even(F.col(c), 1).alias(c) for c in ("fast_days", "median_days", "slow_days")], "sources", "top_share")


def floors(listings: DataFrame, watching: DataFrame) -> DataFrame:
    """How many departures have only a least duration, as they were there at the source's first reading."""
    gone = listings.where(F.coalesce("sold_at", "delisted_at").isNotNull()).join(watching, "source", "left")
    return gone.agg(F.count_if(F.coalesce(F.col("first_seen") <= F.col("since"), F.lit(True))).alias("floors"), F.count("*").alias("departures"))


def for_sale_at(moment: Column) -> Column:
    """Whether a listing was on the shelf at a moment: seen by then, and neither sold nor taken down."""
    came = F.col("first_seen") <= moment
    gone = F.coalesce(F.col("sold_at") <= moment, F.lit(False)) | F.coalesce(F.col("delisted_at") <= moment, F.lit(False))
    return came & ~gone & ~(F.col("sold") & F.col("sold_at").isNull())


def weekly_history(changes: DataFrame, group: Column, now: datetime, weeks: int = 26, least: int = MIN_SAMPLE) -> DataFrame:
    """Band of each group at the end of each week: an item's price is its last one up to then.

    Each change stands from its moment to the item's next one, so a change meets only the weeks that it covers: the
    number of rows made is items times weeks at most, and no week is joined with all changes.
    """
    ends = [now - timedelta(days=7 * k) for k in range(weeks - 1, -1, -1)]
    own = Window.partitionBy("item").orderBy("at", "seq")
    spans = changes.select("item", "price", group.alias("value"), "at", F.lead("at").over(own).alias("until"))
    week = F.array(*[instant(e) for e in ends])
    covered = F.filter(week, lambda w: (w >= F.col("at")) & (F.col("until").isNull() | (w < F.col("until"))))
    points = spans.select("item", "price", "value", F.explode(covered).alias("week"))
    ranks = nearest_ranks(points, ["value", "week"], "price", SHELF)
    return ranks.where(F.col("n") >= least).select("value", "week", F.col("n").alias("listings"), *SHELF)


def price_position(rows: DataFrame, group: list[str], least: int = 3) -> DataFrame:
    """Where each item's price lies among its peers: cheaper, dearer and equal ones, and its place from 0 to 100.

    Peers are counted by price before they meet (see :mod:`larkspur.functions.ranks`).
    """
    counts = rows.groupBy(*group, "price").agg(F.count("*").alias("ties"))
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("price").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.select(*group, "price", "ties", F.sum("ties").over(upto).alias("upto"), F.sum("ties").over(whole).alias("peers"))
    placed = placed.where(F.col("peers") >= least).withColumn("cheaper", F.col("upto") - F.col("ties")).withColumn("dearer", F.col("peers") - F.col("upto"))
    rank = F.col("cheaper") + (F.col("ties") - 1) / 2
    placed = placed.select(
        *group, "price", "peers", "cheaper", "dearer",
        half_even(100 * F.col("dearer") / F.col("peers")).cast("long").alias("cheaper_than"),
        F.when(F.col("peers") == 1, 50.0).otherwise(half_even(100 * rank / (F.col("peers") - 1), 1)).alias("position"),
    )
    return rows.join(placed, [*group, "price"])


def hot_deals(rows: DataFrame, group: list[str], cheaper_than: int = 80, low: float = 20.0, high: float = 65.0, vendors: int = 2) -> DataFrame:
    """Available items well under their peers' median, at least two sources among the peers; equal offers collapsed.

    Sold items are peers and never deals. Of the same offers (group, source, price) the first item stays with their number.
    """
    placed = price_position(rows, group)
    medians = linear_percentiles(rows, group, "price", {"median": 0.5}).drop("n")
    shops = rows.select(*group, "source").distinct().groupBy(*group).agg(F.count("*").alias("vendors"))
    found = placed.where(F.col("cheaper_than") >= cheaper_than).join(medians, group).join(shops, group)
    found = found.withColumn("discount", 100 * (F.col("median") - F.col("price")) / F.col("median"))
    found = found.where(~F.col("sold") & F.col("discount").between(low, high) & (F.col("vendors") >= vendors))
    offers = found.groupBy(*group, "source", "price").agg(F.min("item").alias("item"), F.count("*").alias("offers"), F.max("cheaper_than").alias("cheaper_than"), F.max("discount").alias("discount"), F.max("vendors").alias("vendors"), F.max("median").alias("median"))
    return offers


def others_median(listings: DataFrame, least: int = 5) -> DataFrame:
    """``source, model, price, median``: each item on the shelf with the median of the model's other sources (two or more sources, enough rows).

    The two middle ranks of the others lie among the ranks of all rows from the lower one to the higher one plus the
    source's own rows. So a source meets only the prices within its own number of rows of the middle: all sources of a
    model together meet about as many prices as the model has rows, and no source meets all prices. Ranks are cut into
    blocks of BLOCK for that, which join by equality.
    """
    shelf = for_sale(listings).where(F.col("price") > 0)
    medians = medians_of_others(shelf_counts(shelf), least)
    return shelf.join(medians, ["model", "source"]).select("source", "model", "item", "price", "median")


def shelf_counts(shelf: DataFrame) -> DataFrame:
    """``model, source, price, c``: rows of each price; a written table, as much is made of it."""
    return cut(shelf.groupBy("model", "source", "price").agg(F.count("*").alias("c")), "counts")


def medians_of_others(counts: DataFrame, least: int = 5) -> DataFrame:
    """``model, source, median`` of what :func:`others_median` tells, by the counts of prices (``model, source, price, c``)."""
    prices = counts.groupBy("model", "price").agg(F.sum("c").alias("all"))
    upto = Window.partitionBy("model").orderBy("price").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prices = prices.select("model", "price", "all", F.sum("all").over(upto).alias("upto"))
    totals = counts.groupBy("model").agg(F.sum("c").alias("n"))
    own = counts.groupBy("model", "source").agg(F.sum("c").alias("own")).join(totals, "model")
    m = F.col("n") - F.col("own")
    own = own.where(m >= least).select("model", "source", F.floor((m - 1) / 2).alias("first"), F.floor(m / 2).alias("second"), "own")
    blocks = lambda low, high: F.explode(F.sequence(F.floor(low / BLOCK), F.floor(high / BLOCK))).alias("block")
    asked = own.select("model", "source", "first", "second", "own", blocks(F.col("first"), F.col("second") + F.col("own")))
    offered = prices.select("model", "price", "all", "upto", blocks(F.col("upto") - F.col("all"), F.col("upto") - 1))
    met = asked.join(offered, ["model", "block"]).where((F.col("upto") > F.col("first")) & (F.col("upto") - F.col("all") <= F.col("second") + F.col("own")))
    # a price may be met in several blocks; the source's own rows at and below it are taken away
    none = F.lit(None).cast("long")
    both = met.select("model", "source", "price", "all", "upto", "first", "second", F.lit(0).cast("long").alias("c")).unionByName(counts.select("model", "source", "price", none.alias("all"), none.alias("upto"), none.alias("first"), none.alias("second"), "c"))
    cells = both.groupBy("model", "source", "price").agg(F.max("all").alias("all"), F.max("upto").alias("upto"), F.max("first").alias("first"), F.max("second").alias("second"), F.sum("c").alias("c"))
    below = Window.partitionBy("model", "source").orderBy("price").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumns({"end": F.col("upto") - F.sum("c").over(below), "rest": F.col("all") - F.col("c")}).where("upto is not null")
    at = lambda i: F.max(F.when((F.col("end") > F.col(i)) & (F.col("end") - F.col("rest") <= F.col(i)), F.col("price")))
    return cells.groupBy("model", "source").agg(((at("first") + at("second")) / 2).alias("median"))


def scorecards(listings: DataFrame, watching: DataFrame, now: datetime, compared: int = 5) -> DataFrame:
    """A row for each source: items for sale, prices against others' medians, days to sell, arrivals and departures.

    ``listings`` is read by all parts of it, so it should be a written table.
    """
    at = instant(now)
    rows = listings.join(watching, "source", "left")
    seen = F.coalesce(F.col("first_seen") > F.col("since"), F.lit(False))
    age, left = whole_days(at, F.col("first_seen")), F.least("sold_at", "delisted_at")
    weekdays = [F.count_if(seen & (age >= 0) & (age < 28) & (F.weekday("first_seen") == d)).alias(f"arrivals_{d}") for d in range(7)]
    counts = rows.groupBy("source").agg(
        F.count_if(F.col("active") & ~F.col("sold")).alias("for_sale"),
        F.count_if(seen & (age < 7)).alias("new_this_week"),
        F.count_if(whole_days(at, left) < 30).alias("left_last_30_days"),
        *weekdays,
    )
    stays = rows.where(seen & (left > F.col("first_seen"))).select("source", days_between(left, F.col("first_seen")).alias("days"))
    stays = linear_percentiles(stays, ["source"], "days", {"_days": 0.5}, split=True).drop("n")
    prices = shelf_counts(for_sale(listings).where(F.col("price") > 0))
    prices = prices.join(medians_of_others(prices), ["model", "source"])
    prices = cut(prices.groupBy("source", (F.col("price") / F.col("median")).alias("ratio")).agg(F.sum("c").alias("c")), "ratios")
    ratios = linear_percentiles(prices, ["source"], "ratio", {"_ratio": 0.5}, "c", split=True).where(F.col("n") >= compared)
    out = counts.join(stays, "source", "left").join(ratios, "source", "left")
    return out.select("source", "for_sale", "new_this_week", "left_last_30_days", half_even(F.col("_days"), 1).alias("sell_days"), *[f"arrivals_{d}" for d in range(7)], F.col("n").alias("compared"), half_even(F.col("_ratio"), 3).alias("price_vs_market"))


def first_drops(changes: DataFrame) -> DataFrame:
    """``item, at, was, price``: the first cut of each item's price."""
    order = Window.partitionBy("item").orderBy("at", "seq")
    steps = changes.select("item", "at", "seq", "price", F.lag("price").over(order).alias("was"))
    cuts = steps.where((F.col("price") < F.col("was")) & (F.col("was") > 0))
    return cuts.groupBy("item").agg(F.min(F.struct("at", "seq", "was", "price")).alias("x")).select("item", "x.at", "x.was", "x.price")


def cut_habit(changes: DataFrame, seen: DataFrame, now: datetime, least: int = 10) -> DataFrame:
    """By source: number of first cuts, median day and size of them, and their share of the items old enough.

    ``seen``: item, source, first_seen.
    """
    cuts = first_drops(changes).join(seen, "item").where(F.col("at") > F.col("first_seen"))
    cuts = cuts.select("source", days_between(F.col("at"), F.col("first_seen")).alias("days"), ((F.col("was") - F.col("price")) / F.col("was") * 100).alias("pct"))
    days = linear_percentiles(cuts, ["source"], "days", {"_day": 0.5}, split=True)
    sizes = linear_percentiles(cuts, ["source"], "pct", {"_pct": 0.5}, split=True).drop("n")
    habits = days.withColumnRenamed("n", "drops").join(sizes, "source").where(F.col("drops") >= least)
    old = seen.join(habits, "source").where(whole_days(instant(now), F.col("first_seen")) >= F.col("_day")).groupBy("source").agg(F.count("*").alias("_old"))
    out = habits.join(old, "source", "left")
    share = F.when(F.col("_old") > 0, half_even(F.least(F.lit(1.0), F.col("drops") / F.col("_old")), 3)).otherwise(0.0)
    return out.select("source", "drops", half_even(F.col("_day"), 1).alias("median_day"), half_even(F.col("_pct"), 1).alias("median_pct"), share.alias("share"))


def window_counts(listings: DataFrame, sources: DataFrame, since: datetime, until: datetime) -> DataFrame:
    """What each source did in the window ``(since, until]``: arrivals, sales, departures; silent sources too."""
    a, b = instant(since), instant(until)
    within = lambda c: (F.col(c) > a) & (F.col(c) <= b)
    counts = listings.groupBy("source").agg(F.count_if(within("first_seen")).alias("added"), F.count_if(within("sold_at")).alias("sold"), F.count_if(within("delisted_at")).alias("gone"), F.count_if(F.col("active") & ~F.col("sold")).alias("active"))
    out = sources.select("source").join(counts, "source", "left").na.fill(0, ["added", "sold", "gone", "active"])
    return out.withColumn("silent", (F.col("added") == 0) & (F.col("sold") == 0) & (F.col("gone") == 0))


def biggest_drops(changes: DataFrame, since: datetime, until: datetime, least: float = 5.0, top: int = 8) -> DataFrame:
    """The largest price cuts in the window by an item's last change in it."""
    order = Window.partitionBy("item").orderBy("at", "seq")
    steps = changes.select("item", "at", "seq", "price", F.lag("price").over(order).alias("was"))
    inside = steps.where((F.col("at") > instant(since)) & (F.col("at") <= instant(until)))
    last = inside.groupBy("item").agg(F.max(F.struct("at", "seq", "was", "price")).alias("x")).select("item", "x.was", "x.price")
    drops = last.select("item", "was", "price", (F.col("was") - F.col("price")).alias("drop")).where(F.col("drop") >= least)
    return drops.orderBy(F.desc("drop"), "item").limit(top)


def new_values(rows: DataFrame, dimension: str, since: datetime, until: datetime, top: int = 12) -> DataFrame:
    """Values of a dimension whose first row ever is in the window, newest first."""
    first = rows.groupBy(F.col(dimension).alias("value")).agg(F.min("first_seen").alias("first_seen"), F.count("*").alias("listings"))
    return first.where((F.col("first_seen") > instant(since)) & (F.col("first_seen") <= instant(until))).orderBy(F.desc("first_seen"), "value").limit(top)


def moves(listings: DataFrame, dimension: str, since: datetime, now: datetime, least: int = 8) -> DataFrame:
    """Medians then and now, where both have enough rows; and how each value moved.

    A steady value (half to twice as many rows) is cheaper or dearer from 5 % on; one with a fifth fewer rows is scarcer.
    """
    then = nearest_ranks(listings.where(for_sale_at(instant(since))), [dimension], "price", {"then_median": 0.5}).withColumnRenamed("n", "then_n")
    today = nearest_ranks(for_sale(listings).where((F.col("price") > 0) & (F.col("first_seen") <= instant(now))), [dimension], "price", {"now_median": 0.5}).withColumnRenamed("n", "now_n")
    out = then.join(today, dimension).where((F.col("then_n") >= least) & (F.col("now_n") >= least))
    change = (F.col("now_median") - F.col("then_median")) / F.col("then_median") * 100
    ratio = F.col("now_n") / F.col("then_n")
    steady = ratio.between(0.5, 2.0)
    kind = F.when(steady & (change <= -5), "cheaper").when(steady & (change >= 5), "dearer").when(ratio <= 0.8, "scarcer").otherwise("same")
    return out.select(F.col(dimension).alias("value"), "then_n", "now_n", "then_median", "now_median", half_even(change, 1).alias("change"), kind.alias("move"))


def monthly_report(listings: DataFrame, watching: DataFrame, dimension: str, since: datetime, now: datetime, each: int = 5) -> DataFrame:
    """``part, place, value, figure``: the values that moved most since a moment, and those that sell fastest, ``each`` of a kind.

    Cheaper and dearer ones by the change in percent, scarcer ones by what is left of their number in percent, the
    fastest by their median days on the shelf; the value decides between equals. Only these heads are sorted.
    """
    moved = moves(listings, dimension, since, now)
    left = half_even(100 * F.col("now_n") / F.col("then_n"), 1)
    lines = moved.where("move <> 'same'").select(F.col("move").alias("part"), F.col("value").cast("string").alias("value"), F.when(F.col("move") == "scarcer", left).otherwise(F.col("change")).alias("figure"))
    fast = time_to_sell(listings, watching, dimension).select(F.lit("fastest").alias("part"), F.col("value").cast("string").alias("value"), F.col("median_days").alias("figure"))
    first = Window.partitionBy("part").orderBy(F.when(F.col("part") == "dearer", -F.col("figure")).otherwise(F.col("figure")), "value")
    return lines.union(fast).withColumn("place", F.row_number().over(first)).where(F.col("place") <= each).select("part", "place", "value", "figure")


def similar(queries: DataFrame, listings: DataFrame, limit: int = 8, reserve: int = 2) -> DataFrame:
    """Items like each query item: the same model and kind, the model alone, the kind and country, the kind alone.

    The cheapest rows of each group are found once, before any query meets them: a few for each (kind, model, country), of
    these for each (model, kind), and twice as many for each (kind, country), so that enough are left when the query's own
    model is taken out. Of these, five times as many for each kind, with twice as many for each model, are enough when the
    query's own country is taken out as well. A query meets the two short lists as arrays, and only what it takes of them
    becomes rows. The closest band leaves up to ``reserve`` places to wider ones that have rows.
    """
    q = queries.select(F.col("item").alias("query"), *[F.col(c).alias(f"q_{c}") for c in ("model", "kind", "country")])
    pool = listings.where(F.col("active") & ~F.col("sold")).select("item", "model", "kind", "country", "price")
    few = limit + reserve + 1  # the query itself may be among them

    def cheapest(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.col("price").asc_nulls_last(), "item")
        return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")

    capped = cheapest(pool, ["kind", "model", "country"], few)
    by_model = cheapest(capped, ["model", "kind"], few)
    by_place = cheapest(capped, ["kind", "country"], 2 * few)
    own = by_model.join(q, F.col("model") == F.col("q_model")).withColumn("rung", F.when(F.col("kind").eqNullSafe(F.col("q_kind")), 1).otherwise(2))
    by_kind = cheapest(cheapest(by_place, ["kind", "model"], 2 * few), ["kind"], 5 * few)

    def listed(rows: DataFrame, *keys: str) -> DataFrame:
        entry = F.struct(F.col("price").isNull().alias("none"), "price", "item", "model", "country")
        return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sort_array(F.collect_list(entry)).alias("near"))

    apart = lambda x: F.col("q_model").isNull() | ~x["model"].eqNullSafe(F.col("q_model"))
    abroad = lambda x: ~F.coalesce(x["country"] == F.col("q_country"), F.lit(False))
    taken = lambda fits, rung: F.transform(F.slice(F.filter("near", fits), 1, few), lambda x: F.struct(x["item"].alias("item"), F.lit(rung).alias("rung"), x["price"].alias("price")))
    same = q.join(listed(by_place, "kind", "country"), (F.col("_kind") == F.col("q_kind")) & (F.col("_country") == F.col("q_country"))).select("query", F.inline(taken(apart, 3)))
    other = q.join(listed(by_kind, "kind"), F.col("_kind") == F.col("q_kind")).select("query", F.inline(taken(lambda x: apart(x) & abroad(x), 4)))
    rows = own.select("query", "item", "rung", "price").union(same.select("query", "item", "rung", "price")).union(other.select("query", "item", "rung", "price")).where("item != query")
    order = Window.partitionBy("query", "rung").orderBy(F.col("price").asc_nulls_last(), "item")
    rows = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit + reserve)
    whole = Window.partitionBy("query")
    rows = rows.withColumn("first", F.min("rung").over(whole))
    wider = F.sum((F.col("rung") > F.col("first")).cast("int")).over(whole)
    late = ((F.col("rung") == F.col("first")) & (F.col("k") > F.lit(limit) - F.least(F.lit(reserve), F.col("wider")))).cast("int")
    place = F.row_number().over(whole.orderBy("late", "rung", "k"))
    return rows.withColumn("wider", wider).withColumn("late", late).withColumn("place", place).where(F.col("place") <= limit).select("query", "place", "item", "rung", "price")


def valuation(listings: DataFrame, dimension: str = "model", least: int = MIN_SAMPLE) -> DataFrame:
    """What each model goes for by grade: departures before the shelf, the grade before the whole model."""
    gone, shelf = departed(listings), for_sale(listings).where("price > 0")

    def medians(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        ranks = nearest_ranks(rows, keys, "price", QUARTILES).where(F.col("n") >= least)
        return ranks.select(*keys, F.struct(F.lit(name).alias("basis"), "n", *QUARTILES).alias(name))

    wanted = listings.select(dimension, "grade").distinct()
    by = [medians(gone, [dimension, "grade"], "departed_grade"), medians(shelf, [dimension, "grade"], "shelf_grade"), medians(gone, [dimension], "departed_all"), medians(shelf, [dimension], "shelf_all")]
    for frame in by:
        wanted = wanted.join(frame, [c for c in (dimension, "grade") if c in frame.columns], "left")
    best = F.coalesce("departed_grade", "shelf_grade", "departed_all", "shelf_all")
    return wanted.select(dimension, "grade", best.alias("b")).where("b is not null").select(dimension, "grade", "b.*")
