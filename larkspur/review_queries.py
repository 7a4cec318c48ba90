"""Reviews, digests, alerts, deals and states as queries over the star-schema tables, each with the SQL that checks it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import columns as C
from .functions.ranks import linear_percentiles
from .operators import collection, market, matching, reference, review
from .plans import filters, orders
from .plans.filters import FilterSpec
from .queries import EVENTS_NOW, NOW, ORACLES, POSITION_SQL, nearest, query, watching
from .reading_queries import case_rows
from .sources.tables import CHANGES_SQL, LISTINGS_SQL, listings, price_changes, table

# -------------------------------------------------------------------------------------------------------- browsing

_BROWSE = "kind=PROMO&kind=ECONOMY&status=available&min_price=1000&sort=price_desc"
_WHERE = {"kind": "kind IN ('PROMO', 'ECONOMY')", "brand": "true"}
_REST = "active AND NOT sold AND price >= 1000"


@query(f"""WITH {LISTINGS_SQL}, m AS (SELECT * FROM listings WHERE {_REST} AND {_WHERE['kind']}),
  p AS (SELECT item, row_number() OVER (ORDER BY price DESC, item) AS k FROM m),
  h AS (SELECT min(price) AS lo, max(price) AS hi FROM m), e AS (SELECT i, CASE WHEN i = 0 THEN lo WHEN i = 24 THEN hi ELSE lo * exp(ln(hi / lo) / 24 * i) END AS edge FROM h, range(25) t(i)),
  b AS (SELECT a.i, a.edge AS lo, z.edge AS hi FROM e a JOIN e z ON z.i = a.i + 1)
  SELECT 'total' AS part, 'rows' AS value, count(*) AS n FROM m UNION ALL SELECT 'total', 'pages', ceil(count(*) / 50.0)::BIGINT FROM m
  UNION ALL SELECT 'page', item, k - 50 FROM p WHERE k > 50 AND k <= 100
  UNION ALL SELECT 'kind', kind, count(*) FROM listings WHERE {_REST} GROUP BY kind UNION ALL SELECT 'brand', brand, count(*) FROM m GROUP BY brand
  UNION ALL SELECT 'price', i::VARCHAR, count(*) FROM m JOIN b ON price >= b.lo AND (price < b.hi OR i = 23) GROUP BY i""")
def browse_answer(spark, folder):
    return filters.answer(listings(spark, folder, "item", "kind", "brand", "price", "sold", "active"), FilterSpec.from_query_string(_BROWSE), 2, ["kind", "brand"])


@query(f"WITH {LISTINGS_SQL} SELECT item FROM listings WHERE first_seen >= TIMESTAMP '2000-01-01' - INTERVAL 8760 HOUR")
def recent_listings(spark, folder):
    spec = FilterSpec.from_query_string("hours=8760")
    return listings(spark, folder, "item", "first_seen").where(spec.predicate(market.instant(NOW))).select("item")


@query("SELECT p_partkey, 'kind=A&kind=B+b&max_price=9&min_price=1.5&q=red+ring&status=sold' AS canonical FROM part")
def canonical_searches(spark, folder):
    """The same search written in any order has one canonical form."""
    written = ["q=red+ring&kind=B+b&kind=A&min_price=1.50&max_price=9&status=sold&page=3", "?max_price=9.0&status=sold&kind=A&q=red+ring&per_page=20&min_price=1.5&kind=B+b"]
    rows = case_rows(table(spark, folder, "part"), "written string", [(w,) for w in written])
    forms = {w: FilterSpec.from_query_string(w).to_query_string() for w in written}
    return rows.select("p_partkey", F.element_at(F.create_map(*[F.lit(x) for kv in forms.items() for x in kv]), F.col("written")).alias("canonical"))


@query("SELECT o_orderpriority AS grade, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END AS place, count(*) AS n FROM orders GROUP BY 1")
def enumerated_order(spark, folder):
    place = orders.by_list(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM"])
    return table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("grade"), place.alias("place")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), t AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1),
  g AS (SELECT 'brand' AS facet, p_brand AS value, n FROM c UNION ALL SELECT 'type', p_type, n FROM t), l AS (SELECT (count(*) * 0.15)::BIGINT AS most FROM part),
  w AS (SELECT facet, max(n) <= any_value(most) AS fits, sum(n) AS covered, count(*) AS parts FROM g, l GROUP BY 1), b AS (SELECT facet FROM w WHERE fits ORDER BY covered DESC, parts, facet LIMIT 1)
  SELECT facet, value FROM g JOIN b USING (facet)""")
def facet_cover_plan(spark, folder):
    part = table(spark, folder, "part")
    facets = [part.groupBy(F.lit(name).alias("facet"), F.col(c).alias("value")).agg(F.count("*").alias("n")) for name, c in (("brand", "p_brand"), ("type", "p_type"))]
    return orders.cover(facets[0].union(facets[1]), round(part.count() * 0.15)).select("facet", "value")


@query(f"WITH {CHANGES_SQL}, s AS (SELECT *, lag(price) OVER (PARTITION BY item ORDER BY at, seq) AS was FROM changes) SELECT item, seq FROM s WHERE round_even(price * 100, 0) < round_even(was * 100, 0)")
def price_drop_filter(spark, folder):
    rows = price_changes(spark, folder).withColumn("was", F.lag("price").over(Window.partitionBy("item").orderBy("at", "seq")))
    return rows.where(review.price_dropped(F.col("price"), F.col("was"))).select("item", "seq")


@query("SELECT count(*) AS n, max(event_id) AS last_key, max(ts) AS last_change FROM events")
def freshness_stamp(spark, folder):
    return review.freshness(table(spark, folder, "events"), "event_id", F.col("ts"))


@query("SELECT p_brand, count(*) AS n, quantile_cont(p_retailprice, 0.1) AS low, median(p_retailprice) AS median, quantile_cont(p_retailprice, 0.9) AS high FROM part GROUP BY 1".replace("quantile_cont(p_retailprice, 0.1)", "round(quantile_cont(p_retailprice, 0.1), 6)").replace("quantile_cont(p_retailprice, 0.9)", "round(quantile_cont(p_retailprice, 0.9), 6)"))
def linear_price_percentiles(spark, folder):
    out = linear_percentiles(table(spark, folder, "part"), ["p_brand"], "p_retailprice", {"low": 0.1, "median": 0.5, "high": 0.9})
    return out.withColumns({c: F.round(c, 6) for c in ("low", "high")})


# ----------------------------------------------------------------------------------------------------------- deals

_NEW = "WITH " + LISTINGS_SQL + """, v AS (SELECT p_partkey AS model, p_retailprice * 1.4 AS new_price FROM part WHERE p_partkey % 3 <> 0),
  u AS (SELECT item, model AS variant, price, new_price, first_seen, 100.0 * (new_price - price) / new_price AS under_new FROM listings JOIN v USING (model) WHERE active AND NOT sold AND price > 0 AND 100.0 * (new_price - price) / new_price BETWEEN 25 AND 65)"""


def _under_new(spark, folder):
    part = table(spark, folder, "part")
    variants = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("variant"), (F.col("p_retailprice") * 1.4).alias("new_price"))
    rows = listings(spark, folder, "item", "model", "price", "first_seen", "sold", "active").withColumnRenamed("model", "variant")
    return review.under_new(rows, variants)


@query(f"{_NEW} SELECT item, variant, price, new_price, round(under_new, 6) AS under_new FROM u")
def deals_under_new(spark, folder):
    return _under_new(spark, folder).select("item", "variant", "price", "new_price", F.round("under_new", 6).alias("under_new"))


_ALL = f"""WITH {LISTINGS_SQL}, {POSITION_SQL}, g AS (SELECT model, median(price) AS median, count(DISTINCT source) AS vendors FROM listings WHERE active AND price IS NOT NULL GROUP BY 1),
  d AS (SELECT p.*, g.median, vendors, 100 * (g.median - price) / g.median AS discount FROM p JOIN g USING (model)),
  h AS (SELECT min(item) AS item, price, max(median) AS median, max(discount) AS discount FROM d WHERE cheaper_than >= 80 AND NOT sold AND discount BETWEEN 20 AND 65 AND vendors >= 2 GROUP BY model, source, price),
  {_NEW.removeprefix("WITH " + LISTINGS_SQL + ", ")}, o AS (SELECT coalesce(h.item, u.item) AS item, coalesce(h.price, u.price) AS price, h.median, h.discount, u.new_price, u.under_new FROM h FULL JOIN u ON h.item = u.item),
  z AS (SELECT o.*, l.first_seen FROM o JOIN listings l USING (item))"""


def _all_deals(spark, folder):
    rows = listings(spark, folder, "item", "source", "model", "price", "sold", "active").where("active and price is not null")
    return review.all_deals(market.hot_deals(rows, ["model"]), _under_new(spark, folder))


@query(f"{_ALL} SELECT item, price, median, round(discount, 6) AS discount, new_price, round(under_new, 6) AS under_new FROM o")
def deals_by_both_rules(spark, folder):
    """Offers under their peers' median or under the new price, one row each with both signals."""
    return _all_deals(spark, folder).withColumns({"discount": F.round("discount", 6), "under_new": F.round("under_new", 6)})


@query(f"""{_ALL}, a AS (SELECT 'discount' AS ordering, item, row_number() OVER (ORDER BY coalesce(discount, under_new) DESC, item) AS place FROM z UNION ALL SELECT 'saving', item, row_number() OVER (ORDER BY coalesce(median, new_price) - price DESC, item) FROM z
    UNION ALL SELECT 'price_asc', item, row_number() OVER (ORDER BY price, item) FROM z UNION ALL SELECT 'price_desc', item, row_number() OVER (ORDER BY price DESC, item) FROM z UNION ALL SELECT 'newest', item, row_number() OVER (ORDER BY first_seen DESC, item) FROM z)
  SELECT ordering, item FROM a WHERE place <= 10""")
def deal_orders(spark, folder):
    deals = _all_deals(spark, folder).join(listings(spark, folder, "item", "first_seen"), "item")
    parts = [review.deals_in_order(deals, name, 10).select(F.lit(name).alias("ordering"), "item") for name in review.DEAL_ORDERS]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


# ------------------------------------------------------------------------------------------------ weeks and digests

_ITEMS_SQL = "items AS (SELECT item, item % 5 AS value, min(at) AS first_seen, CASE WHEN item % 3 = 0 THEN max(at) - INTERVAL 9 DAY END AS gone FROM changes GROUP BY item)"


@query(f"""WITH {CHANGES_SQL}, {_ITEMS_SQL}, w AS (SELECT TIMESTAMP '2024-01-29' - INTERVAL 7 DAY * k AS week FROM range(26) t(k)),
  p AS (SELECT week, value, c.item, arg_max(price, (at, seq)) AS price FROM changes c JOIN items i ON c.item = i.item JOIN w ON at <= week AND first_seen <= week AND (gone IS NULL OR week < gone) GROUP BY ALL)
  SELECT value, week, count(*) AS listings, {nearest("price", market.SHELF)} FROM p GROUP BY ALL HAVING count(*) >= 5""")
def weekly_shelf_history(spark, folder):
    changes = price_changes(spark, folder)
    item = F.col("item")
    items = changes.groupBy("item").agg(F.min("at").alias("first_seen"), F.max("at").alias("_last"))
    items = items.select("item", (item % 5).alias("value"), "first_seen", F.when(item % 3 == 0, F.col("_last") - F.make_dt_interval(days=F.lit(9))).alias("gone"))
    return review.weekly_shelf(changes, items, EVENTS_NOW)


_REVIEW_SQL = """l AS (SELECT user_id AS item, user_id % 20 AS source, min(ts) AS first_seen, CASE WHEN user_id % 4 = 0 THEN max(ts) END AS sold_at, CASE WHEN user_id % 6 = 1 THEN max(ts) END AS delisted_at FROM events GROUP BY 1, 2)"""


@query(f"""WITH {CHANGES_SQL}, {_REVIEW_SQL}, s AS (SELECT k AS source, k % 4 <> 0 AS enabled FROM range(30) t(k)),
  n AS (SELECT source, count(*) FILTER (first_seen > a AND first_seen <= b) AS added, count(*) FILTER (sold_at > a AND sold_at <= b) AS sold, count(*) FILTER (delisted_at > a AND delisted_at <= b) AS gone FROM l, (SELECT TIMESTAMP '2024-01-22' AS a, TIMESTAMP '2024-01-29' AS b) GROUP BY 1),
  c AS (SELECT *, lag(price) OVER (PARTITION BY item ORDER BY at, seq) AS was FROM changes), x AS (SELECT * FROM c WHERE at > TIMESTAMP '2024-01-22' AND at <= TIMESTAMP '2024-01-29' QUALIFY row_number() OVER (PARTITION BY item ORDER BY at DESC, seq DESC) = 1),
  r AS (SELECT item % 20 AS source, count(*) AS reduced, round_even(sum(CAST(was - price AS DECIMAL(18, 2)))::DOUBLE, 2) AS reduction FROM x WHERE was - price >= 5 GROUP BY 1),
  o AS (SELECT s.source, enabled, coalesce(added, 0) AS added, coalesce(sold, 0) AS sold, coalesce(gone, 0) AS gone, coalesce(reduced, 0) AS reduced, coalesce(reduction, 0.0) AS reduction FROM s LEFT JOIN n USING (source) LEFT JOIN r USING (source))
  SELECT *, added + sold + gone + reduced = 0 AS silent FROM o WHERE enabled OR added + sold + gone + reduced > 0""")
def week_in_review(spark, folder):
    changes = price_changes(spark, folder)
    item = F.col("item")
    rows = changes.groupBy("item").agg(F.min("at").alias("first_seen"), F.max("at").alias("_last")).withColumns({"source": item % 20, "sold_at": F.when(item % 4 == 0, F.col("_last")), "delisted_at": F.when(item % 6 == 1, F.col("_last"))})
    sources = spark.range(30).select(F.col("id").alias("source"), (F.col("id") % 4 != 0).alias("enabled"))
    return review.week_in_review(rows, changes.withColumn("source", item % 20), sources, datetime(2024, 1, 22), EVENTS_NOW)


@query(f"WITH {LISTINGS_SQL} SELECT item, price FROM listings WHERE first_seen > TIMESTAMP '1999-12-25' AND first_seen <= TIMESTAMP '2000-01-01' ORDER BY price DESC, item LIMIT 8")
def dearest_arrivals(spark, folder):
    return review.arrivals(listings(spark, folder, "item", "price", "first_seen"), datetime(1999, 12, 25), NOW).select("item", "price")


_PRICED_SQL = f"""WITH {CHANGES_SQL}, s AS (SELECT *, lag(price) OVER (PARTITION BY item ORDER BY at, seq) AS previous FROM changes),
  l AS (SELECT item, item % 20 AS source, price, previous, at AS changed_at, item % 9 <> 0 AS active, item % 11 = 0 AS sold FROM s QUALIFY row_number() OVER (PARTITION BY item ORDER BY at DESC, seq DESC) = 1)"""


def _priced(spark, folder):
    steps = price_changes(spark, folder).withColumn("previous", F.lag("price").over(Window.partitionBy("item").orderBy("at", "seq")))
    last = steps.groupBy("item").agg(F.max(F.struct("at", "seq", "price", "previous")).alias("x"))
    item = F.col("item")
    return last.select("item", (item % 20).alias("source"), "x.price", "x.previous", F.col("x.at").alias("changed_at"), (item % 9 != 0).alias("active"), (item % 11 == 0).alias("sold"))


@query(f"""{_PRICED_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY changed_at DESC, item)::INT AS place FROM l WHERE active AND NOT sold AND changed_at > TIMESTAMP '2024-01-20' AND round_even(price * 100, 0) < round_even(previous * 100, 0) AND previous - price >= 10)
  SELECT source, place, item FROM d WHERE place <= 3""")
def digest_price_drops(spark, folder):
    return review.digest_drops(_priced(spark, folder), datetime(2024, 1, 20), 10.0, 3).select("source", "place", "item")


@query(f"""{_PRICED_SQL}, w AS (SELECT *, CASE WHEN sold THEN 'sold' WHEN NOT active THEN 'gone' ELSE 'for_sale' END AS state, CASE item % 4 WHEN 0 THEN 'for_sale' WHEN 1 THEN 'sold' WHEN 2 THEN 'for_sale' END AS told FROM l)
  SELECT item, CASE WHEN told IS NULL THEN NULL WHEN state <> told THEN CASE state WHEN 'sold' THEN 'SOLD' WHEN 'gone' THEN 'GONE' ELSE 'BACK' END WHEN state = 'for_sale' THEN CASE WHEN price < 100 THEN 'CHEAPER' WHEN price > 100 THEN 'DEARER' END END AS news FROM w""")
def wishlist_alerts(spark, folder):
    rows = _priced(spark, folder).withColumn("state", F.when(F.col("sold"), "sold").when(~F.col("active"), "gone").otherwise("for_sale"))
    told = F.when(F.col("item") % 4 == 1, "sold").when(F.col("item") % 4 != 3, "for_sale")
    return rows.select("item", review.wish_alert(told, F.lit(100.0), F.col("state"), F.col("price")).alias("news"))


@query("""WITH s AS (SELECT user_id % 50 AS source, max(ts) FILTER (event_type <> 'error') AS last_success, CASE WHEN user_id % 50 % 3 = 0 THEN NULL ELSE (user_id % 50) * 60 END AS minutes FROM events GROUP BY 1, 3)
  SELECT source, coalesce(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_success) <= 1000000.0 * greatest(86400.0, 180.0 * coalesce(minutes, 0)), false) AS excused FROM s""")
def probe_grace(spark, folder):
    runs = price_changes(spark, folder).withColumn("source", F.col("item") % 50)
    last = runs.groupBy("source").agg(F.max(F.when(F.col("type") != "error", F.col("at"))).alias("last_success"))
    return last.select("source", review.excused(F.col("last_success"), F.when(F.col("source") % 3 != 0, F.col("source") * 60), datetime(2024, 2, 1)).alias("excused"))


@query("""WITH t AS (SELECT user_id AS item, arg_max(value, (ts, event_id)) AS last FROM events WHERE user_id % 5 <> 0 GROUP BY 1), p AS (SELECT user_id AS item, CASE WHEN user_id % 2 = 0 THEN arg_max(value, (ts, event_id)) ELSE max(value) + 1 END AS price FROM events GROUP BY user_id)
  SELECT p.item, TIMESTAMP '2024-02-01' AS at, price, 'watch' AS source FROM p LEFT JOIN t USING (item) WHERE last IS NULL OR round_even(price * 100, 0) <> round_even(last * 100, 0)""")
def watch_poll_history(spark, folder):
    changes = price_changes(spark, folder)
    last = changes.groupBy("item").agg(F.max_by("price", F.struct("at", "seq")).alias("last"), F.max("price").alias("most"))
    polled = last.select("item", market.instant(datetime(2024, 2, 1)).alias("at"), F.when(F.col("item") % 2 == 0, F.col("last")).otherwise(F.col("most") + 1).alias("price"))
    return review.watch_history(changes.where("item % 5 <> 0"), polled)


# ---------------------------------------------------------------------------------------------- states and backlogs

_REFERENCE_SQL = "r AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'pending' ELSE 'rejected' END AS status, p_size % 5 <> 0 AS enabled FROM part)"


def _reference(spark, folder):
    size = F.col("p_size")
    return table(spark, folder, "part").select("p_partkey", F.when(size % 3 == 0, "approved").when(size % 3 == 1, "pending").otherwise("rejected").alias("status"), (size % 5 != 0).alias("enabled"))


@query(f"WITH {_REFERENCE_SQL} SELECT status, enabled, count(*) AS n FROM r GROUP BY ALL")
def counts_by_state(spark, folder):
    return review.state_counts(_reference(spark, folder))


@query(f"WITH {_REFERENCE_SQL} SELECT 'even' AS name, count(*) FILTER (status = 'pending') AS n FROM r WHERE p_partkey % 2 = 0 UNION ALL SELECT 'odd', count(*) FILTER (status = 'pending') FROM r WHERE p_partkey % 2 = 1 UNION ALL SELECT 'none', 0")
def pending_by_table(spark, folder):
    rows = _reference(spark, folder)
    return review.pending({"even": rows.where("p_partkey % 2 = 0"), "odd": rows.where("p_partkey % 2 = 1"), "none": rows.where("p_partkey < 0")}, F.col("status") == "pending")


@query(f"WITH {_REFERENCE_SQL} SELECT 'everything' AS seen, p_partkey FROM r UNION ALL SELECT 'approved', p_partkey FROM r WHERE status = 'approved' AND enabled UNION ALL SELECT 'pending', p_partkey FROM r WHERE status = 'pending' UNION ALL SELECT 'disabled', p_partkey FROM r WHERE NOT enabled")
def status_views(spark, folder):
    rows = _reference(spark, folder)
    seen = F.array_compact(F.array(*[F.when(c(), F.lit(name)) for name, c in review.STATUS_VIEWS.items()]))
    return rows.select(F.explode(seen).alias("seen"), "p_partkey")


@query(f"""WITH {_REFERENCE_SQL}, a AS (SELECT *, CASE p_partkey % 5 WHEN 0 THEN 'promote' WHEN 1 THEN 'send_back' WHEN 2 THEN 'disable' WHEN 3 THEN 'enable' END AS action FROM r),
  n AS (SELECT p_partkey, status AS s, enabled AS e, CASE action WHEN 'promote' THEN 'approved' WHEN 'send_back' THEN 'pending' ELSE status END AS status, CASE WHEN action = 'disable' THEN false WHEN action IN ('enable', 'promote') THEN true ELSE enabled END AS enabled FROM a)
  SELECT p_partkey, status, enabled, s <> status OR e <> enabled AS changed FROM n""")
def status_transitions(spark, folder):
    rows = _reference(spark, folder)
    key = F.col("p_partkey") % 5
    action = F.when(key == 0, "promote").when(key == 1, "send_back").when(key == 2, "disable").when(key == 3, "enable")
    return review.transitions(rows, rows.select("p_partkey", action.alias("action")).where("action is not null"), "p_partkey")


@query("""WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN upper(replace(p_name, ' ', '-')) || (p_partkey % 100) ELSE p_name || ' ' || (p_partkey % 100) END AS name, p_size AS uses FROM part),
  b AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS plain FROM r), w AS (SELECT *, first_value(k) OVER (PARTITION BY plain ORDER BY uses DESC, k) AS winner FROM b)
  SELECT k AS loser, winner FROM w WHERE k <> winner""")
def tidy_plan(spark, folder):
    key = F.col("p_partkey")
    suffix = (key % 100).cast("string")
    name = F.when(key % 4 == 0, F.concat(F.upper(F.regexp_replace("p_name", " ", "-")), suffix)).otherwise(F.concat_ws(" ", "p_name", suffix))
    return review.tidy_plan(table(spark, folder, "part").select("p_partkey", name.alias("name"), F.col("p_size").alias("uses")), "p_partkey", "name")


@query("""WITH i AS (SELECT p_partkey AS item, p_brand AS source, p_partkey % 4 AS photos FROM part WHERE p_size % 4 <> 0)
  SELECT source, count(*) FILTER (photos > 0) AS waiting, count(*) FILTER (photos > 1) AS stored, count(*) FILTER (photos > 2) AS failed, count(*) FILTER (photos < 2) AS bare FROM i GROUP BY 1""")
def photo_backlog(spark, folder):
    items = table(spark, folder, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("source"), (F.col("p_size") % 4 != 0).alias("active"))
    states = F.array(F.lit("waiting"), F.lit("stored"), F.lit("failed"))
    return review.backlog(items.select("item", F.explode(F.slice(states, 1, (F.col("item") % 4).cast("int"))).alias("state")), items)


@query("""WITH b AS (SELECT DISTINCT l_orderkey AS model, l_suppkey % 7 AS maker FROM lineitem) SELECT model, min(maker) AS maker FROM b GROUP BY 1 HAVING count(*) = 1""")
def sole_makers(spark, folder):
    bridge = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("model"), (F.col("l_suppkey") % 7).alias("maker"))
    return review.sole_makers(bridge)


@query("""WITH e AS (SELECT p_brand AS model, p_partkey AS serial, 1900 + p_partkey // 40 + CASE WHEN p_size > 48 THEN -9 ELSE 0 END AS first FROM part), s AS (SELECT *, lag(first) OVER (PARTITION BY model ORDER BY serial, first) AS before FROM e),
  c AS (SELECT model, count(*) AS n, count(*) FILTER (first + 1 < before) AS backward FROM s GROUP BY 1) SELECT model, n, backward, n >= 8 AND backward <= 0.1 * (n - 1) AS straight FROM c""")
def serials_run_straight(spark, folder):
    first = (F.floor(F.col("p_partkey") / 40) + 1900 + F.when(F.col("p_size") > 48, -9).otherwise(0)).cast("long")
    evidence = table(spark, folder, "part").select(F.col("p_brand").alias("model"), F.col("p_partkey").alias("serial"), first.alias("first"), (first + 1).alias("last"))
    return review.runs_straight(evidence)


@query("SELECT DISTINCT source FROM (SELECT user_id % 40 AS source FROM events WHERE event_type = 'error' UNION ALL SELECT s_suppkey FROM supplier)")
def mentioned_sources(spark, folder):
    errors = table(spark, folder, "events").where("event_type = 'error'").select((F.col("user_id") % 40).alias("source"))
    return review.mentioned(errors, table(spark, folder, "supplier").select(F.col("s_suppkey").alias("source")))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 <> 0 AND p_size % 5 <> 0 THEN round_even((CASE WHEN p_size % 3 = 0 THEN 0.25 ELSE 0.1 END + p_size * 0.01 + 0.03 + 0.05)::DOUBLE, 4) END::DOUBLE AS cost FROM part""")
def reload_costs(spark, folder):
    size = F.col("p_size")
    weights = F.array(F.struct(F.lit(55.0).alias("grains"), F.lit(0.25).alias("cost")), F.struct(F.lit(150.0).alias("grains"), F.lit(0.0).alias("cost")))
    bullet = review.bullet_cost(weights, F.when(size % 3 == 0, 55.3).otherwise(150.0), F.lit(0.1))
    return table(spark, folder, "part").select("p_partkey", review.reload_cost(bullet, F.when(size % 7 != 0, size * 0.01), F.when(size % 5 != 0, F.lit(0.03)), F.lit(0.05)).alias("cost"))


@query("""WITH r AS (SELECT p_brand AS model, CASE WHEN p_size % 2 = 0 THEN 'm' END AS maker, p_partkey * 10 AS low, p_partkey * 10 + 25 AS high, 1900 + p_size AS year_from, 1900 + p_size + p_size % 3 AS year_to FROM part),
  p AS (SELECT c_custkey AS item, 'Brand#' || (c_custkey % 5 + 1) AS model, CASE WHEN c_custkey % 3 = 0 THEN 'm' ELSE 'x' END AS maker, c_custkey * 13 AS serial FROM customer),
  m AS (SELECT p.*, r.maker AS rm, year_from, year_to FROM p JOIN r ON p.model = r.model AND serial BETWEEN low AND high AND (r.maker IS NULL OR r.maker = p.maker)),
  b AS (SELECT * FROM m QUALIFY (rm IS NOT NULL) = max(rm IS NOT NULL) OVER (PARTITION BY item))
  SELECT item, min(year_from)::BIGINT AS first, max(year_to)::BIGINT AS last FROM b GROUP BY 1 HAVING max(year_to) - min(year_from) <= 2""")
def serial_dates(spark, folder):
    size, key, own = F.col("p_size").cast("long"), F.col("p_partkey"), F.col("c_custkey")
    ranges = table(spark, folder, "part").select(F.col("p_brand").alias("model"), F.when(size % 2 == 0, "m").alias("maker"), F.lit("").alias("prefix"), (key * 10).alias("low"), (key * 10 + 25).alias("high"), (size + 1900).alias("year_from"), (size + 1900 + size % 3).alias("year_to"))
    points = table(spark, folder, "customer").select(own.alias("item"), F.concat(F.lit("Brand#"), own % 5 + 1).alias("model"), F.when(own % 3 == 0, "m").otherwise("x").alias("maker"), F.lit("").alias("prefix"), (own * 13).alias("serial"))
    return review.dated_by_serial(points, ranges)


@query("""SELECT p_partkey, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_type END, CASE WHEN p_partkey % 3 = 0 THEN d.t END) AS kind, coalesce(CASE WHEN p_partkey % 5 <> 0 THEN p_size END, CASE WHEN p_partkey % 3 = 0 THEN d.s END) AS size,
   concat_ws(',', CASE WHEN p_partkey % 2 = 1 AND p_partkey % 3 = 0 AND d.t IS NOT NULL THEN 'kind' END, CASE WHEN p_partkey % 5 = 0 AND p_partkey % 3 = 0 AND d.s IS NOT NULL THEN 'size' END) AS filled
  FROM part LEFT JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS t, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS s FROM part) d ON d.k = p_partkey - 1""")
def gap_fill(spark, folder):
    key = F.col("p_partkey")
    rows = table(spark, folder, "part").select("p_partkey", F.when(key % 2 == 0, F.col("p_type")).alias("kind"), F.when(key % 5 != 0, F.col("p_size")).alias("size"))
    donors = rows.where("p_partkey % 3 = 0").select("p_partkey", (key - 1).alias("donor"))
    return review.filled(rows, donors, "p_partkey", ["kind", "size"]).withColumn("filled", F.array_join("filled", ","))


@query("SELECT p_brand, p_size AS size FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) = 1")
def usual_weights(spark, folder):
    return review.usual_weights(table(spark, folder, "part").select("p_brand", F.col("p_size").alias("size")), "p_brand", "size")


@query("""WITH e AS (SELECT n_nationkey AS entry, n_nationkey // 2 AS number, CASE WHEN n_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS word FROM nation), p AS (SELECT s_suppkey AS product, s_suppkey // 3 AS number, CASE WHEN s_suppkey % 3 = 0 THEN 'a' ELSE 'c' END AS word FROM supplier),
  o AS (SELECT number, word, min(entry) AS entry FROM e GROUP BY ALL HAVING count(*) = 1), x AS (SELECT product, o.entry FROM p JOIN o USING (number, word)), l AS (SELECT number, min(product) AS product FROM p WHERE product NOT IN (SELECT product FROM x) GROUP BY 1 HAVING count(*) = 1),
  s AS (SELECT number, min(entry) AS entry FROM e GROUP BY 1 HAVING count(*) = 1) SELECT product, entry, 'exact' AS how FROM x UNION ALL SELECT product, entry, 'number' FROM l JOIN s USING (number)""")
def product_dimension_match(spark, folder):
    n, s = F.col("n_nationkey"), F.col("s_suppkey")
    entries = table(spark, folder, "nation").select(n.alias("entry"), F.floor(n / 2).alias("number"), F.array(F.when(n % 2 == 0, "a").otherwise("b")).alias("words"))
    products = table(spark, folder, "supplier").select(s.alias("product"), F.floor(s / 3).alias("number"), F.array(F.when(s % 3 == 0, "a").otherwise("c"), F.when(s % 3 == 0, "a").otherwise("c")).alias("words"))
    return review.product_matches(products, entries)


@query("""SELECT p_brand, count(DISTINCT p_partkey) AS models, count(DISTINCT p_type) AS kinds, count(*) FILTER (l.n > 0) AS listed, coalesce(sum(l.n), 0)::BIGINT AS listings FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_partkey = p_partkey GROUP BY 1""")
def reference_tables(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return reference.usage(table(spark, folder, "part"), rows, "p_partkey", "p_brand", "p_type")


# --------------------------------------------------------------------------------------- time, evidence, spellings

@query("""SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS local FROM events""")
def reader_time_zone(spark, folder):
    return table(spark, folder, "events").select("event_id", C.in_zone(F.col("ts"), "America/New_York").alias("local"))


@query("""SELECT p_name AS alias, count(DISTINCT p_brand) AS claims FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1""")
def contested_spellings(spark, folder):
    return matching.contested(table(spark, folder, "part").select(F.col("p_name").alias("alias"), F.col("p_brand").alias("canonical")))


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS day, sum(round_even(value * 100, 0))::BIGINT AS total, count(value) AS n FROM events GROUP BY 1""")
def snapshot_series(spark, folder):
    rows = table(spark, folder, "events").select("ts", C.cents(F.col("value")).alias("cents"))
    return collection.series(rows, F.date_trunc("day", "ts").cast("timestamp_ntz"), "cents")


# ------------------------------------------------------------------------------------------------------- monthly report

@query(f"""WITH m AS ({ORACLES["monthly_moves"]}), t AS ({ORACLES["time_to_sell"]}),
  r AS (SELECT move AS part, value, CASE WHEN move = 'scarcer' THEN round_even(100 * now_n / then_n, 1) ELSE change END::DOUBLE AS figure FROM m WHERE move <> 'same' UNION ALL SELECT 'fastest', value, median_days::DOUBLE FROM t),
  p AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY CASE WHEN part = 'dearer' THEN -figure ELSE figure END, value)::INTEGER AS place FROM r) SELECT part, place, value, figure FROM p WHERE place <= 5""")
def monthly_report(spark, folder):
    """Five lines each of what got cheaper, dearer and scarcer, and of what sells fastest."""
    rows = listings(spark, folder)
    return market.monthly_report(rows, watching(rows), "brand", datetime(1997, 1, 1), NOW)
