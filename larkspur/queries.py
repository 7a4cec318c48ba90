"""The catalog's questions over the star-schema tables, each with the SQL that checks it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import columns as C
from .functions.ranks import nearest_ranks
from .operators import collection, market, matching, reference, state
from .plans import facets, orders
from .plans.filters import FilterSpec, page, search_with_dimension
from .sources import feeds
from .sources.tables import CHANGES_SQL, DOCS_SQL, LISTINGS_SQL, labelled_documents, listings, price_changes, table
from .written import cut
from .streaming import flows

#: The moment that the questions are asked at: results must not depend on the clock.
NOW = datetime(2000, 1, 1)
EVENTS_NOW = datetime(2024, 1, 29)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = re.sub(r"\bat\b", '"at"', sql)  # a keyword there, and a column here
        return f

    return add


def nearest(value: str, fractions: dict[str, float]) -> str:
    """Nearest-rank percentiles in the checking SQL."""
    return ", ".join(f"list_sort(list({value}))[CAST(round_even({f} * (count({value}) - 1), 0) AS BIGINT) + 1] AS {n}" for n, f in fractions.items())


SHELF = "active AND NOT sold AND price IS NOT NULL"


def bands_sql(dimension: str, where: str, fractions: dict[str, float]) -> str:
    return f"""WITH {LISTINGS_SQL}, r AS (SELECT * FROM listings WHERE {where}),
      b AS (SELECT {dimension} AS value, count(*) AS listings, {nearest("price", fractions)} FROM r GROUP BY 1 HAVING count(*) >= 5),
      s AS (SELECT value, count(*) AS sources, round_even(max(c) / sum(c), 3) AS top_share FROM (SELECT {dimension} AS value, source, count(*) AS c FROM r GROUP BY ALL) GROUP BY 1)
      SELECT b.*, sources, top_share, top_share >= 0.7 AS concentrated FROM b JOIN s USING (value)"""


@query(bands_sql("kind", SHELF, market.SHELF))
def market_bands(spark, folder):
    return market.bands(market.for_sale(listings(spark, folder, "source", "kind", "price", "sold", "active")), "kind")


@query(bands_sql("brand", SHELF, market.SHELF))
def market_bands_by_brand(spark, folder):
    return market.bands(market.for_sale(listings(spark, folder, "source", "brand", "price", "sold", "active")), "brand")


@query(bands_sql("model", SHELF, market.SHELF))
def market_bands_by_model(spark, folder):
    return market.bands(market.for_sale(listings(spark, folder, "source", "model", "price", "sold", "active")), "model")


@query(f"""WITH {LISTINGS_SQL}, s AS (SELECT model, count(*) AS n FROM listings WHERE {SHELF} GROUP BY 1)
  SELECT sum(n)::BIGINT AS considered, count(*) FILTER (n < 8) AS thin_groups, coalesce(sum(n) FILTER (n < 8), 0)::BIGINT AS thin_listings FROM s""")
def market_thin_groups(spark, folder):
    return market.thin_groups(market.for_sale(listings(spark, folder)), "model", 8)


DEPARTED = "price > 0 AND coalesce(sold_at, delisted_at) > first_seen"


@query(bands_sql("brand", DEPARTED, market.QUARTILES))
def departure_bands(spark, folder):
    return market.bands(market.departed(listings(spark, folder, "source", "brand", "price", "first_seen", "sold_at", "delisted_at")), "brand", market.QUARTILES)


WATCHING_SQL = "watching AS (SELECT source, min(first_seen) + INTERVAL 30 DAY AS since FROM listings GROUP BY 1)"
LEFT = "least(sold_at, delisted_at)"  # nulls are left out
DAYS = "(epoch_us({0}) - epoch_us({1})) / 86400000000.0"


def watching(rows: DataFrame) -> DataFrame:
    """When each source's first complete reading ended."""
    return rows.groupBy("source").agg((F.min("first_seen") + F.make_dt_interval(days=F.lit(30))).alias("since"))


@query(f"""WITH {LISTINGS_SQL}, {WATCHING_SQL},
  r AS (SELECT brand, source, {DAYS.format(LEFT, "first_seen")} AS days FROM listings JOIN watching USING (source) WHERE {LEFT} IS NOT NULL AND first_seen > since),
  d AS (SELECT * FROM r WHERE days > 0),
  b AS (SELECT brand, count(*) AS sold, {nearest("days", {"a": 0.25, "b": 0.5, "c": 0.75})} FROM d GROUP BY 1 HAVING count(*) >= 5),
  s AS (SELECT brand, count(*) AS sources, round_even(max(c) / sum(c), 3) AS top_share FROM (SELECT brand, source, count(*) AS c FROM d GROUP BY ALL) GROUP BY 1)
  SELECT brand AS value, sold, round_even(a, 1) AS fast_days, round_even(b, 1) AS median_days, round_even(c, 1) AS slow_days, sources, top_share FROM b JOIN s USING (brand)""")
def time_to_sell(spark, folder):
    rows = listings(spark, folder, "source", "brand", "first_seen", "sold_at", "delisted_at")
    return market.time_to_sell(rows, watching(rows), "brand")


@query(f"""WITH {LISTINGS_SQL}, {WATCHING_SQL} SELECT count(*) FILTER (first_seen <= since) AS floors, count(*) AS departures
  FROM listings JOIN watching USING (source) WHERE coalesce(sold_at, delisted_at) IS NOT NULL""")
def time_to_sell_floors(spark, folder):
    rows = listings(spark, folder)
    return market.floors(rows, watching(rows))


@query(f"""WITH {CHANGES_SQL}, w AS (SELECT TIMESTAMP '2024-01-29' - INTERVAL 7 DAY * k AS week FROM range(26) t(k)),
  p AS (SELECT week, item, arg_max(price, (at, seq)) AS price FROM changes JOIN w ON at <= week GROUP BY ALL)
  SELECT item % 5 AS value, week, count(*) AS listings, {nearest("price", market.SHELF)} FROM p GROUP BY ALL HAVING count(*) >= 5""")
def weekly_history(spark, folder):
    return market.weekly_history(price_changes(spark, folder), F.col("item") % 5, EVENTS_NOW)


POSITION_SQL = """c AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY price) - 1 AS cheaper, rank() OVER (PARTITION BY model ORDER BY price DESC) - 1 AS dearer,
    count(*) OVER (PARTITION BY model) AS peers, count(*) OVER (PARTITION BY model, price) AS ties FROM listings WHERE active AND price IS NOT NULL),
  p AS (SELECT *, round_even(100 * dearer / peers, 0)::BIGINT AS cheaper_than,
    CASE WHEN peers = 1 THEN 50.0 ELSE round_even(100 * (cheaper + (ties - 1) / 2) / (peers - 1), 1) END AS position FROM c WHERE peers >= 3)"""


@query(f"WITH {LISTINGS_SQL}, {POSITION_SQL} SELECT item, price, peers, cheaper, dearer, cheaper_than, position FROM p")
def price_position(spark, folder):
    rows = listings(spark, folder, "item", "model", "price", "active").where("active and price is not null")
    return market.price_position(rows, ["model"]).select("item", "price", "peers", "cheaper", "dearer", "cheaper_than", "position")


@query(f"""WITH {LISTINGS_SQL}, {POSITION_SQL},
  g AS (SELECT model, median(price) AS median, count(DISTINCT source) AS vendors FROM listings WHERE active AND price IS NOT NULL GROUP BY 1),
  d AS (SELECT p.*, median, vendors, 100 * (median - price) / median AS discount FROM p JOIN g USING (model))
  SELECT model, source, price, min(item) AS item, count(*) AS offers, max(cheaper_than) AS cheaper_than, round(max(discount), 6) AS discount, max(vendors) AS vendors, max(median) AS median
  FROM d WHERE cheaper_than >= 80 AND NOT sold AND discount BETWEEN 20 AND 65 AND vendors >= 2 GROUP BY 1, 2, 3""")
def hot_deals(spark, folder):
    rows = listings(spark, folder, "item", "source", "model", "price", "sold", "active").where("active and price is not null")
    return market.hot_deals(rows, ["model"]).withColumn("discount", F.round("discount", 6))


@query(f"""WITH {LISTINGS_SQL}, shelf AS (SELECT * FROM listings WHERE {SHELF} AND price > 0),
  m AS (SELECT a.model, a.source, median(b.price) AS median FROM (SELECT DISTINCT model, source FROM shelf) a JOIN shelf b ON a.model = b.model AND a.source <> b.source GROUP BY ALL HAVING count(*) >= 5)
  SELECT source, model, item, price, median FROM shelf JOIN m USING (model, source)""")
def others_median_ratio(spark, folder):
    return market.others_median(listings(spark, folder, "item", "source", "model", "price", "sold", "active"))


_ARRIVALS = ", ".join(f"count(*) FILTER (seen AND age >= 0 AND age < 28 AND isodow(first_seen) = {d + 1}) AS arrivals_{d}" for d in range(7))


@query(f"""WITH {LISTINGS_SQL}, {WATCHING_SQL}, shelf AS (SELECT * FROM listings WHERE {SHELF} AND price > 0),
  m AS (SELECT a.model, a.source, median(b.price) AS median FROM (SELECT DISTINCT model, source FROM shelf) a JOIN shelf b ON a.model = b.model AND a.source <> b.source GROUP BY ALL HAVING count(*) >= 5),
  q AS (SELECT source, count(*) AS compared, round_even(median(price / median), 3) AS price_vs_market FROM shelf JOIN m USING (model, source) GROUP BY 1 HAVING count(*) >= 5),
  x AS (SELECT *, coalesce(first_seen > since, false) AS seen, floor({DAYS.format("TIMESTAMP '2000-01-01'", "first_seen")}) AS age, {LEFT} AS gone FROM listings LEFT JOIN watching USING (source)),
  c AS (SELECT source, count(*) FILTER (active AND NOT sold) AS for_sale, count(*) FILTER (seen AND age < 7) AS new_this_week,
    count(*) FILTER (floor({DAYS.format("TIMESTAMP '2000-01-01'", "gone")}) < 30) AS left_last_30_days,
    round_even(median({DAYS.format("gone", "first_seen")}) FILTER (seen AND gone > first_seen), 1) AS sell_days, {_ARRIVALS} FROM x GROUP BY 1)
  SELECT c.*, compared, price_vs_market FROM c LEFT JOIN q USING (source)""")
def shop_scorecard(spark, folder):
    rows = cut(listings(spark, folder, "source", "model", "price", "first_seen", "sold", "active", "sold_at", "delisted_at"), "scorecards")
    return market.scorecards(rows, watching(rows), NOW)


FIRST_DROPS_SQL = """steps AS (SELECT *, lag(price) OVER (PARTITION BY item ORDER BY at, seq) AS was FROM changes),
  drops AS (SELECT * FROM steps WHERE price < was AND was > 0 QUALIFY row_number() OVER (PARTITION BY item ORDER BY at, seq) = 1)"""


@query(f"WITH {CHANGES_SQL}, {FIRST_DROPS_SQL} SELECT item, at, was, price FROM drops")
def first_price_drop(spark, folder):
    return market.first_drops(price_changes(spark, folder))


@query(f"""WITH {CHANGES_SQL}, {FIRST_DROPS_SQL}, seen AS (SELECT item, item % 7 AS source, min(at) AS first_seen FROM changes GROUP BY 1),
  c AS (SELECT source, {DAYS.format("at", "first_seen")} AS days, (was - price) / was * 100 AS pct FROM drops JOIN seen USING (item) WHERE at > first_seen),
  h AS (SELECT source, count(*) AS drops, median(days) AS day, median(pct) AS pct FROM c GROUP BY 1 HAVING count(*) >= 10),
  o AS (SELECT source, count(*) AS old FROM seen JOIN h USING (source) WHERE floor({DAYS.format("TIMESTAMP '2024-01-29'", "first_seen")}) >= day GROUP BY 1)
  SELECT source, drops, round_even(day, 1) AS median_day, round_even(pct, 1) AS median_pct, CASE WHEN old > 0 THEN round_even(least(1.0, drops / old), 3) ELSE 0.0 END AS share FROM h LEFT JOIN o USING (source)""")
def price_cut_habit(spark, folder):
    changes = price_changes(spark, folder)
    seen = changes.groupBy("item").agg(F.min("at").alias("first_seen")).withColumn("source", F.col("item") % 7)
    return market.cut_habit(changes, seen, EVENTS_NOW)


SINCE = datetime(1999, 12, 25)


@query(f"""WITH {LISTINGS_SQL}, c AS (SELECT source, count(*) FILTER (first_seen > a AND first_seen <= b) AS added, count(*) FILTER (sold_at > a AND sold_at <= b) AS sold,
  count(*) FILTER (delisted_at > a AND delisted_at <= b) AS gone, count(*) FILTER (active AND NOT sold) AS active FROM listings, (SELECT TIMESTAMP '1999-12-25' AS a, TIMESTAMP '2000-01-01' AS b) GROUP BY 1)
  SELECT s_suppkey AS source, coalesce(added, 0) AS added, coalesce(sold, 0) AS sold, coalesce(gone, 0) AS gone, coalesce(active, 0) AS active, coalesce(added, 0) + coalesce(sold, 0) + coalesce(gone, 0) = 0 AS silent
  FROM supplier LEFT JOIN c ON s_suppkey = source""")
def week_in_review_sources(spark, folder):
    sources = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("source"))
    return market.window_counts(listings(spark, folder), sources, SINCE, NOW)


@query(f"""WITH {CHANGES_SQL}, s AS (SELECT *, lag(price) OVER (PARTITION BY item ORDER BY at, seq) AS was FROM changes),
  l AS (SELECT * FROM s WHERE at > TIMESTAMP '2024-01-22' AND at <= TIMESTAMP '2024-01-29' QUALIFY row_number() OVER (PARTITION BY item ORDER BY at DESC, seq DESC) = 1)
  SELECT item, was, price, was - price AS drop FROM l WHERE was - price >= 5 ORDER BY drop DESC, item LIMIT 8""")
def biggest_drops(spark, folder):
    return market.biggest_drops(price_changes(spark, folder), datetime(2024, 1, 22), EVENTS_NOW)


@query(f"""WITH {LISTINGS_SQL} SELECT model AS value, min(first_seen) AS first_seen, count(*) AS listings FROM listings GROUP BY 1
  HAVING min(first_seen) > TIMESTAMP '1995-06-01' AND min(first_seen) <= TIMESTAMP '2000-01-01' ORDER BY 2 DESC, 1 LIMIT 12""")
def new_values_in_window(spark, folder):
    return market.new_values(listings(spark, folder), "model", datetime(1995, 6, 1), NOW)


@query(f"""WITH {LISTINGS_SQL}, t AS (SELECT brand, count(price) AS then_n, {nearest("price", {"then_median": 0.5})} FROM listings WHERE first_seen <= m AND NOT coalesce(sold_at <= m, false) AND NOT coalesce(delisted_at <= m, false) GROUP BY 1),
  n AS (SELECT brand, count(price) AS now_n, {nearest("price", {"now_median": 0.5})} FROM listings WHERE {SHELF} AND price > 0 AND first_seen <= TIMESTAMP '2000-01-01' GROUP BY 1)
  SELECT brand AS value, then_n, now_n, then_median, now_median, round_even((now_median - then_median) / then_median * 100, 1) AS change,
   CASE WHEN now_n / then_n BETWEEN 0.5 AND 2 AND (now_median - then_median) / then_median * 100 <= -5 THEN 'cheaper' WHEN now_n / then_n BETWEEN 0.5 AND 2 AND (now_median - then_median) / then_median * 100 >= 5 THEN 'dearer'
        WHEN now_n / then_n <= 0.8 THEN 'scarcer' ELSE 'same' END AS move FROM t JOIN n USING (brand) WHERE then_n >= 8 AND now_n >= 8""".replace("<= m", "<= TIMESTAMP '1997-01-01'"))
def monthly_moves(spark, folder):
    return market.moves(listings(spark, folder), "brand", datetime(1997, 1, 1), NOW)


@query(f"""WITH {LISTINGS_SQL}, pool AS (SELECT * FROM listings WHERE active AND NOT sold),
  q AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY source ORDER BY price, item) = 1),
  r AS (SELECT q.item AS query, p.item, p.price, CASE WHEN p.kind = q.kind THEN CASE WHEN p.model = q.model THEN 1 WHEN p.country = q.country THEN 3 ELSE 4 END ELSE 2 END AS rung
        FROM q JOIN pool p ON p.item <> q.item AND (p.kind = q.kind OR p.model = q.model)),
  k AS (SELECT *, row_number() OVER (PARTITION BY query, rung ORDER BY price, item) AS k FROM r QUALIFY k <= 10),
  f AS (SELECT *, min(rung) OVER (PARTITION BY query) AS first FROM k), w AS (SELECT *, sum((rung > first)::INT) OVER (PARTITION BY query) AS wider FROM f),
  o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY (rung = first AND k > 8 - least(2, wider))::INT, rung, k)::INT AS place FROM w)
  SELECT query, place, item, rung, price FROM o WHERE place <= 8""")
def similar_banded(spark, folder):
    rows = listings(spark, folder, "item", "source", "model", "kind", "country", "price", "sold", "active")
    cheapest = rows.where("active and not sold").groupBy("source").agg(F.min(F.struct("price", "item", "model", "kind", "country")).alias("x")).select("x.*")
    return market.similar(cheapest, rows)


def _value_sql(name: str, where: str, keys: str) -> str:
    return f"(SELECT {keys}, '{name}' AS basis, count(price) AS n, {nearest('price', market.QUARTILES)} FROM listings WHERE {where} GROUP BY {keys} HAVING count(price) >= 5)"


@query(f"""WITH {LISTINGS_SQL}, a AS {_value_sql("departed_grade", DEPARTED, "model, grade")}, b AS {_value_sql("shelf_grade", SHELF + " AND price > 0", "model, grade")},
  c AS {_value_sql("departed_all", DEPARTED, "model")}, d AS {_value_sql("shelf_all", SHELF + " AND price > 0", "model")},
  w AS (SELECT DISTINCT model, grade FROM listings)
  SELECT w.model, w.grade, {", ".join(f"coalesce(CASE WHEN a.n IS NOT NULL THEN a.{x} END, CASE WHEN b.n IS NOT NULL THEN b.{x} END, CASE WHEN c.n IS NOT NULL THEN c.{x} END, d.{x}) AS {x}" for x in ("basis", "n", "low", "median", "high"))}
  FROM w LEFT JOIN a ON w.model = a.model AND w.grade = a.grade LEFT JOIN b ON w.model = b.model AND w.grade = b.grade LEFT JOIN c ON w.model = c.model LEFT JOIN d ON w.model = d.model
  WHERE coalesce(a.n, b.n, c.n, d.n) IS NOT NULL""")
def valuation_fallback(spark, folder):
    return market.valuation(listings(spark, folder, "source", "model", "price", "first_seen", "sold", "active", "sold_at", "delisted_at", "grade"))


# ------------------------------------------------------------------------------------------ search and facets


@query(f"""WITH {DOCS_SQL} SELECT lang AS value, count(*) AS n FROM docs GROUP BY 1""")
def facet_tally(spark, folder):
    return facets.tally(labelled_documents(spark, folder), "lang")


@query(f"""WITH {DOCS_SQL} SELECT coalesce(quality::VARCHAR, 'Unknown') AS value, count(*) AS n FROM docs GROUP BY 1""")
def facet_unknown(spark, folder):
    return facets.tally(labelled_documents(spark, folder), "quality")


_FACETS = {"lang": "coalesce(lang IN ('en', 'de'), false)", "quality": "(quality IS NULL OR quality = 1)", "source": "source <> 'src0'"}
_EXCLUSIVE = " UNION ALL ".join(
    f"SELECT '{f}' AS facet, coalesce({f}::VARCHAR, 'Unknown') AS value, count(*) AS n FROM docs WHERE n_chars >= 500 AND {' AND '.join(c for g, c in _FACETS.items() if g != f)} GROUP BY ALL" for f in _FACETS
)


@query(f"WITH {DOCS_SQL} {_EXCLUSIVE}")
def facet_exclusive_multi(spark, folder):
    spec = FilterSpec.from_query_string("lang=en&lang=de&quality=Unknown&quality=1&not_source=src0&min_n_chars=500")
    return facets.exclusive(labelled_documents(spark, folder), spec.clauses(), list(_FACETS))


@query(f"WITH {DOCS_SQL} SELECT doc_id, quality FROM docs WHERE quality IS NULL OR quality <> 1")
def facet_exclusion_null_preserving(spark, folder):
    spec = FilterSpec.from_query_string("not_quality=1")
    return labelled_documents(spark, folder).where(spec.predicate()).select("doc_id", "quality")


@query(f"WITH {DOCS_SQL} SELECT doc_id FROM docs WHERE toxic = 0")
def tristate_filter(spark, folder):
    rows = labelled_documents(spark, folder)
    return rows.where(C.holds(F.col("toxic") == 0)).select("doc_id")


@query(f"""WITH {LISTINGS_SQL}, k AS (SELECT count(*) FILTER (active AND NOT sold) AS available, count(*) FILTER (sold) AS sold, count(*) FILTER (NOT active) AS delisted,
  count(*) FILTER (coalesce(sold_at, delisted_at) > first_seen) AS departed, count(*) FILTER (size >= 25) AS large FROM listings)
  SELECT name, n FROM k UNPIVOT (n FOR name IN (available, sold, delisted, departed, large))""")
def conditional_kind_counts(spark, folder):
    conditions = {"available": F.col("active") & ~F.col("sold"), "sold": F.col("sold"), "delisted": ~F.col("active"), "departed": F.coalesce("sold_at", "delisted_at") > F.col("first_seen"), "large": F.col("size") >= 25}
    return facets.conditional(listings(spark, folder), conditions)


@query(f"""WITH {LISTINGS_SQL}, p AS (SELECT price FROM listings WHERE price > 0), e AS (SELECT min(price) AS lo, max(price) AS hi FROM p),
  edges AS (SELECT i, CASE WHEN i = 0 THEN lo WHEN i = 24 THEN hi ELSE lo * exp(ln(hi / lo) / 24 * i) END AS edge FROM e, range(25) t(i)),
  b AS (SELECT a.i, a.edge AS lo, z.edge AS hi FROM edges a JOIN edges z ON z.i = a.i + 1)
  SELECT i::INT AS bucket, count(*) AS n FROM p JOIN b ON price >= lo AND (price < hi OR i = 23) GROUP BY 1""")
def price_histogram_log(spark, folder):
    return facets.price_histogram(listings(spark, folder, "price"))


@query(f"WITH {LISTINGS_SQL} SELECT item, title, price FROM listings WHERE active AND NOT sold AND kind IN ('PROMO', 'ECONOMY') AND price >= 1000 ORDER BY price, item LIMIT 50 OFFSET 50")
def browse_sorted_page(spark, folder):
    spec = FilterSpec.from_query_string("kind=PROMO&kind=ECONOMY&status=available&min_price=1000&sort=price_asc&page=2")
    return page(listings(spark, folder), spec, 2).select("item", "title", "price")


@query(f"WITH {DOCS_SQL} SELECT doc_id FROM docs WHERE contains(lower(text), 'the and') AND contains(lower(text), 'license') AND contains(lower(text), 'ing')")
def search_all_terms(spark, folder):
    spec = FilterSpec(text='"the and" LICENSE ing x')
    return labelled_documents(spark, folder).where(spec.predicate(searched=("text",))).select("doc_id")


@query(f"""WITH {LISTINGS_SQL} SELECT item FROM listings LEFT JOIN (SELECT s_suppkey, lower(s_name) AS s FROM supplier) ON source = s_suppkey
  WHERE (contains(lower(title), 'red') OR contains(s, 'red')) AND (contains(lower(title), '0007') OR contains(s, '0007'))""")
def search_with_names(spark, folder):
    names = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("source"), "s_name")
    return search_with_dimension(listings(spark, folder), "red 0007", ("title",), names, "source", ("s_name",)).select("item")


@query(f"WITH {LISTINGS_SQL} SELECT item, size FROM listings WHERE size BETWEEN 24.95 AND 25.05")
def tolerance_range(spark, folder):
    spec = FilterSpec.from_query_string("min_size=25&max_size=25")
    return listings(spark, folder).where(spec.predicate()).select("item", "size")


@query(f"""WITH {LISTINGS_SQL}, i AS (SELECT item, CASE WHEN quantity > 5 THEN 1900 + size END AS a, CASE WHEN quantity > 5 THEN 1900 + size + quantity::INT END AS b, 1950 + size AS y FROM listings)
  SELECT item FROM i WHERE coalesce(a, y) <= 1945 AND coalesce(b, y) >= 1940""")
def interval_overlap(spark, folder):
    stated = F.col("quantity") > 5
    made_from, made_to = F.when(stated, 1900 + F.col("size")), F.when(stated, 1900 + F.col("size") + F.col("quantity").cast("int"))
    year = 1950 + F.col("size")
    return listings(spark, folder).where((F.coalesce(made_from, year) <= 1945) & (F.coalesce(made_to, year) >= 1940)).select("item")


# ------------------------------------------------------------------------------------------------- time and state


@query(f"WITH {CHANGES_SQL} SELECT item, at, price, type FROM changes QUALIFY row_number() OVER (PARTITION BY item ORDER BY at DESC, seq DESC) = 1")
def latest_per_group(spark, folder):
    return state.last_write(price_changes(spark, folder).withColumn("order", F.struct("at", "seq")), ["item"], "order").select("item", "at", "price", "type")


@query(f"WITH {LISTINGS_SQL} SELECT source, place, item FROM (SELECT source, item, row_number() OVER (PARTITION BY source ORDER BY first_seen DESC, item)::INT AS place FROM listings WHERE first_seen > TIMESTAMP '1999-01-01' AND active AND NOT sold) WHERE place <= 5")
def top_n_per_group(spark, folder):
    return state.digest(listings(spark, folder), datetime(1999, 1, 1)).select("source", "place", "item")


TOLD_SQL = "told AS (SELECT item, arg_min(price, (at, seq)) AS price, min(at) + INTERVAL 5 DAY AS told_at FROM changes GROUP BY 1)"


def _told(changes: DataFrame) -> DataFrame:
    first = changes.groupBy("item").agg(F.min_by("price", F.struct("at", "seq")).alias("price"), F.min("at").alias("a"))
    return first.select("item", "price", (F.col("a") + F.make_dt_interval(days=F.lit(5))).alias("told_at"))


@query(f"WITH {CHANGES_SQL}, {TOLD_SQL} SELECT t.item, t.price, t.told_at, max(c.price) AS peak FROM told t LEFT JOIN changes c ON t.item = c.item AND c.at > told_at GROUP BY ALL")
def peak_since_watermark(spark, folder):
    changes = price_changes(spark, folder)
    return state.peak_since(_told(changes), changes)


@query(f"""WITH {CHANGES_SQL}, {TOLD_SQL}, p AS (SELECT t.item, t.price AS told, t.told_at, max(c.price) AS peak FROM told t LEFT JOIN changes c ON t.item = c.item AND c.at > told_at GROUP BY ALL),
  n AS (SELECT item, arg_max(price, (at, seq)) AS now FROM changes GROUP BY 1)
  SELECT item, coalesce(item % 10 = 0 OR told_at <= TIMESTAMP '2024-01-29' - INTERVAL 20 DAY OR now < told - 0.005 OR coalesce(peak > told + 0.005 AND now <= told + 0.005, false), true) AS news FROM p JOIN n USING (item)""")
def is_news_rules(spark, folder):
    changes = price_changes(spark, folder)
    told = state.peak_since(_told(changes), changes)
    now = changes.groupBy("item").agg(F.max_by("price", F.struct("at", "seq")).alias("now"))
    never = F.col("item") % 10 == 0
    news = state.is_news(F.col("now"), F.when(~never, F.col("price")), F.col("told_at"), F.col("peak"), EVENTS_NOW, 20)
    return told.join(now, "item").select("item", news.alias("news"))


@query(f"WITH {CHANGES_SQL}, s AS (SELECT *, lag(round_even(price * 100, 0)) OVER (PARTITION BY item ORDER BY at, seq) AS b FROM changes) SELECT item, seq, price FROM s WHERE b IS NULL OR b <> round_even(price * 100, 0)")
def change_log_dedup(spark, folder):
    return state.change_log(price_changes(spark, folder)).select("item", "seq", "price")


MERGE_SQL = """k AS (SELECT user_id AS item, arg_min(event_type, (ts, event_id)) AS title, arg_min(value, (ts, event_id)) AS price, user_id % 3 = 0 AS sold, user_id % 4 <> 0 AS active FROM events WHERE user_id % 5 <> 0 GROUP BY user_id),
  r AS (SELECT user_id AS item, CASE WHEN user_id % 2 = 0 THEN arg_max(event_type, (ts, event_id)) END AS title, arg_max(value, (ts, event_id)) AS price, user_id % 6 = 0 AS sold FROM events WHERE user_id % 7 <> 0 GROUP BY user_id)"""


@query(f"""WITH {MERGE_SQL} SELECT coalesce(k.item, r.item) AS item, coalesce(r.title, k.title) AS title, coalesce(r.price, k.price) AS price,
  CASE WHEN k.item IS NOT NULL AND r.item IS NOT NULL AND round_even(r.price * 100, 0) <> round_even(k.price * 100, 0) THEN k.price END AS previous_price,
  CASE WHEN r.item IS NOT NULL THEN r.sold ELSE k.sold END AS sold, r.item IS NOT NULL OR coalesce(k.active, false) AS active,
  CASE WHEN k.item IS NULL THEN 'new' WHEN r.item IS NULL THEN 'unseen' WHEN NOT k.active THEN 'reactivated' WHEN r.sold AND NOT k.sold THEN 'sold' WHEN NOT r.sold AND k.sold THEN 'restocked'
       WHEN round_even(r.price * 100, 0) <> round_even(k.price * 100, 0) THEN 'repriced' ELSE 'same' END AS change
  FROM k FULL JOIN r ON k.item = r.item""")
def merge_upsert(spark, folder):
    changes = price_changes(spark, folder)
    order, item = F.struct("at", "seq"), F.col("item")
    time = lambda: F.lit(None).cast("timestamp_ntz")
    known = changes.where("item % 5 <> 0").groupBy("item").agg(F.min_by("type", order).alias("title"), F.min_by("price", order).alias("price"), F.min("at").alias("first_seen"))
    known = known.select("*", F.lit(None).cast("double").alias("previous_price"), (item % 3 == 0).alias("sold"), (item % 4 != 0).alias("active"), F.col("first_seen").alias("last_seen"), time().alias("sold_at"), time().alias("restocked_at"), time().alias("price_changed_at"))
    read = changes.where("item % 7 <> 0").groupBy("item").agg(F.max_by("type", order).alias("t"), F.max_by("price", order).alias("price"))
    read = read.select("item", F.when(item % 2 == 0, F.col("t")).alias("title"), "price", (item % 6 == 0).alias("sold"))
    return state.merge(known, read, "item", EVENTS_NOW).select("item", "title", "price", "previous_price", "sold", "active", "change")


@query(f"""WITH {LISTINGS_SQL}, a AS (SELECT source, item FROM listings WHERE active), s AS (SELECT item FROM listings WHERE quantity <= source % 60),
  m AS (SELECT * FROM a WHERE item NOT IN (SELECT item FROM s)), c AS (SELECT source, count(*) AS n FROM a GROUP BY 1), g AS (SELECT source, count(*) AS n FROM m GROUP BY 1)
  SELECT source, item FROM m WHERE source NOT IN (SELECT c.source FROM c JOIN g USING (source) WHERE c.n >= 20 AND g.n > 0.5 * c.n)""")
def delist_anti_join(spark, folder):
    rows = listings(spark, folder)
    active = rows.where("active").select("source", "item")
    return state.delisting(active, rows.where(F.col("quantity") <= F.col("source") % 60), ["item"], "source")


RUNS_SQL = "runs AS (SELECT user_id % 20 AS source, event_id AS seq, ts AS at, event_type = 'error' AS failed FROM events)"


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return price_changes(spark, folder).select((F.col("item") % 20).alias("source"), "seq", "at", (F.col("type") == "error").alias("failed"))


@query(f"""WITH {RUNS_SQL}, b AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY source ORDER BY at, seq) AS block, lead(at) OVER (PARTITION BY source ORDER BY at, seq) AS next FROM runs)
  SELECT source, min(at) AS began, arg_max(struct_pack(n := next), (at, seq)).n AS ended, count(*) AS failures FROM b WHERE failed GROUP BY source, block""")
def failure_episodes(spark, folder):
    return state.episodes(_runs(spark, folder))


@query(f"""WITH {RUNS_SQL}, s AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE -1 END) OVER w AS total FROM runs WINDOW w AS (PARTITION BY source ORDER BY at, seq ROWS UNBOUNDED PRECEDING)),
  l AS (SELECT *, least(0, min(total) OVER (PARTITION BY source ORDER BY at, seq ROWS UNBOUNDED PRECEDING)) AS low FROM s),
  h AS (SELECT source, arg_max(total - low, (at, seq))::BIGINT AS held FROM l GROUP BY 1)
  SELECT source, held, CASE WHEN held > 0 THEN least(60.0 * pow(2.0, held - 1), 3600.0) ELSE 0.0 END AS wait FROM h""")
def cooldown_state(spark, folder):
    return state.cooldown(_runs(spark, folder), 60.0, 3600.0)


@query(f"""WITH {CHANGES_SQL}, w AS (SELECT item, 200.0 + item AS target, item % 3 = 0 AS aimed, arg_max(price, (at, seq)) AS price, min(price) AS low, max(at) AS at, item % 7 = 0 AS sold, item % 5 <> 0 AS active FROM changes GROUP BY ALL)
  SELECT item, CASE WHEN sold THEN CASE WHEN at > s THEN 'SOLD' END WHEN NOT active THEN 'GONE' WHEN at > s AND aimed THEN CASE WHEN price <= target THEN 'TARGET' END
    WHEN at > s AND price < low + 50 THEN 'CHEAPER' WHEN at > s AND price > low + 50 THEN 'DEARER' END AS news FROM w, (SELECT TIMESTAMP '2024-01-28' AS s)""")
def watch_news(spark, folder):
    item = F.col("item")
    rows = price_changes(spark, folder).groupBy("item").agg(F.max_by("price", F.struct("at", "seq")).alias("price"), (F.min("price") + 50).alias("previous_price"), F.max("at").alias("price_changed_at"))
    rows = rows.select("*", F.when(item % 3 == 0, 200.0 + item).alias("target"), (item % 7 == 0).alias("sold"), (item % 5 != 0).alias("active"), F.lit(None).cast("timestamp_ntz").alias("last_seen"), F.lit(None).cast("timestamp_ntz").alias("restocked_at"))
    return rows.select("item", state.watch_news(market.instant(datetime(2024, 1, 28))).alias("news"))


@query(f"WITH {CHANGES_SQL} SELECT item, seq FROM changes QUALIFY row_number() OVER (PARTITION BY item ORDER BY at DESC, seq DESC) > 30")
def keep_newest(spark, folder):
    return state.keep_newest(price_changes(spark, folder), "item", [F.desc("at"), F.desc("seq")], 30).select("item", "seq")


@query(f"WITH {CHANGES_SQL} SELECT time_bucket(INTERVAL 1 DAY, at) AS start, type, count(*) AS n, sum(round_even(price * 100, 0))::BIGINT AS cents FROM changes GROUP BY ALL")
def tumbling_event_counts(spark, folder):
    return flows.tumbling(price_changes(spark, folder), "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""WITH {CHANGES_SQL}, g AS (SELECT *, CASE WHEN at < lag(at) OVER (PARTITION BY item ORDER BY at) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM changes),
  s AS (SELECT *, sum(new) OVER (PARTITION BY item ORDER BY at ROWS UNBOUNDED PRECEDING) AS id FROM g)
  SELECT item, min(at) AS start, count(*) AS n, max(round_even(price * 100, 0))::BIGINT AS most FROM s GROUP BY item, id""")
def session_windows(spark, folder):
    return flows.sessions(price_changes(spark, folder), "6 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"WITH {CHANGES_SQL}, s AS (SELECT *, lag(round_even(price * 100, 0)) OVER (PARTITION BY item ORDER BY at, seq) AS b FROM changes) SELECT item, seq, price FROM s WHERE b IS NULL OR b <> round_even(price * 100, 0)")
def streaming_equals_batch(spark, folder):
    """The change log by a stream over the event files, one file a batch: the rows of the batch form."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    read = lambda df: df.select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.col("value").alias("price"), F.col("event_type").alias("type"))
    log = flows.stream_changes(spark, f"{folder}/event[s].parquet", schema, read, f"{flows.shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}")
    return log.select("item", "seq", "price")


@query("""SELECT conv_id, heading, count(*) AS turns, string_agg(role, ',' ORDER BY turn) AS roles FROM
  (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS heading FROM conversations) GROUP BY conv_id, heading""")
def thread_positional_groups(spark, folder):
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = table(spark, folder, "conversations").withColumn("heading", F.sum((F.col("role") == "user").cast("int")).over(order))
    groups = rows.groupBy("conv_id", "heading").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return groups.select("conv_id", "heading", "turns", F.array_join(F.transform("x", lambda t: t["role"]), ",").alias("roles"))


# ------------------------------------------------------------------------------------------------------ matching

RULES = [(1, "widget", "tool"), (2, "red widget", "red tool"), (3, "bolt", "part"), (4, "blue", "blue thing"), (5, "small ring", "ring"), (6, "anvil", "heavy"), (7, "green anvil", "green heavy")]
RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in RULES) + ") t(position, spelling, value)), hits AS (SELECT p_partkey, position, value, length(replace(spelling, ' ', '')) AS weight FROM part JOIN rules ON contains(' ' || lower(p_name) || ' ', ' ' || spelling || ' '))"


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "position int, spelling string, value string")


@query(f"WITH {RULES_SQL} SELECT p_partkey, arg_min(value, position) AS value FROM hits GROUP BY 1")
def first_rule_match(spark, folder):
    return matching.first_match(table(spark, folder, "part"), "p_partkey", "p_name", _rules(spark))


@query(f"WITH {RULES_SQL} SELECT p_partkey, arg_max(value, (weight, -position)) AS value, max(weight)::INT AS weight FROM hits GROUP BY 1")
def longest_rule_match(spark, folder):
    return matching.longest_match(table(spark, folder, "part"), "p_partkey", "p_name", _rules(spark))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE 'maker ' || s_suppkey END AS canonical FROM supplier")
def alias_canonicalise(spark, folder):
    supplier = table(spark, folder, "supplier")
    key = F.col("s_suppkey")
    rows = supplier.select("s_suppkey", F.when(key % 3 == 0, F.col("s_name")).when(key % 3 == 1, F.upper(F.regexp_replace("s_name", "#", " "))).otherwise("nobody").alias("name"))
    aliases = supplier.select(F.col("s_name").alias("alias"), F.concat(F.lit("maker "), key).alias("canonical"))
    return matching.canonical(rows, "name", aliases).select("s_suppkey", "canonical")


@query("""WITH r AS (SELECT p_brand, p_partkey % 100 * 20 AS low, p_partkey % 100 * 20 + 30 AS high, p_partkey FROM part WHERE p_size > 40)
  SELECT l_orderkey, l_linenumber, l_partkey, r.p_partkey AS range_id FROM lineitem JOIN part p ON l_partkey = p.p_partkey JOIN r ON r.p_brand = p.p_brand AND l_partkey BETWEEN low AND high""")
def serial_range_lookup(spark, folder):
    part = table(spark, folder, "part")
    points = table(spark, folder, "lineitem").join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "p_brand")
    base = F.col("p_partkey") % 100 * 20
    ranges = part.where("p_size > 40").select("p_brand", base.alias("low"), (base + 30).alias("high"), F.col("p_partkey").alias("range_id"))
    return matching.in_ranges(points, ranges, ["p_brand"], "l_partkey", 64).select("l_orderkey", "l_linenumber", "l_partkey", "range_id")


@query("""WITH e AS (SELECT p_brand, p_partkey, p_retailprice FROM part WHERE p_type = 'PROMO'), p AS (SELECT p_brand, p_partkey FROM part WHERE p_type <> 'PROMO')
  SELECT p_brand, p_partkey, (SELECT max(p_partkey) FROM e WHERE e.p_brand = p.p_brand AND e.p_partkey < p.p_partkey) AS below_at, (SELECT min(p_partkey) FROM e WHERE e.p_brand = p.p_brand AND e.p_partkey > p.p_partkey) AS above_at,
   (SELECT arg_max(p_retailprice, p_partkey) FROM e WHERE e.p_brand = p.p_brand AND e.p_partkey < p.p_partkey) AS below, (SELECT arg_min(p_retailprice, p_partkey) FROM e WHERE e.p_brand = p.p_brand AND e.p_partkey > p.p_partkey) AS above FROM p""")
def bracketing_neighbours(spark, folder):
    part = table(spark, folder, "part")
    points = part.where("p_type <> 'PROMO'").select("p_brand", "p_partkey", F.col("p_partkey").alias("point"))
    return matching.bracket(points, part.where("p_type = 'PROMO'").select("p_brand", "p_partkey", "p_retailprice"), "p_brand", "p_partkey", "p_retailprice").drop("point")


@query(f"WITH {LISTINGS_SQL} SELECT title || size AS k, min(kind) AS value, count(*) AS rows, count(DISTINCT source) AS sources FROM listings GROUP BY 1 HAVING min(kind) = max(kind) AND count(*) >= 5 AND count(DISTINCT source) >= 2")
def unanimous_vote(spark, folder):
    return matching.unanimous(listings(spark, folder, "title", "size", "kind", "source").withColumn("k", F.concat("title", "size")), "k", "kind", "source")


@query("""WITH c AS (SELECT p_brand, p_size AS v, count(*) AS n FROM part GROUP BY ALL), a AS (SELECT p_brand, sum(n)::BIGINT AS total, arg_max(v, (n, -v)) AS top, max(n) AS n FROM c GROUP BY 1),
  g AS (SELECT a.p_brand, arg_max(v, (c.n, -v)) AS v, max(c.n) AS m FROM a JOIN c ON a.p_brand = c.p_brand AND v > 10 GROUP BY 1)
  SELECT p_brand, CASE WHEN top = 10 AND m >= 2 AND m >= total / 3.0 THEN v ELSE top END AS value, n, total AS "all" FROM a LEFT JOIN g USING (p_brand) WHERE n >= 2""")
def mode_with_fallback(spark, folder):
    return matching.usual(table(spark, folder, "part"), "p_brand", "p_size", yields=10)


@query("""WITH t AS (SELECT page_id, url, regexp_extract(url, '//([^/?#]+)', 1) AS host,
    list_sort(list_distinct(list_filter(regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '([a-z0-9]+)', 1), lambda w: len(w) >= 3))) AS words FROM pages),
  d AS (SELECT DISTINCT words FROM t), n AS (SELECT count(*) AS n FROM d), f AS (SELECT w, ln(any_value(n) / count(*)) / ln(greatest(any_value(n), 2)) AS r FROM (SELECT unnest(words) AS w FROM d), n GROUP BY 1),
  a AS (SELECT * FROM t WHERE contains(url, '?')), g AS (SELECT * FROM t WHERE NOT contains(url, '?')),
  p AS (SELECT a.page_id, g.page_id AS donor, list_intersect(a.words, g.words) AS shared_words, least(len(a.words), len(g.words)) AS small FROM a JOIN g ON a.host <> g.host),
  s AS (SELECT page_id, donor, any_value(len(shared_words)) AS shared, any_value(small) AS small, sum(r) AS score FROM (SELECT *, unnest(shared_words) AS w FROM p) JOIN f USING (w) GROUP BY 1, 2)
  SELECT page_id, arg_min(donor, (-round_even(score, 9), donor)) AS donor, round_even(max(score), 6) AS score FROM s WHERE shared >= 2 AND score >= 1.5 AND shared / small >= 0.34 GROUP BY 1""")
def idf_best_donor(spark, folder):
    rows = table(spark, folder, "pages").select("page_id", "url", F.regexp_extract("url", "//([^/?#]+)", 1).alias("host"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return matching.best_donors(rows, "page_id", "host", "title", F.col("url").contains("?"), ~F.col("url").contains("?"))


@query(f"WITH {DOCS_SQL} SELECT name, count(DISTINCT doc_id) AS sightings FROM (SELECT doc_id, regexp_extract(text, '([A-Z][a-z]+ License)', 1) AS name FROM docs) WHERE name <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3")
def corroborated_names(spark, folder):
    return matching.corroborated(labelled_documents(spark, folder), F.regexp_extract("text", "([A-Z][a-z]+ License)", 1), "doc_id")


@query(f"""WITH {LISTINGS_SQL} SELECT item, CASE WHEN price > 0 THEN round_even(price + coalesce(CASE WHEN s_acctbal > 0 THEN s_suppkey + 9.5 END, 0.0) + 25.0, 2) END AS delivered, CASE WHEN price > 0 THEN s_acctbal > 0 END AS complete
  FROM listings JOIN supplier ON source = s_suppkey""")
def delivered_cost(spark, folder):
    shipping = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("source"), F.when(F.col("s_acctbal") > 0, F.col("s_suppkey") + 9.5).alias("shipping"))
    return matching.delivered(listings(spark, folder), shipping, "source", "price", 25.0).select("item", "delivered", "complete")


@query("""WITH g(word, position) AS (VALUES ('5-LOW', 1), ('4-NOT SPECIFIED', 2), ('3-MEDIUM', 3), ('2-HIGH', 4), ('1-URGENT', 5))
  SELECT position, coalesce(count(o_orderkey), 0) AS n FROM g LEFT JOIN orders ON word = o_orderpriority GROUP BY 1""")
def condition_grade_scale(spark, folder):
    scale = spark.createDataFrame([(w, i + 1) for i, w in enumerate(["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"])], "word string, position int")
    counts = table(spark, folder, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return scale.join(counts, F.col("word") == F.col("o_orderpriority"), "left").select("position", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {LISTINGS_SQL}, o AS (SELECT kind, quantity AS weight, price / quantity AS each FROM listings WHERE {SHELF}), w AS (SELECT * FROM (VALUES (10.0), (25.0), (48.0)) t(weight)), k AS (SELECT DISTINCT kind FROM o)
  SELECT o.kind, w.weight::DOUBLE AS weight, round_even(min(each), 4) AS low, count(*) AS offers FROM k, w JOIN o ON o.kind = k.kind AND abs(o.weight - w.weight) <= 0.03 * w.weight GROUP BY ALL""")
def weight_lows(spark, folder):
    offers = market.for_sale(listings(spark, folder)).select("kind", F.col("quantity").alias("weight"), (F.col("price") / F.col("quantity")).alias("each"))
    wanted = offers.select("kind").distinct().select("kind", F.explode(F.array(F.lit(10.0), F.lit(25.0), F.lit(48.0))).alias("weight"))
    return matching.lows_by_weight(offers, wanted, "kind", "weight", "each")


@query("""WITH v AS (SELECT p_brand, p_partkey AS variant, p_size::DOUBLE AS size FROM part WHERE p_type = 'ECONOMY'), r AS (SELECT p_partkey, p_brand, p_size::DOUBLE AS size FROM part)
  SELECT r.p_partkey, min(variant) AS variant FROM r JOIN v ON r.p_brand = v.p_brand AND abs(r.size - v.size) <= 2 GROUP BY 1 HAVING count(*) = 1""")
def variant_link(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("double").alias("size"))
    variants = part.where("p_type = 'ECONOMY'").select("p_brand", F.col("p_partkey").alias("variant"), "size")
    return matching.within_tolerance(part, variants, ["p_brand"], "size", 2.0).select("p_partkey", "variant")


@query("""WITH o AS (SELECT * FROM supplier WHERE s_suppkey % 9 <> 0), n AS (SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 4 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 8 <> 0)
  SELECT coalesce(n.s_suppkey, o.s_suppkey) AS s_suppkey, CASE WHEN o.s_suppkey IS NULL THEN 'added' WHEN n.s_suppkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
    CASE WHEN o.s_suppkey IS NOT NULL AND n.s_suppkey IS NOT NULL THEN 's_acctbal' ELSE '' END AS fields
  FROM o FULL JOIN n ON o.s_suppkey = n.s_suppkey WHERE o.s_suppkey IS NULL OR n.s_suppkey IS NULL OR o.s_acctbal IS DISTINCT FROM n.s_acctbal""")
def reference_diff(spark, folder):
    supplier = table(spark, folder, "supplier")
    new = supplier.where("s_suppkey % 8 <> 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 4 == 0, 0.0).otherwise(F.col("s_acctbal")))
    return matching.diff(supplier.where("s_suppkey % 9 <> 0"), new, "s_suppkey", ["s_name", "s_nationkey", "s_acctbal"])


@query("""WITH m AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 1 THEN n_nationkey - 1 ELSE n_nationkey END AS into, lower(n_name) AS alias FROM nation)
  SELECT m.k AS n_nationkey, m.into, CASE WHEN m.into = m.k THEN (SELECT string_agg(alias, ',' ORDER BY alias) FROM m x WHERE x.into = m.k) ELSE '' END AS aliases FROM m""")
def reference_merge(spark, folder):
    nation = table(spark, folder, "nation").select("n_nationkey", F.array(F.lower("n_name")).alias("aliases"))
    merges = nation.where("n_nationkey % 5 = 1").select(F.col("n_nationkey").alias("loser"), (F.col("n_nationkey") - 1).alias("winner"))
    return matching.merge_rows(nation, merges, "n_nationkey", "aliases").select("n_nationkey", "into", F.array_join("aliases", ",").alias("aliases"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
  len(regexp_extract_all(html, '<a href='))::BIGINT AS links, len(regexp_extract_all(html, '<p>'))::BIGINT AS paragraphs, regexp_extract(url, '//([^/?#]+)', 1) AS host, regexp_extract(url, '//[^/?#]+([^?#]*)', 1) AS path FROM pages""")
def page_card_extract(spark, folder):
    return feeds.page_cards(table(spark, folder, "pages"))


@query(f"WITH {DOCS_SQL} SELECT phrase, count(*) AS mentions FROM docs, (VALUES ('apache license'), ('mit license'), ('the and'), ('that ')) p(phrase) WHERE contains(lower(text), phrase) GROUP BY 1")
def mention_counts(spark, folder):
    phrases = ["apache license", "mit license", "the and", "that "]
    low = F.lower("text")
    found = facets.conditional(labelled_documents(spark, folder), {p: low.contains(p) for p in phrases})
    return found.select(F.col("name").alias("phrase"), F.col("n").alias("mentions")).where("mentions > 0")


@query(f"WITH {LISTINGS_SQL} SELECT kind, {nearest('price', {'p02': 0.02, 'p98': 0.98})}, count(price) AS n FROM listings GROUP BY 1")
def typical_span(spark, folder):
    return nearest_ranks(listings(spark, folder), ["kind"], "price", {"p02": 0.02, "p98": 0.98})


# ----------------------------------------------------------------------------------- readers and reference tables


@query(f"""WITH {LISTINGS_SQL} SELECT source, sum(price) FILTER (size > 10)::DECIMAL(18, 2)::DOUBLE AS cost, sum(quantity) FILTER (size > 10) AS value, count(*) FILTER (size > 10) AS paired, count(*) FILTER (size <= 10) AS unpaired
  FROM listings GROUP BY 1""".replace("sum(price) FILTER (size > 10)::DECIMAL(18, 2)::DOUBLE", "sum(CAST(price AS DECIMAL(18, 2))) FILTER (size > 10)::DOUBLE"))
def paired_totals(spark, folder):
    rows = listings(spark, folder).select("source", F.when(F.col("size") > 10, F.col("price").cast("decimal(18,2)")).alias("price"), "quantity")
    return collection.paired_totals(rows, ["source"], "price", "quantity").withColumn("cost", F.col("cost").cast("double"))


@query("""WITH t AS (SELECT user_id AS item, max(ts) AS recorded_at FROM events WHERE user_id % 3 <> 0 GROUP BY 1), v AS (SELECT user_id AS item, count(*) AS n FROM events GROUP BY 1)
  SELECT item, n, TIMESTAMP '2024-02-05' AS recorded_at FROM v WHERE item NOT IN (SELECT item FROM t WHERE recorded_at > TIMESTAMP '2024-02-05' - INTERVAL 7 DAY)""")
def snapshots_due(spark, folder):
    changes = price_changes(spark, folder)
    taken = changes.where("item % 3 <> 0").groupBy("item").agg(F.max("at").alias("recorded_at"))
    return collection.snapshots_due(changes.groupBy("item").agg(F.count("*").alias("n")), taken, "item", datetime(2024, 2, 5))


@query(f"""WITH {LISTINGS_SQL}, w AS (SELECT p_partkey AS model FROM part),
  u AS (SELECT model, 'departed' AS basis, item, -epoch_us(coalesce(sold_at, delisted_at))::DOUBLE AS o FROM listings WHERE {DEPARTED} UNION ALL SELECT model, 'shelf', item, price FROM listings WHERE {SHELF} AND price > 0)
  SELECT model, basis, item, place FROM (SELECT *, row_number() OVER (PARTITION BY model, basis ORDER BY o, item)::INT AS place FROM u JOIN w USING (model)) WHERE place <= 50""")
def comparables(spark, folder):
    wanted = table(spark, folder, "part").select(F.col("p_partkey").alias("model"))
    return collection.comparables(listings(spark, folder, "item", "model", "price", "first_seen", "sold", "active", "sold_at", "delisted_at"), wanted, "model").select("model", "basis", "item", "place")


SAVED = {"cheap": "max_price=950&status=available", "promo": "kind=PROMO&q=ring", "others": "not_kind=PROMO&not_kind=ECONOMY&min_size=45"}


@query(f"""WITH {LISTINGS_SQL}, m AS (SELECT 'cheap' AS search, item FROM listings WHERE price <= 950 AND active AND NOT sold UNION ALL SELECT 'promo', item FROM listings WHERE kind = 'PROMO' AND contains(lower(title), 'ring')
  UNION ALL SELECT 'others', item FROM listings WHERE kind NOT IN ('PROMO', 'ECONOMY') AND size >= 45) SELECT search, item FROM m WHERE NOT (search = 'promo' AND item IN (SELECT item FROM listings WHERE quantity > 25))""")
def saved_search_news(spark, folder):
    rows = listings(spark, folder)
    matches = collection.saved_matches(rows, {k: FilterSpec.from_query_string(q) for k, q in SAVED.items()})
    return collection.untold(matches, rows.where("quantity > 25").select(F.lit("promo").alias("search"), "item"))


#: Searches with their orders, and the moment since which each announces.
WANTED = {"cheap": ("max_price=1200&sort=price_asc&status=sold", datetime(1997, 6, 1)), "promo": ("kind=PROMO&sort=price_drop", datetime(1998, 1, 1)), "large": ("min_size=40&sort=price_asc", datetime(1998, 6, 1))}


@query(f"""WITH {LISTINGS_SQL}, w AS (SELECT *, CASE size % 3 WHEN 0 THEN price + size WHEN 1 THEN price - 10 END AS previous_price, CASE WHEN quantity % 2 = 0 THEN first_seen + INTERVAL 365 DAYS END AS changed,
    CASE WHEN size % 7 = 0 THEN first_seen + INTERVAL 700 DAYS END AS back FROM listings WHERE active AND NOT sold),
  h AS (SELECT search, w.* FROM w JOIN (VALUES ('cheap', TIMESTAMP '1997-06-01'), ('promo', TIMESTAMP '1998-01-01'), ('large', TIMESTAMP '1998-06-01')) s(search, since)
    ON CASE search WHEN 'cheap' THEN price <= 1200 WHEN 'promo' THEN kind = 'PROMO' ELSE size >= 40 END AND (first_seen >= since OR (changed >= since AND price < previous_price) OR back >= since) AND NOT (search = 'promo' AND quantity > 40)),
  o AS (SELECT search, item, count(*) OVER (PARTITION BY search) AS fresh, row_number() OVER (PARTITION BY search ORDER BY CASE WHEN search = 'promo' THEN price - previous_price ELSE price END NULLS LAST, item)::INT AS place FROM h)
  SELECT search, item, place, fresh FROM o WHERE place <= 10""")
def want_list_news(spark, folder):
    size, price = F.col("size"), F.col("price")
    rows = listings(spark, folder).withColumns({
        "previous_price": F.when(size % 3 == 0, price + size).when(size % 3 == 1, price - 10),
        "price_changed_at": F.when(F.col("quantity") % 2 == 0, F.col("first_seen") + F.make_dt_interval(days=F.lit(365))),
        "restocked_at": F.when(size % 7 == 0, F.col("first_seen") + F.make_dt_interval(days=F.lit(700))),
    })
    specs = {k: FilterSpec.from_query_string(q) for k, (q, _) in WANTED.items()}
    told = rows.where("quantity > 40").select(F.lit("promo").alias("search"), "item")
    hits = collection.want_hits(rows, specs, {k: since for k, (_, since) in WANTED.items()}, told)
    return collection.want_news(cut(hits.select("search", "item", "price", "previous_price"), "hits"), specs)  # read by each order and the count


@query(f"""WITH {LISTINGS_SQL}, o AS (SELECT size % 10 AS reader, source, sum(CAST(price AS DECIMAL(18, 2))) AS goods, sum(CASE WHEN source % 4 > 0 THEN source + 1.0 ELSE 0.0 END) AS sent, count(*) AS n, bool_or(source % 4 = 0) AS open
    FROM listings WHERE active AND NOT sold AND price > 0 GROUP BY ALL)
  SELECT reader, sum(n)::BIGINT AS items, sum(goods)::DOUBLE AS goods, round_even(sum(goods)::DOUBLE + sum(sent + CASE WHEN goods >= 50000 THEN 0 ELSE 20 END), 2)::DOUBLE AS delivered, NOT bool_or(open) AS complete FROM o GROUP BY 1""")
def wish_totals(spark, folder):
    rows = listings(spark, folder).withColumn("price", F.col("price").cast("decimal(18,2)"))
    wishes = rows.select((F.col("size") % 10).alias("reader"), "item")
    shipping = rows.select("source").distinct().select("source", F.when(F.col("source") % 4 > 0, F.col("source") + 1.0).alias("shipping"))
    out = collection.wish_totals(wishes, rows, shipping, 20.0, 50000.0)
    return out.withColumn("goods", F.col("goods").cast("double"))


@query("""WITH l AS (SELECT s_suppkey AS accessory, s_acctbal AS price, s_suppkey % 3 = 0 AS in_stock, unnest([s_nationkey, (s_nationkey + 1) % 25]) AS model FROM supplier),
  f AS (SELECT c_custkey AS owned, accessory, min(price) AS price, bool_or(in_stock) AS in_stock FROM customer JOIN l ON c_nationkey = model GROUP BY ALL)
  SELECT owned, accessory, place FROM (SELECT *, row_number() OVER (PARTITION BY owned ORDER BY in_stock DESC, price, accessory)::INT AS place FROM f) WHERE place <= 4""")
def fits_owned(spark, folder):
    owned = table(spark, folder, "customer").select(F.col("c_custkey").alias("owned"), F.col("c_nationkey").alias("model"))
    key = F.col("s_nationkey")
    accessories = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("accessory"), F.col("s_acctbal").alias("price"), (F.col("s_suppkey") % 3 == 0).alias("in_stock"), F.array(key, (key + 1) % 25).alias("lines"))
    return collection.fits(owned, accessories, 4).select("owned", "accessory", "place")


@query("""WITH s AS (SELECT * FROM (VALUES ('red widget', 'w'), ('ring', 'r'), ('anvil', 'a')) t(spelling, value)) SELECT DISTINCT p_partkey, value FROM part JOIN s ON contains(' ' || p_name || ' ', ' ' || spelling || ' ')""")
def targeted_rematch(spark, folder):
    spellings = spark.createDataFrame([("red widget", "w"), ("ring", "r"), ("anvil", "a")], "spelling string, value string")
    return reference.mentions(table(spark, folder, "part"), "p_partkey", "p_name", spellings)


@query("""WITH k AS (SELECT DISTINCT lower(p_name || p_size % 4) AS n FROM part), c AS (SELECT p_name || p_size % 5 AS name, count(*) AS sightings FROM part GROUP BY 1) SELECT name, sightings FROM c WHERE sightings >= 2 AND lower(name) NOT IN (SELECT n FROM k)""")
def proposed_names(spark, folder):
    """Names with a number from 0 to 4 are seen; those with 0 to 3 are known, in capitals."""
    part = table(spark, folder, "part")
    known = part.select(F.upper(F.concat("p_name", F.lit("-"), (F.col("p_size") % 4).cast("string"))).alias("name"))
    return reference.propose(part.select(F.concat("p_name", (F.col("p_size") % 5).cast("string")).alias("name")), known, "name", 2)


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'LAND ' || n_nationkey ELSE n_name END AS name, CASE WHEN n_nationkey % 4 = 0 THEN n_name || ',old' ELSE 'old' END AS aliases FROM nation""")
def primary_rename(spark, folder):
    rows = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.array(F.lit("old")).alias("aliases"))
    names = rows.where("n_nationkey % 4 = 0").select("n_nationkey", F.concat(F.lit("LAND "), "n_nationkey").alias("new"))
    return reference.rename(rows, names, "n_nationkey").select("n_nationkey", "name", F.array_join("aliases", ",").alias("aliases"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def undo_restores(spark, folder):
    rows = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    log = reference.logged(rows.where("s_suppkey % 3 = 0"), "s_suppkey", "edit", 1)
    edited = rows.where("s_suppkey % 6 <> 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 3 == 0, F.lit(None)).otherwise(F.col("s_acctbal")))
    return reference.reverted(edited, log, "s_suppkey", 1)


@query("""SELECT CASE WHEN s_suppkey % 10 = 3 THEN 's' || (s_suppkey + 1000) ELSE 's' || s_suppkey END AS k, s_acctbal FROM supplier""")
def rekey_adoption(spark, folder):
    """Suppliers as rows of shops of a thousand each: a shop's keys are its own, so that its new key may be another shop's old one."""
    shop = F.floor(F.col("s_suppkey") / 1000).alias("shop")
    rows = table(spark, folder, "supplier")
    known = rows.select(shop, F.concat(F.lit("s"), "s_suppkey").alias("k"), "s_acctbal", F.col("s_suppkey").alias("first_seen"))
    gone = rows.where("s_suppkey % 10 = 3").select(shop, F.concat(F.lit("s"), (F.col("s_suppkey") + 1000).cast("string")).alias("k"), F.array(F.concat(F.lit("s"), "s_suppkey")).alias("replaces"))
    here = rows.where("s_suppkey % 10 <> 3").select(shop, F.concat(F.lit("s"), "s_suppkey").alias("k"), F.array(F.lit("s1"), F.lit("s4")).alias("replaces"))
    return reference.rekeyed(known, gone.union(here), "k", ["shop"]).select("k", "s_acctbal")


@query("SELECT o.o_orderkey, least(o.o_orderdate, p.o_orderdate) AS first_seen FROM orders o LEFT JOIN orders p ON o.o_orderkey // 10 * 10 = p.o_orderkey AND o.o_orderkey % 10 <> 0")
def first_seen_inheritance(spark, folder):
    key = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").alias("first_seen"), F.when(key % 10 != 0, (F.floor(key / 10) * 10).cast("long")).alias("parent"))
    return reference.inherit_first_seen(rows, "o_orderkey", "parent").select("o_orderkey", "first_seen")


@query("SELECT p_partkey, p_size FROM part WHERE p_size < 4 ORDER BY p_size, p_partkey LIMIT 40")
def queue_by_attempts(spark, folder):
    return reference.queue(table(spark, folder, "part"), "p_size", 4, 40, "p_partkey").select("p_partkey", "p_size")


@query("""SELECT event_id, CASE WHEN event_type = 'error' AND ts < TIMESTAMP '2024-01-15' - INTERVAL 6 HOUR THEN 'failed' WHEN event_type = 'error' THEN 'running' ELSE 'success' END AS status,
  CASE WHEN event_type = 'error' AND ts < TIMESTAMP '2024-01-15' - INTERVAL 6 HOUR THEN TIMESTAMP '2024-01-15' WHEN event_type <> 'error' THEN ts END AS finished_at FROM events""")
def run_reaping(spark, folder):
    failed = F.col("event_type") == "error"
    runs = table(spark, folder, "events").select("event_id", F.when(failed, "running").otherwise("success").alias("status"), F.col("ts").alias("started_at"), F.when(~failed, F.col("ts")).alias("finished_at"))
    return reference.reaped(runs, datetime(2024, 1, 15), 6).select("event_id", "status", "finished_at")


@query("SELECT p_brand, CAST(row_number() OVER (ORDER BY CAST(substr(p_brand, 7) AS INT)) AS INTEGER) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def natural_sort(spark, folder):
    brands = table(spark, folder, "part").select("p_brand").distinct()  # a handful of values
    return brands.select("p_brand", F.row_number().over(Window.orderBy(orders.natural(F.col("p_brand")))).alias("place"))


@query("SELECT p_name FROM (SELECT DISTINCT p_name FROM part WHERE contains(p_name, 'r')) ORDER BY CASE WHEN starts_with(p_name, 'r') THEN 0 ELSE 1 END, p_name LIMIT 10")
def prefix_ranking(spark, folder):
    names = table(spark, folder, "part").select("p_name").distinct().where(F.col("p_name").contains("r"))
    return names.orderBy(*orders.prefix_first(F.col("p_name"), "r")).limit(10)


@query("SELECT page_id, regexp_extract(regexp_extract(url, '//([^/:?#]+)', 1), '([^.]+[.][^.]+)$', 1) AS domain FROM pages")
def registrable_domains(spark, folder):
    return table(spark, folder, "pages").select("page_id", C.registrable_domain(F.col("url")).alias("domain"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS INT) % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def json_properties(spark, folder):
    k = F.from_json("props", "k int")["k"]
    return table(spark, folder, "events").groupBy("event_type", (k % 10).alias("k")).agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::HUGEINT << i ELSE 0 END))::HUGEINT AS bits FROM embeddings WHERE embedding IS NOT NULL),
  b AS (SELECT CASE WHEN bits >= 9223372036854775808 THEN bits - 18446744073709551616 ELSE bits END::BIGINT AS h, bits, count(*) AS n FROM v GROUP BY ALL)
  SELECT a.h AS a, b.h AS b, bit_count(xor(a.bits, b.bits))::INT AS distance, a.n AS rows_a, b.n AS rows_b FROM b a JOIN b ON a.h < b.h AND bit_count(xor(a.bits, b.bits)) <= 16""")
def near_duplicate_bits(spark, folder):
    """Pictures' 64-bit hashes (here: signs of vectors) within a distance, by comparing packed blocks of them."""
    bit = lambda i: F.when(F.element_at("embedding", i + 1) > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    hashes = table(spark, folder, "embeddings").where("embedding is not null").select(reduce(lambda a, b: a.bitwiseOR(b), [bit(i) for i in range(64)]).alias("bits"))
    return matching.near_bits(hashes, "bits", 16)


@query(f"WITH {CHANGES_SQL} SELECT item, seq, min(price) OVER w AS lowest, max(price) OVER w AS highest FROM changes WINDOW w AS (PARTITION BY item ORDER BY at, seq ROWS UNBOUNDED PRECEDING)")
def cumulative_extremes(spark, folder):
    upto = Window.partitionBy("item").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return price_changes(spark, folder).select("item", "seq", F.min("price").over(upto).alias("lowest"), F.max("price").over(upto).alias("highest"))


def _all() -> None:
    """Registers the questions of the other modules as well."""
    from . import reading_queries, curation_queries, review_queries, source_queries, composed_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(ORACLES)
