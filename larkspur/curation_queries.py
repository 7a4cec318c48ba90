"""Curated tables, streams with state, the outbox, bucketed state, recorded pages, phrases, serials and page layout as queries over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import curation, layout, phrases, serials
from .operators.stored import StateTable
from .queries import EVENTS_NOW, MERGE_SQL, query
from .sources import recorded
from .sources.tables import price_changes, table
from .streaming import outbox, stateful
from .written import cut, own_path


# ------------------------------------------------------------------------------------------------------ pages, phrases

@query("SELECT page_id, url, md5(html) AS digest FROM pages")
def recorded_pages(spark, folder):
    """All pages written as a recording and read back by the data source, with a bound that its reader takes."""
    recorded.register(spark)
    path = own_path(spark, "recorded")
    table(spark, folder, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html").write.format("recorded_pages").mode("append").save(path)
    return spark.read.format("recorded_pages").load(path).where("page_id >= 0").select("page_id", "url", F.md5(F.col("html").cast("binary")).alias("digest"))


@query("""WITH t AS (SELECT l_partkey, 'Sold: ' || p_name || ' no ' || l_partkey AS text, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
  SELECT p_partkey AS value, coalesce(sum(n), 0)::BIGINT AS mentions FROM part LEFT JOIN t ON contains(text, p_name || ' no ' || p_partkey) GROUP BY 1""")
def mention_counts_of_names(spark, folder):
    """How many listings have each of the part table's names in them, as a search for the name finds it; one pass over the listings."""
    part = table(spark, folder, "part")
    text = F.concat(F.lit("Sold:  "), F.upper("p_name"), F.lit(" no "), F.col("p_partkey").cast("string"))
    rows = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey").select(text.alias("text"))
    names = part.select(F.concat("p_name", F.lit(" no "), F.col("p_partkey").cast("string")).alias("phrase"), F.col("p_partkey").alias("value"))
    return phrases.mention_counts(rows, ["text"], names)


_BARE = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH b AS (SELECT string_split({_BARE}, ' ') AS w FROM benchmark), p AS (SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM b),
  d AS (SELECT doc_id, string_split({_BARE}, ' ') AS w FROM documents), g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM d)
  SELECT doc_id, phrase AS value FROM g SEMI JOIN p USING (phrase)""")
def benchmark_pairs_of_words(spark, folder):
    """Every two words of a benchmark item that documents have next to each other; one automaton, one pass over the documents."""
    bare = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    words = table(spark, folder, "benchmark").select(F.split(bare, " ").alias("w")).where("size(w) > 1")
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))).alias("value")).distinct()
    return phrases.hits(table(spark, folder, "documents").select("doc_id", bare.alias("text")), "doc_id", ["text"], pairs.select("value", F.col("value").alias("phrase")))


# ------------------------------------------------------------------------------------------------------ curated tables

def makers(spark, folder) -> DataFrame:
    """Suppliers as a curated table: a name and one alias each."""
    none = F.lit(None).cast("long")
    return table(spark, folder, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("alias "), F.col("s_nationkey").cast("string"))).alias("aliases"), F.lit("approved").alias("status"), none.alias("merged_into"))


def chains(spark, folder) -> DataFrame:
    """Suppliers merged into the next one, in chains of ten."""
    keys = table(spark, folder, "supplier").select(F.col("s_suppkey").cast("long").alias("winner"))
    return keys.where("winner % 10 <> 0").select((F.col("winner") - 1).alias("loser"), "winner").join(keys.withColumnRenamed("winner", "loser"), "loser", "left_semi")


_CHAIN_SQL = """s AS (SELECT s_suppkey::BIGINT AS key, s_name AS name, 'alias ' || s_nationkey AS alias FROM supplier), m AS (SELECT *, key // 10 AS chain, key % 10 <> 9 AND key + 1 IN (SELECT key FROM s) AS lost FROM s),
  a AS (SELECT m.key, list_sort(list_distinct(list(m.alias) || flatten(list([o.name, o.alias]) FILTER (o.key IS NOT NULL)))) AS aliases FROM m LEFT JOIN m o ON o.chain = m.chain AND o.key < m.key GROUP BY m.key),
  r AS (SELECT chain, max(key) AS root FROM m GROUP BY chain)"""


@query(f"""WITH {_CHAIN_SQL} SELECT key, CASE WHEN lost THEN 'merged' ELSE 'approved' END AS status, CASE WHEN lost THEN key + 1 END AS merged_into, root, array_to_string(coalesce(aliases, [alias]), ',') AS aliases
  FROM m JOIN r USING (chain) LEFT JOIN a USING (key)""")
def merge_chains(spark, folder):
    """Chains of merges: each row takes what was merged into it, and every row's end is found by pointer doubling."""
    start = makers(spark, folder)
    after, _ = curation.merged(start, chains(spark, folder), 1)
    after = cut(after, "makers")
    ends = curation.resolved(after.select("key", F.col("key").alias("root")), after, "root")
    return after.join(ends, "key").select("key", "status", "merged_into", "root", F.array_join(F.array_sort("aliases"), ",").alias("aliases"))


@query("""SELECT s_suppkey::BIGINT AS loser, CASE s_suppkey % 6 WHEN 0 THEN s_suppkey WHEN 1 THEN s_suppkey + 1 WHEN 2 THEN s_suppkey - 1 WHEN 3 THEN s_suppkey - 2 WHEN 4 THEN s_suppkey + 1000000 ELSE s_suppkey - 5 END::BIGINT AS winner,
  CASE s_suppkey % 6 WHEN 0 THEN 'self' WHEN 1 THEN CASE WHEN s_suppkey = (SELECT max(s_suppkey) FROM supplier) THEN 'unknown' ELSE 'cycle' END WHEN 2 THEN 'cycle' WHEN 3 THEN CASE WHEN s_suppkey - 1 > (SELECT max(s_suppkey) FROM supplier) THEN 'ok' ELSE 'cycle' END WHEN 4 THEN 'unknown' ELSE 'gone' END AS verdict FROM supplier""")
def merge_verdicts(spark, folder):
    """Merges that are refused: into oneself, in a circle or into one, into what is not there or was merged away."""
    key = F.col("key")
    rows = makers(spark, folder).withColumn("status", F.when(key % 6 == 0, "merged").otherwise("approved"))
    winner = F.when(key % 6 == 0, key).when(key % 6 == 1, key + 1).when(key % 6 == 2, key - 1).when(key % 6 == 3, key - 2).when(key % 6 == 4, key + 1_000_000).otherwise(key - 5)
    return curation.judged(rows, rows.select(key.alias("loser"), winner.alias("winner")))


@query("SELECT s_suppkey::BIGINT AS key, s_name AS name, 'alias ' || s_nationkey AS aliases, 'approved' AS status, CAST(NULL AS BIGINT) AS merged_into FROM supplier")
def unmerge_restores(spark, folder):
    """All chains merged and taken back: the table is as before."""
    start = makers(spark, folder)
    after, record = curation.merged(start, chains(spark, folder), 1)
    back, _ = curation.unmerged(after, record, record.select(F.col("loser").alias("key")))
    return back.select("key", "name", F.array_join("aliases", ",").alias("aliases"), "status", "merged_into")


_SYNC_SQL = """l AS (SELECT s_suppkey::BIGINT AS key, s_name AS name, s_nationkey AS land FROM supplier WHERE s_suppkey % 7 <> 0),
  n AS (SELECT s_suppkey::BIGINT AS key, CASE WHEN s_suppkey % 3 = 0 THEN 'file ' || s_name ELSE s_name END AS name, CASE WHEN s_suppkey % 4 = 0 THEN 99 ELSE s_nationkey END AS land FROM supplier WHERE s_suppkey % 11 <> 0),
  c AS (SELECT s_suppkey::BIGINT AS key, CASE WHEN s_suppkey % 5 = 0 THEN 'mine ' || s_name ELSE s_name END AS name, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_nationkey END AS land FROM supplier WHERE s_suppkey % 13 <> 0),
  j AS (SELECT s_suppkey::BIGINT AS key, l.key IS NOT NULL AS was, n.key IS NOT NULL AS ships, c.key IS NOT NULL AS here, l.name AS ln, n.name AS nn, c.name AS cn, l.land AS ll, n.land AS nl, c.land AS cl
        FROM supplier LEFT JOIN l ON l.key = s_suppkey LEFT JOIN n ON n.key = s_suppkey LEFT JOIN c ON c.key = s_suppkey WHERE l.key IS NOT NULL OR n.key IS NOT NULL OR c.key IS NOT NULL),
  f AS (SELECT *, ships AND here AND nn IS DISTINCT FROM cn AND CASE WHEN was THEN cn IS NOT DISTINCT FROM ln ELSE cn IS NULL END AS tn, ships AND here AND nl IS DISTINCT FROM cl AND CASE WHEN was THEN cl IS NOT DISTINCT FROM ll ELSE cl IS NULL END AS tl FROM j),
  g AS (SELECT *, ships AND here AND nn IS DISTINCT FROM cn AND NOT tn AND CASE WHEN was THEN nn IS DISTINCT FROM ln ELSE nn IS NOT NULL END AS xn, ships AND here AND nl IS DISTINCT FROM cl AND NOT tl AND CASE WHEN was THEN nl IS DISTINCT FROM ll ELSE nl IS NOT NULL END AS xl FROM f),
  p AS (SELECT *, CASE WHEN ships AND NOT here THEN CASE WHEN NOT was OR nn IS DISTINCT FROM ln OR nl IS DISTINCT FROM ll THEN 'added' ELSE 'absent' END
      WHEN here AND NOT ships THEN CASE WHEN was AND cn IS NOT DISTINCT FROM ln AND cl IS NOT DISTINCT FROM ll THEN 'deleted' WHEN was THEN 'orphan' ELSE 'same' END
      WHEN here AND ships THEN CASE WHEN tn OR tl THEN 'updated' ELSE 'same' END ELSE 'absent' END AS action FROM g)"""


def _three(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What shipped before, the new file, and the table edited in between."""
    supplier, key = table(spark, folder, "supplier"), F.col("s_suppkey")
    rows = lambda keep, name, land: supplier.where(keep).select(key.cast("long").alias("key"), name.alias("name"), land.cast("int").alias("land"))
    name, land = F.col("s_name"), F.col("s_nationkey")
    last = rows(key % 7 != 0, name, land)
    new = rows(key % 11 != 0, F.when(key % 3 == 0, F.concat(F.lit("file "), name)).otherwise(name), F.when(key % 4 == 0, 99).otherwise(land))
    here = rows(key % 13 != 0, F.when(key % 5 == 0, F.concat(F.lit("mine "), name)).otherwise(name), F.when(key % 10 != 0, land))
    return last, new, here


@query(f"""WITH {_SYNC_SQL} SELECT key, action, CASE WHEN tn AND tl THEN 'name,land' WHEN tn THEN 'name' WHEN tl THEN 'land' ELSE '' END AS changed, CASE WHEN xn AND xl THEN 'name,land' WHEN xn THEN 'name' WHEN xl THEN 'land' ELSE '' END AS conflicts,
  CASE WHEN action = 'added' THEN nn WHEN action = 'deleted' THEN NULL WHEN tn THEN nn ELSE cn END AS name, CASE WHEN action = 'added' THEN nl WHEN action = 'deleted' THEN NULL WHEN tl THEN nl ELSE cl END::INTEGER AS land FROM p""")
def sync_plan(spark, folder):
    """A shipped file into a table that was edited: field by field, with conflicts, orphans and prunes."""
    plan = curation.reconciled(*_three(spark, folder), prune=True)
    return plan.select("key", "action", F.array_join("changed", ",").alias("changed"), F.array_join("conflicts", ",").alias("conflicts"), "after.name", "after.land")


@query(f"WITH {_SYNC_SQL} SELECT key, cn AS name, cl::INTEGER AS land FROM j WHERE here")
def sync_undone(spark, folder):
    """A sync and its undo by the events: the edited table again."""
    plan = cut(curation.reconciled(*_three(spark, folder), prune=True), "plan")
    return curation.undone(curation.synced(plan), curation.sync_events(plan, 1))


# ------------------------------------------------------------------------------------------------------ streams, state

@query("""WITH runs AS (SELECT user_id % 50 AS source, epoch_us(ts) // 1000 AS at_ms, event_id AS seq, event_type = 'error' AS failed FROM events),
  s AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE -1 END) OVER w AS total FROM runs WINDOW w AS (PARTITION BY source ORDER BY at_ms, seq ROWS UNBOUNDED PRECEDING)),
  h AS (SELECT source, at_ms, seq, (total - least(0, min(total) OVER (PARTITION BY source ORDER BY at_ms, seq ROWS UNBOUNDED PRECEDING)))::BIGINT AS held, lead(at_ms) OVER (PARTITION BY source ORDER BY at_ms, seq) AS next FROM s),
  u AS (SELECT *, CASE WHEN held > 0 THEN least(60.0 * pow(2.0, held - 1), 3600.0) ELSE 0.0 END::DOUBLE AS wait FROM h), v AS (SELECT *, at_ms + (wait * 1000)::BIGINT AS until FROM u)
  SELECT source, at_ms, seq, 'held' AS kind, held, wait FROM v
  UNION ALL SELECT source, until, seq, 'released', held, 0.0 FROM v WHERE held > 0 AND (next >= until OR next IS NULL AND until <= (SELECT max(at_ms) - 1000 FROM runs))""")
def cooldown_stream(spark, folder):
    """Refusals held against each source and the ends of its waits, by a stream with state and event-time timers over the event files."""
    runs = spark.readStream.schema(table(spark, folder, "events").schema).parquet(f"{folder}/event[s].parquet")
    rows = runs.select((F.col("user_id") % 50).alias("source"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"))
    return stateful.run_cooldown(spark, rows, own_path(spark, "cooldown"))


_NEWS_SQL = """n AS (SELECT user_id % 20 AS reader, user_id AS item, event_type AS told, min(event_id % 2) AS batch FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY batch, reader ORDER BY item, told) AS place, count(*) OVER (PARTITION BY batch, reader) AS items FROM n)"""


@query(f"""WITH {_NEWS_SQL} SELECT batch, reader, any_value(items) AS items, any_value(items) || CASE WHEN any_value(items) = 1 THEN ' piece of news' ELSE ' pieces of news' END AS subject,
  string_agg(told || ': item ' || item || ' for $' || item || '.50', chr(10) ORDER BY place) FILTER (place <= 20) || CASE WHEN any_value(items) > 20 THEN chr(10) || 'and ' || (any_value(items) - 20) || ' more' ELSE '' END AS body FROM k GROUP BY batch, reader""")
def outbox_messages(spark, folder):
    """News in two batches, the first of which runs twice and the second once more after the third has seen nothing new: each piece is in one message."""
    events = table(spark, folder, "events")
    item = F.col("user_id")
    news = lambda rows: rows.select((item % 20).alias("reader"), item.alias("item"), F.col("event_type").alias("told"), F.concat(F.lit("item "), item.cast("string")).alias("title"), (item + 0.5).alias("price"))
    path = own_path(spark, "outbox")
    sink = outbox.outbox(path)
    for number, rows in ((0, events.where("event_id % 2 = 0")), (0, events.where("event_id % 2 = 0")), (1, events), (1, events)):
        sink(news(rows), number)
    return outbox.messages(spark, path).select("batch", "reader", "items", "subject", "body")


@query(f"""WITH {MERGE_SQL} SELECT coalesce(k.item, r.item) AS item, coalesce(r.title, k.title) AS title, coalesce(r.price, k.price) AS price, CASE WHEN r.item IS NOT NULL THEN r.sold ELSE k.sold END AS sold, r.item IS NOT NULL OR coalesce(k.active, false) AS active,
  CASE WHEN k.item IS NULL THEN 'new' WHEN r.item IS NULL THEN 'unseen' WHEN NOT k.active THEN 'reactivated' WHEN r.sold AND NOT k.sold THEN 'sold' WHEN NOT r.sold AND k.sold THEN 'restocked'
       WHEN round_even(r.price * 100, 0) <> round_even(k.price * 100, 0) THEN 'repriced' ELSE 'same' END AS change FROM k FULL JOIN r ON k.item = r.item""")
def bucketed_merge(spark, folder):
    """A run merged into state that lies in buckets; only the run's rows are shuffled."""
    changes = price_changes(spark, folder)
    order, item = F.struct("at", "seq"), F.col("item")
    none = lambda kind: F.lit(None).cast(kind)
    known = changes.where("item % 5 <> 0").groupBy("item").agg(F.min_by("type", order).alias("title"), F.min_by("price", order).alias("price"), F.min("at").cast("timestamp_ntz").alias("first_seen"))
    known = known.select("item", "title", "price", none("double").alias("previous_price"), (item % 3 == 0).alias("sold"), (item % 4 != 0).alias("active"), "first_seen", F.col("first_seen").alias("last_seen"), *[none("timestamp_ntz").alias(c) for c in ("sold_at", "restocked_at", "price_changed_at")], F.lit("new").alias("change"))
    read = changes.where("item % 7 <> 0").groupBy("item").agg(F.max_by("type", order).alias("t"), F.max_by("price", order).alias("price")).select("item", F.when(item % 2 == 0, F.col("t")).alias("title"), "price", (item % 6 == 0).alias("sold"))
    state = StateTable(spark, f"larkspur_state_{uuid.uuid4().hex[:12]}", "item", 16)
    state.write(known)
    state.apply(read, EVENTS_NOW)
    return state.read().select("item", "title", "price", "sold", "active", "change")


# ------------------------------------------------------------------------------------------------------ serials, layout

_EVIDENCE_SQL = """e AS (SELECT p_brand AS model, p_partkey * 10 + p_size % 10 AS number, (1900 + p_partkey // 400 + CASE WHEN p_size % 17 = 0 THEN 9 ELSE 0 END)::INTEGER AS first, (1900 + p_partkey // 400 + CASE WHEN p_size % 17 = 0 THEN 9 ELSE 0 END + p_size % 2)::INTEGER AS last, p_partkey AS item FROM part),
  w AS (SELECT *, lag(first) OVER o AS bf, lead(last) OVER o AS al FROM e WINDOW o AS (PARTITION BY model ORDER BY number, first, last, item)),
  k AS (SELECT model, number, first, last, item FROM w WHERE NOT coalesce(bf <= al AND (first < bf - 1 OR first > al + 1), false)),
  t AS (SELECT *, lag(first) OVER (PARTITION BY model ORDER BY number, first, last, item) AS bf FROM k),
  s AS (SELECT model FROM t GROUP BY 1 HAVING count(*) >= 5 AND count(*) FILTER (last < bf) <= 0.1 * (count(*) - 1)),
  c AS (SELECT * FROM k WHERE model IN (SELECT model FROM s))"""


def evidence(spark, folder) -> DataFrame:
    """Parts as listings that state a number and their years: of every model they rise, but for some that are told nine years late."""
    year = (1900 + F.floor(F.col("p_partkey") / 400) + F.when(F.col("p_size") % 17 == 0, 9).otherwise(0)).cast("int")
    return table(spark, folder, "part").select(F.col("p_brand").alias("model"), (F.col("p_partkey") * 10 + F.col("p_size") % 10).alias("number"), year.alias("first"), (year + F.col("p_size") % 2).cast("int").alias("last"), F.col("p_partkey").alias("item"))


@query(f"WITH {_EVIDENCE_SQL} SELECT model, number, first, last, item FROM k")
def steady_evidence(spark, folder):
    """Evidence without what both neighbours contradict, unless these run backward themselves."""
    return serials.steady(evidence(spark, folder), ["model"])


@query(f"""WITH {_EVIDENCE_SQL}, p AS (SELECT p_brand AS model, p_partkey AS point, p_partkey * 10 - p_size AS low, p_partkey * 10 - p_size + CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 9 ELSE 99 END AS high FROM part),
  b AS (SELECT point, max(row(number, first, last)) AS x FROM p JOIN c ON p.model = c.model AND number <= low GROUP BY 1), a AS (SELECT point, max(row(-number, last, first)) AS x FROM p JOIN c ON p.model = c.model AND number >= high GROUP BY 1),
  m AS (SELECT p.model, p.point, least(b.x[2], a.x[3])::INTEGER AS first, greatest(b.x[3], a.x[2])::INTEGER AS last, b.x[1]::BIGINT AS below, -a.x[1]::BIGINT AS above FROM p JOIN b USING (point) JOIN a USING (point) WHERE b.x[2] <= a.x[2])
  SELECT * FROM m WHERE last - first <= 2""")
def serial_places(spark, folder):
    """The years of serials that lie, wholly or but for their last digits, between listings of their model."""
    low = F.col("p_partkey") * 10 - F.col("p_size")
    hidden = F.when(F.col("p_size") % 3 == 0, 0).when(F.col("p_size") % 3 == 1, 9).otherwise(99)
    points = table(spark, folder, "part").select(F.col("p_brand").alias("model"), F.col("p_partkey").alias("point"), low.alias("low"), (low + hidden).alias("high"))
    return serials.placed(points, evidence(spark, folder), ["model"])


def boxes(spark, folder) -> DataFrame:
    """Line items as boxes on their order's page: placed by part and size of the order, headings first in their stripe."""
    line, key = table(spark, folder, "lineitem"), F.col("l_partkey")
    x, y = (key % 4) * 60 + F.col("l_suppkey") % 7, (F.col("l_suppkey") % 5) * 40 + F.col("l_quantity") % 13
    numbered = line.select(F.col("l_orderkey").alias("page"), F.xxhash64("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("box"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 10 + key % 50).cast("double").alias("x1"), (y + 6).cast("double").alias("y1"), (F.col("l_linenumber") == 1).alias("heading"))
    return numbered.dropDuplicates(["page", "box"])


@query()
def page_panels(spark, folder):
    """Every order's boxes cut into panels along the gaps of the page, with the line and the heading of each box. Tested against cutting by hand."""
    placed = cut(layout.lines(layout.panels(cut(boxes(spark, folder), "boxes"), 8.0, 5.0)), "panels")  # both are read several times
    return placed.join(layout.heading_above(placed, "heading"), ["page", "box"], "left").select("page", "box", "panel", "line", "under")
