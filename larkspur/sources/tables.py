"""The catalog views over the star-schema tables: listings, price changes, documents with labels, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of few bytes that much is made of, dealt over all cores: by its files alone, a small table is a few tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def listings(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """A line item as an item for sale: its source, model, facets, unit price, and when it came and went.

    With ``columns`` named, only the tables that they come from are joined (every line item has its part, order and supplier).
    """
    line, part = table(spark, folder, "lineitem"), table(spark, folder, "part")
    orders, supplier, nation = (table(spark, folder, n) for n in ("orders", "supplier", "nation"))
    # made before the joins, so that these move a price and two flags instead of what they are made of
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100
    line = line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", price.alias("_price"),
        (F.col("l_linestatus") == "F").alias("_sold"), (F.col("l_returnflag") == "R").alias("_delisted"),
    )
    sold, delisted = F.col("_sold"), F.col("_delisted")
    views = {
        "item": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        "source": F.col("l_suppkey"),
        "model": F.col("l_partkey"),
        "title": F.col("p_name"),
        "brand": F.col("p_brand"),
        "kind": F.col("p_type"),
        "size": F.col("p_size"),
        "country": F.col("n_name"),
        "price": F.col("_price"),
        "first_seen": F.col("o_orderdate"),
        "sold": sold,
        "active": ~delisted,
        "sold_at": F.when(sold, F.col("l_shipdate")),
        "delisted_at": F.when(delisted, F.col("l_shipdate")),
        "grade": F.col("o_orderpriority"),
        "quantity": F.col("l_quantity"),
    }
    wanted = set(columns or views)
    rows = line
    if wanted & {"title", "brand", "kind", "size"}:
        rows = rows.join(part, line.l_partkey == part.p_partkey)
    if wanted & {"first_seen", "grade"}:
        rows = rows.join(orders, line.l_orderkey == orders.o_orderkey)
    if "country" in wanted:
        rows = rows.join(supplier, line.l_suppkey == supplier.s_suppkey).join(nation, supplier.s_nationkey == nation.n_nationkey)
    return rows.select(*[v.alias(k) for k, v in views.items() if k in wanted])


#: The same view in the SQL that the checks run.
LISTINGS_SQL = """
listings AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS item, l_suppkey AS source, l_partkey AS model,
         p_name AS title, p_brand AS brand, p_type AS kind, p_size AS size, n_name AS country,
         floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price, o_orderdate AS first_seen,
         (l_linestatus = 'F') AS sold, NOT (l_returnflag = 'R') AS active,
         CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS sold_at,
         CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS delisted_at, o_orderpriority AS grade, l_quantity AS quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""


def price_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Events as observations of prices: item, seq, at, price, type."""
    events = table(spark, folder, "events")
    return events.select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.col("value").alias("price"), F.col("event_type").alias("type"))


CHANGES_SQL = "changes AS (SELECT user_id AS item, event_id AS seq, ts AS at, value AS price, event_type AS type FROM events)"


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their labels; most have none, so ``quality`` and ``toxic`` have three values."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    return docs.join(table(spark, folder, "labels"), "doc_id", "left")


DOCS_SQL = "docs AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
