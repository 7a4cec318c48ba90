"""Filter interaction audit: what every filter takes, in every order of the filters, by lattice-edge aggregation.

The state after some filters is the subset that has been applied; going on with one more filter is an edge of the lattice of
subsets. Five filters make 80 edges (applied subset, next filter), and each order of the filters is a path of five edges.
What a filter removes depends on the subset before it and not on the order inside it, so documents are summed by edge, and
the 120 orders only pick their 600 steps from the 80 sums of each part.

Documents that fail the same filters contribute alike. They are counted by part, failure bits and labels first (at most
128 rows a part, partial sums before the shuffle), and each such row contributes its count to the 80 edges.

A text that is identical to one with a smaller doc_id fails E. Texts are told apart by SHA-256; equal ones are summed by
part and labels before they meet, with the smallest doc_id of each sum, so a text that a third of all rows have is a few rows.

Defined cases: a null text is the empty one (no words: it fails A only, and E after the first); a null source is the part ''
(together with an empty source); a row with a null doc_id has no label, fails no E and makes no other row fail it; rows of
one doc_id with one text don't repeat each other; each repeated row counts; a doc_id with several labels has a mark if one of
them says so; a label of no document is left out; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The filters by letter: bit k of a document's failures is the k-th letter's.
FILTERS = "ABCDE"
BIT = {name: 1 << k for k, name in enumerate(FILTERS)}
#: Filter A: fewest words. B: distinct words in a hundred words. C: capitals in a hundred characters. D: one of these characters.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 50, 65, 5, "[#$%&*|]"
#: (applied subset, next filter) for each edge of the lattice.
EDGES = [(applied, name) for applied in range(1 << len(FILTERS)) for name in FILTERS if not applied & BIT[name]]


def own_failures(text: Column, words: Column) -> Column:
    """Bits of A to D, which a document fails or not by itself."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = {
        "A": n < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < n.cast("long") * DISTINCT_PERCENT,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * CAPITAL_PERCENT,
        "D": text.rlike(MARKS),
    }
    bits = [F.when(failed, BIT[name]).otherwise(0) for name, failed in fails.items()]
    return sum(bits[1:], bits[0])


def marked(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest, own`` of every row: its part, what tells its text from others, and its failures of A to D."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    return rows.select("doc_id", "part", digest.alias("digest"), own_failures(F.col("text"), F.col("words")).alias("own"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic, n``: the documents by what they fail (bits of FILTERS) and how they are labelled."""
    kinds = ["digest", "part", "own", "good", "toxic"]
    says = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = marked(docs.where("doc_id is not null")).join(says, "doc_id", "left").fillna(False, ["good", "toxic"])
    known = known.groupBy("doc_id", *kinds).agg(F.count("*").alias("n"))
    nameless = marked(docs.where("doc_id is null")).withColumns({"good": F.lit(False), "toxic": F.lit(False)}).groupBy(*kinds).agg(F.count("*").alias("n"))
    nameless = nameless.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), *kinds, "n")

    named = F.col("doc_id").isNotNull()
    alike = known.union(nameless).groupBy(*kinds).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(named, F.col("n"))), F.lit(0)).alias("n_named"),
        F.min(F.when(named, F.struct("doc_id", "n"))).alias("first"),
    )
    # as many rows of a text as there are parts and labels
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    repeated = F.col("n_named") - F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    counted = alike.withColumn("smallest", smallest).withColumn("repeated", repeated)
    both = F.array(F.struct(F.col("own").alias("mask"), (F.col("n") - F.col("repeated")).alias("n")), F.struct((F.col("own") + BIT["E"]).alias("mask"), F.col("repeated").alias("n")))
    rows = counted.select("part", "good", "toxic", F.explode(both).alias("x"))
    return rows.groupBy("part", "x.mask", "good", "toxic").agg(F.sum("x.n").alias("n"))


def edge_sums(failed: DataFrame) -> DataFrame:
    """``part, applied, filter`` and, of each edge of the lattice, its sums; 80 rows a part."""
    edges = F.array(*[F.struct(F.lit(applied).alias("applied"), F.lit(name).alias("filter"), F.lit(BIT[name]).alias("bit")) for applied, name in EDGES])
    rows = failed.select("*", F.explode(edges).alias("e")).select("*", "e.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("applied")) != 0
    cases = {
        "kept": ~fails & ~gone,
        "removed": fails & ~gone,
        "redundant": fails & gone,
        "unique_fails": F.col("mask") == F.col("bit"),
        "good_lost": fails & ~gone & F.col("good"),
        "toxic_lost": fails & ~gone & F.col("toxic"),
    }
    sums = [F.sum(F.when(case, F.col("n")).otherwise(0)).alias(name) for name, case in cases.items()]
    return rows.groupBy("part", "applied", "filter").agg(*sums)


def orders_through(applied: int) -> int:
    """How many orders of the filters go along an edge: those of the filters before it times those of the filters after it."""
    before = applied.bit_count()
    return math.factorial(before) * math.factorial(len(FILTERS) - 1 - before)


def steps(spark: SparkSession) -> DataFrame:
    """``filter_order, step, applied, filter``: the 600 steps of the 120 orders."""
    rows = [("".join(order), k + 1, sum(BIT[x] for x in order[:k]), order[k]) for order in permutations(FILTERS) for k in range(len(FILTERS))]
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, filter string")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each step of each order of the filters does to the documents of each source, 600 rows a source.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.
    """
    sums = edge_sums(failures(docs, labels))
    paths = F.element_at(F.create_map(*[x for applied in range(1 << len(FILTERS)) for x in (F.lit(applied), F.lit(orders_through(applied) if applied.bit_count() < len(FILTERS) else 0))]), F.col("applied"))
    shapley = F.sum(F.col("removed") * paths).over(Window.partitionBy("part", "filter"))  # 16 rows
    of = sums.withColumn("shapley", shapley).join(F.broadcast(steps(docs.sparkSession)), ["applied", "filter"])  # 600 rows, always
    return of.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])
