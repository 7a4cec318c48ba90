"""Facet counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_of, holds, is_unknown

UNKNOWN = "Unknown"


def tally(rows: DataFrame, facet: str, limit: int = 5000, kept: list[str] = ()) -> DataFrame:
    """Values by falling count, up to a limit, with the chosen ones kept beyond it; rows without a value come last."""
    value = F.col(facet).cast("string")
    counts = rows.groupBy(F.when(~is_unknown(value), value).alias("value")).agg(F.count("*").alias("n"))
    known = counts.where("value is not null")
    top = known.orderBy(F.desc("n"), "value").limit(limit)
    if kept:
        top = top.union(known.where(F.col("value").isin(list(kept)))).distinct()
    return top.union(counts.where("value is null").select(F.lit(UNKNOWN), "n"))


def exclusive(rows: DataFrame, clauses: dict[str, Column], facets: list[str]) -> DataFrame:
    """``facet, value, n`` for several facets in one scan, each counted over every clause but its own.

    The clauses become flags once; each row then says for each facet whether all others hold, and one
    aggregate with partial sums counts them all.
    """
    flags = {k: f"_c{i}" for i, k in enumerate(clauses)}
    flagged = rows.select(*[F.col(f).cast("string").alias(f) for f in facets], *[holds(c).alias(flags[k]) for k, c in clauses.items()])
    cells = [F.struct(F.lit(f).alias("facet"), F.when(~is_unknown(F.col(f)), F.col(f)).otherwise(UNKNOWN).alias("value"), all_of([F.col(n) for k, n in flags.items() if k != f]).alias("counts")) for f in facets]
    long = flagged.select(F.explode(F.array(*cells)).alias("x")).where("x.counts")
    return long.groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def conditional(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """``name, n`` of many conditions in one pass."""
    one = rows.agg(*[F.count_if(c).alias(k) for k, c in conditions.items()])
    cells = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("n")) for k in conditions])
    return one.select(F.explode(cells).alias("x")).select("x.name", "x.n")


def price_histogram(rows: DataFrame, value: str = "price", buckets: int = 24) -> DataFrame:
    """Counts in log-spaced buckets from the lowest to the highest value, the last one closed; one bucket if they are equal.

    The ends are one aggregate (two numbers); the rows then find their bucket by arithmetic, corrected against the edges.
    """
    priced = rows.where(F.col(value) > 0)
    low, high = priced.agg(F.min(value), F.max(value)).first()
    if low is None or low == high:
        return priced.select(F.lit(0).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    step = math.log(high / low) / buckets
    edges = F.array(*[F.lit(float(low)), *[F.lit(low * math.exp(step * i)) for i in range(1, buckets)], F.lit(float(high))])
    guess = F.greatest(F.lit(0), F.least(F.floor(F.log(F.col(value) / low) / step).cast("int"), F.lit(buckets - 1)))
    under, over = F.col(value) < F.get(edges, F.col("i")), (F.col("i") < buckets - 1) & (F.col(value) >= F.get(edges, F.col("i") + 1))
    placed = priced.select(value, guess.alias("i"))
    exact = F.when(under, F.col("i") - 1).when(over, F.col("i") + 1).otherwise(F.col("i"))
    return placed.select(exact.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
