"""Connected components by alternating stars, each round a few joins and aggregates.

Every round replaces each vertex's links by links to its smallest neighbour, first for the larger neighbours
(large star), then for the smaller ones (small star); the number of rounds grows with the logarithm of the
longest chain. Minima are pre-aggregated before the shuffle, written and joined back: both sides of the join are
scans with a shuffle right above them, which is what Spark's skew-join handling splits, so a vertex with very many
neighbours is never gathered into one group. Each round is written to the shared folder, and only two numbers reach
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop


def _minima(edges: DataFrame) -> DataFrame:
    return cut(edges.groupBy("u").agg(F.min("v").alias("m")), "links")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links of the written table ``edges`` (``u, v``, u > v), each in both directions, led to the smallest neighbour."""
    turned = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    minima = _minima(edges.select(F.explode(turned).alias("x")).select("x.*"))
    # of the two directions only the one with v > u gives a link
    met = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(minima, "u")
    out = cut(met.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "links")
    drop(edges.sparkSession, minima)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    minima = _minima(edges)
    links = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    out = edges.join(minima, "u").select(F.explode(links).alias("x")).select("x.u", "x.v").where("u != v").distinct()
    out = cut(out, "links")
    drop(edges.sparkSession, minima)
    return out


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``id, label`` of every vertex that has a link in ``links`` (columns a, b of type long); label: the smallest id reachable.

    Links in either direction, repeated links and links of a vertex to itself (which give no row) are fine; links with
    a null are left out; no links give an empty table.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a != b").distinct(), "links")
    state = _state(edges)
    while True:
        larger = _large_star(edges)
        smaller = _small_star(larger)
        drop(links.sparkSession, edges, larger)
        edges, before = smaller, state
        state = _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).union(roots)
