"""MinHash near-duplicates by tensored banding.

Texts are linked where their sets of distinct shingles have a Jaccard similarity of at least the limit. A set gets a few
small collections of minima of its shingle hashes, and every pair of collections makes the key of one table: with 8
collections of 2 minima, 16 minima make the keys of 28 tables with 4 minima each, which one by one would take 112. Sets
that share a key are candidates. Two sets of similarity 0.8 agree in a collection with 0.64 and share some key with 0.996.

A key that many sets share is not expanded into pairs: each set meets one centre there, and candidates are verified on
the sets themselves, so a group of thousands of near copies costs a number of comparisons linear in it. What a centre or
the 0.4 % lose is found by an exact search between the components that are left: two sets of the similarity share a
shingle in a prefix of theirs, rare shingles first (:mod:`larkspur.llm.simhash`, whose sets, verification and prefixes
are used), so that no link is lost and no pair is linked by its minima alone.

Copies of one set are collapsed before. Shingles are told apart by 64-bit hashes, sets by a 64-bit hash of these.

Defined cases: null or wordless text has an empty set and is linked with nothing, also not with another empty one; a text
with fewer words than a shingle is one shingle; repeated rows are returned each; a null doc_id keeps its row, never names a
component (null if no other document is in it) and is not ``kept``; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .simhash import distinct_sets, named_sets, set_rows, similar_links, stars

#: Collections of each set, minima of each collection; orders of which the centres of all tables are the first.
COLLECTIONS, MINIMA, ORDERS = 8, 2, 4
NAMES = [f"g{k}" for k in range(COLLECTIONS)]
#: An odd factor for each minimum: one more order of the 64-bit hashes.
FACTORS = np.random.default_rng(20240512).integers(1, 1 << 63, size=COLLECTIONS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def collections(hashes: np.ndarray, number: np.ndarray) -> list[np.ndarray]:
    """One 64-bit value for each collection of each set: its minima, one after the other, hashed together. Empty sets get zeros."""
    has = number > 0
    begin = (np.cumsum(number) - number)[has]
    out = []
    for k in range(COLLECTIONS):
        value = np.zeros(len(number), np.uint64)
        if len(begin):
            for factor in FACTORS[k * MINIMA : (k + 1) * MINIMA]:
                value[has] = value[has] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((hashes ^ (hashes >> np.uint64(29))) * factor, begin)
        out.append(value)
    return out


def tensored(sets: DataFrame, width: int) -> DataFrame:
    """``a, b``: sets (``id, g0 .. g7``) that share the key of some table, each with one centre there."""
    keys = [F.xxhash64(F.lit(i), F.lit(j), f"g{i}", f"g{j}") for i, j in combinations(range(COLLECTIONS), 2)]
    return stars(sets.select("id", F.explode(F.array(*keys)).alias("anchor")), ORDERS)


def classes(docs: DataFrame, width: int = 4, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row: its set's size, the smallest doc_id reachable over links, and whether that is the row's own."""
    rows = set_rows(docs, width, doc_id, text, (NAMES, collections))
    sizes = cut(rows.select("doc_id", F.col("size").cast("long").alias("n_shingles"), "id"), "sets")
    sets = distinct_sets(rows.where("size > 0"))
    named = named_sets(sets, similar_links(sets, width, similarity, tensored)).select("id", "component_id")
    out = sizes.join(named, "id", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
