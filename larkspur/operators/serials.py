"""Placing a serial number in time between listings that state both a number and their years.

Evidence is sorted along its numbers in cells of a fixed width: neighbours, running maxima and counts are found inside the
cells first, and what crosses an edge comes from one summary row of each cell. A model with a very large share of all
evidence is thus sorted by many tasks; what a single one sees of it is one row for each cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of one cell.
CELL = 10_000
#: A model is placed from so much evidence on, if at most this share of its neighbours runs backward, over at most so many years.
LEAST_EVIDENCE, MOST_BACKWARD, MOST_YEARS = 5, 0.1, 2


def _celled(rows: DataFrame, at: Column, cell: int) -> DataFrame:
    return rows.withColumn("_cell", F.floor(at / cell))


def neighbours(evidence: DataFrame, keys: list[str], cell: int = CELL) -> DataFrame:
    """``evidence`` (keys, number, first, last, item) with ``before`` and ``after``: the structs (number, first, last, item) next to it."""
    rows = _celled(evidence, F.col("number"), cell).withColumn("_own", F.struct("number", "first", "last", "item"))
    inside = Window.partitionBy(*keys, "_cell").orderBy("_own")
    ends = rows.groupBy(*keys, "_cell").agg(F.min("_own").alias("_min"), F.max("_own").alias("_max"))
    across = Window.partitionBy(*keys).orderBy("_cell")
    edges = ends.select(*keys, "_cell", F.lag("_max").over(across).alias("_left"), F.lead("_min").over(across).alias("_right"))
    out = rows.withColumns({"before": F.lag("_own").over(inside), "after": F.lead("_own").over(inside)}).join(edges, [*keys, "_cell"])
    return out.withColumns({"before": F.coalesce("before", "_left"), "after": F.coalesce("after", "_right")}).drop("_cell", "_own", "_left", "_right")


def steady(evidence: DataFrame, keys: list[str], slack: int = 1, cell: int = CELL) -> DataFrame:
    """Evidence without the points that both neighbours contradict.

    A point is contradicted where its first year lies outside the span from the one before (its first year) to the one
    after (its last), widened by ``slack``. Neighbours that themselves run backward contradict nobody.
    """
    rows = neighbours(evidence, keys, cell)
    ordered = F.col("before.first") <= F.col("after.last")
    outside = ~F.col("first").between(F.col("before.first") - slack, F.col("after.last") + slack)
    return rows.where(~F.coalesce(ordered & outside, F.lit(False))).drop("before", "after")


def straight(evidence: DataFrame, keys: list[str], least: int = LEAST_EVIDENCE, backward: float = MOST_BACKWARD, cell: int = CELL) -> DataFrame:
    """The keys whose numbers rise with the years: enough evidence, and few neighbours of which the later one ends before the earlier began."""
    counts = neighbours(evidence, keys, cell).groupBy(*keys).agg(F.count("*").alias("n"), F.count(F.when(F.col("last") < F.col("before.first"), 1)).alias("turns"))
    return counts.where((F.col("n") >= least) & (F.col("turns") <= (F.col("n") - 1) * backward)).select(*keys)


def _nearest(points: DataFrame, evidence: DataFrame, keys: list[str], at: Column, order: Column, cell: int) -> DataFrame:
    """``keys, point`` and ``found``: the largest ``order`` of the evidence at the point's place or before it."""
    kind = evidence.select(order.alias("o")).schema["o"].dataType
    known = evidence.select(*keys, F.lit(None).cast(points.schema["point"].dataType).alias("point"), order["place"].alias("_at"), order.alias("_found"))
    asked = points.select(*keys, "point", at.alias("_at"), F.lit(None).cast(kind).alias("_found"))
    both = _celled(known.union(asked), F.col("_at"), cell)
    inside = Window.partitionBy(*keys, "_cell").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = both.groupBy(*keys, "_cell").agg(F.max("_found").alias("_max"))
    across = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    edges = ends.select(*keys, "_cell", F.max("_max").over(across).alias("_left"))
    asked = both.withColumn("_found", F.max("_found").over(inside)).where("point is not null").join(edges, [*keys, "_cell"])
    return asked.select(*keys, "point", F.coalesce("_found", "_left").alias("found"))


def placed(points: DataFrame, evidence: DataFrame, keys: list[str], slack: int = 1, least: int = LEAST_EVIDENCE, backward: float = MOST_BACKWARD, years: int = MOST_YEARS, cell: int = CELL) -> DataFrame:
    """``keys, point, first, last, below, above`` of the points that can be placed.

    ``points``: keys, point, low, high (the same number where a serial is wholly legible; a partly hidden one has to lie
    between its neighbours as a whole). ``evidence``: keys, number, first, last, item; the keys are those that serials
    share (model, maker, prefix), and a null among them matches nothing.

    Steps: contradicted evidence goes; only models whose numbers run straight are placed; the nearest evidence at or
    below ``low`` and at or above ``high`` has to agree, and their years together to span at most ``years``.
    """
    whole = evidence.where(" and ".join(f"{c} is not null" for c in [*keys, "number", "first", "last"]))
    calm = steady(whole, keys, slack, cell)
    calm = calm.join(straight(calm, keys, least, backward, cell), keys, "left_semi")
    below = _nearest(points, calm, keys, F.col("low"), F.struct(F.col("number").alias("place"), "first", "last"), cell).withColumnRenamed("found", "_b")
    # the mirror image: the smallest number, and of equals the one that ends last
    above = _nearest(points, calm, keys, -F.col("high"), F.struct((-F.col("number")).alias("place"), "last", "first"), cell).withColumnRenamed("found", "_a")
    met = below.join(above, [*keys, "point"]).where("_b is not null and _a is not null and _b.first <= _a.last")
    first, last = F.least("_b.first", "_a.first"), F.greatest("_b.last", "_a.last")
    return met.select(*keys, "point", first.alias("first"), last.alias("last"), F.col("_b.place").alias("below"), (-F.col("_a.place")).alias("above")).where(F.col("last") - F.col("first") <= years)
