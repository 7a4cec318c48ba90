"""Panels and lines out of placed boxes: a page is cut along its empty gaps, again and again, and boxes come under headings.

``boxes``: page, box, x0, y0, x1, y1 (and more). A gap is a stripe across a whole region that no box touches and that is wide
enough; a region is cut at all its gaps of one direction at once, then its parts in the other direction, until no part
has a gap. Each round is a running maximum along the sorted edges of each region, for all regions of all pages together; what
a round leaves uncut in both directions is done, and written tables end the lineage of a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..written import cut

#: Rounds after which a page is taken as it is: each halves a region at least, so only boxes one in another's gap could go on.
ROUNDS = 32


def _split(rows: DataFrame, low: str, high: str, gap: float) -> DataFrame:
    """``rows`` with ``part``, the number of gaps of one direction before a box in its region."""
    region = Window.partitionBy("page", "region").orderBy(low, high, "box")
    reach = F.max(high).over(region.rowsBetween(Window.unboundedPreceding, -1))
    gaps = F.coalesce(F.col(low) - reach >= gap, F.lit(False)).cast("int")
    return rows.withColumn("_cut", gaps).withColumn("part", F.sum("_cut").over(region.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_cut")


def panels(boxes: DataFrame, gap_x: float, gap_y: float) -> DataFrame:
    """``boxes`` with ``panel``, the path of cuts that leads to a box's region: numbers in the order of the page, rows before columns.

    Boxes without a full place are in no panel (null); a box whose ends are the wrong way round is turned.
    """
    placed = F.col("x0").isNotNull() & F.col("x1").isNotNull() & F.col("y0").isNotNull() & F.col("y1").isNotNull()
    rows = boxes.where(placed).select("page", "box", F.least("x0", "x1").alias("a0"), F.greatest("x0", "x1").alias("a1"), F.least("y0", "y1").alias("b0"), F.greatest("y0", "y1").alias("b1"), F.lit("").alias("region"))
    live, done = cut(rows, "layout"), None
    for _ in range(ROUNDS):
        down = _split(live, "b0", "b1", gap_y).withColumn("region", F.concat_ws(".", "region", F.lpad(F.col("part").cast("string"), 4, "0"))).drop("part")
        across = _split(down, "a0", "a1", gap_x)
        name = Window.partitionBy("page", "region")
        both = across.withColumn("_n", F.max("part").over(name)).withColumn("region", F.when(F.col("_n") > 0, F.concat_ws(".", "region", F.lpad(F.col("part").cast("string"), 4, "0"))).otherwise(F.col("region")))
        # cut again where a column appeared: its parts may have gaps of their own; a region without columns has none left
        parts = cut(both.withColumn("_live", F.col("_n") > 0).drop("part", "_n"), "layout")
        ended = parts.where("not _live").drop("_live")
        done = ended if done is None else done.union(ended)
        live = parts.where("_live").drop("_live")
        if not live.limit(1).count():
            break
    else:
        done = done.union(live)
    named = done.select("page", "box", F.expr("substring(region, 2)").alias("panel"))
    return boxes.join(named, ["page", "box"], "left")


def heading_above(boxes: DataFrame, heading: str) -> DataFrame:
    """``page, box, under`` of the boxes that :func:`headed` finds a heading for, and no others."""
    held = boxes.where(F.col("panel").isNotNull())
    top = held.where(F.col(heading)).select("page", "panel", F.col("box").alias("under"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("y1").alias("_y1"))
    rest = held.where(~F.coalesce(F.col(heading), F.lit(False))).select("page", "panel", "box", "x0", "x1", "y0")
    overlap = F.least("x1", "_x1") - F.greatest("x0", "_x0")
    met = rest.join(top, ["page", "panel"]).where((F.col("_y1") <= F.col("y0")) & (overlap > 0))
    return met.groupBy("page", "box").agg(F.max_by("under", F.struct("_y1", overlap.alias("o"), (-F.col("under")).alias("k"))).alias("under"))


def headed(boxes: DataFrame, heading: str) -> DataFrame:
    """Each box that is no heading, with the heading it stands under: ``page, box, under``; null where none is above it.

    ``boxes``: as :func:`panels` gives them, and a boolean column ``heading``. Of the headings of its panel that end above
    the box and overlap it sideways, the lowest counts; of equally low ones that with the larger overlap, then the smaller number.
    """
    rest = boxes.where(F.col("panel").isNotNull() & ~F.coalesce(F.col(heading), F.lit(False)))
    return rest.select("page", "box").join(heading_above(boxes, heading), ["page", "box"], "left")


def lines(boxes: DataFrame, share: float = 0.5) -> DataFrame:
    """``boxes`` with ``line``: boxes of a panel that overlap the running line by ``share`` of their height are one line, from the top down."""
    top = Window.partitionBy("page", "panel").orderBy("y0", "x0", "box")
    reach = F.max("y1").over(top.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(reach - F.col("y0") < share * (F.col("y1") - F.col("y0")), F.lit(True)).cast("int")
    return boxes.withColumn("_new", new).withColumn("line", F.sum("_new").over(top.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")
