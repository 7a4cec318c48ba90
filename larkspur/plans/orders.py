"""Orders that a plain sort does not give, and the choice of facets that cover a category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def natural(text: Column) -> Column:
    """A key that sorts numbers within a text by their value: ``a9`` before ``a10``; of any number of digits.

    A number is led by the number of its digits without zeros in front, itself led by its own length.
    """
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), 1)
    plain = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    size = lambda p: F.length(plain(p)).cast("string")
    number = lambda p: F.concat(F.lit("0"), F.length(size(p)).cast("string"), size(p), plain(p))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), number(p)).otherwise(p)), "")


def prefix_first(name: Column, start: str) -> list[Column]:
    """What starts with the letters typed, before what only has them."""
    return [F.when(F.lower(name).startswith(start.lower()), 0).otherwise(1).asc(), name.asc()]


def by_list(value: Column, order: list[str]) -> Column:
    """The place of a value in a stated order; others after all of them."""
    place = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(place > 0, place).otherwise(len(order) + 1).cast("int")


def cover(counts: DataFrame, page: int, fine: float = 0.9) -> DataFrame:
    """Which facet values to read a category by, when it is larger than its source shows at once: ``facet, value, n, enough``.

    ``counts``: facet, value, n. Of the facets whose values all fit one page, the one that covers most, with the fewest
    values; without one, all values that fit. ``enough`` says whether the choice covers that share of the largest facet's
    rows. Facets are few, their values may be many: only the facets are ranked in one place.
    """
    sums = counts.groupBy("facet").agg((F.max("n") <= page).alias("_fits"), F.sum("n").alias("_all"), F.sum(F.when(F.col("n") <= page, F.col("n")).otherwise(0)).alias("_covered"), F.count("*").alias("_parts"))
    every = Window.partitionBy(F.lit(0))
    ranked = sums.withColumns({"_place": F.row_number().over(every.orderBy(F.desc("_fits"), F.desc("_all"), "_parts", "facet")), "_some": F.max("_fits").over(every), "_total": F.max("_all").over(every)})
    ranked = ranked.withColumn("_best", F.when(F.col("_some"), F.col("_covered")).otherwise(F.max("_covered").over(every)))
    chosen = ranked.where(~F.col("_some") | (F.col("_place") == 1)).select("facet", (F.col("_best") >= fine * F.col("_total")).alias("enough"))
    return counts.join(chosen, "facet").where(F.col("n") <= page).select("facet", "value", "n", "enough")
