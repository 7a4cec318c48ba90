"""Order statistics of groups, without gathering a group.

Values are counted first (with partial sums before the shuffle), so that what has to meet is one row for each distinct
value. Where values hardly repeat (durations, ratios), they are cut into ranges as well: the ranges' totals tell which
range holds a rank, and only that range is sorted. A range is a small step of the logarithm, whose number in a group is
bounded by the span of the values and not by their count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges for each factor e between two values.
STEPS = 1024

Index = Callable[[Column], Column]


def _range(value: Column) -> Column:
    """A number that never falls where the value rises: the sign, and the step of the size's logarithm."""
    step = F.floor(F.log(F.abs(value.cast("double"))) * STEPS).cast("long") + (1 << 20)
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, step).otherwise(-step)


def at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Index], times: str | None = None, split: bool = False) -> DataFrame:
    """``keys, n`` and for each name the value at an index (from 0, given n) of the group's sorted values.

    ``times``: how many rows a row stands for. ``split``: cut the values into ranges first. Null values take no part; a
    group without a value has no row; a null key is a group of its own.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(times) if times else F.count("*")).alias("_c"))
    group = Window.partitionBy(*keys)
    running = lambda window, by: window.orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = lambda c: [(F.col("_upto") > i(F.col("n"))) & (F.col("_upto") - F.col(c) <= i(F.col("n"))) for i in ranks.values()]
    if not split:
        placed = counts.select(*keys, value, "_c", F.sum("_c").over(running(group, value)).alias("_upto"), F.sum("_c").over(group).alias("n"))
    else:
        cells = counts.withColumn("_r", _range(F.col(value)))
        totals = cells.groupBy(*keys, "_r").agg(F.sum("_c").alias("_t"))
        totals = totals.select(*keys, "_r", "_t", F.sum("_t").over(running(group, "_r")).alias("_upto"), F.sum("_t").over(group).alias("n"))
        wanted = inside("_t")
        hit = wanted[0]
        for w in wanted[1:]:
            hit = hit | w
        chosen = totals.where(hit).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_r").alias("_k_r"), (F.col("_upto") - F.col("_t")).alias("_before"), "n")
        same = F.col("_r") == F.col("_k_r")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        near = cells.join(chosen, same)
        own = running(Window.partitionBy(*keys, "_r"), value)
        placed = near.select(*keys, value, "_c", (F.col("_before") + F.sum("_c").over(own)).alias("_upto"), "n")
    picks = [F.max(F.when(here, F.col(value))).alias(name) for name, here in zip(ranks, inside("_c"))]
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, fractions: dict[str, float], times: str | None = None, split: bool = False) -> DataFrame:
    """``keys, n`` and for each fraction the value at index ``round(f * (n - 1))`` of the sorted values (halves to even)."""
    return at_ranks(rows, keys, value, {name: lambda n, f=f: F.bround(F.lit(f) * (n - 1), 0) for name, f in fractions.items()}, times, split)


def linear_percentiles(rows: DataFrame, keys: list[str], value: str, fractions: dict[str, float], times: str | None = None, split: bool = False) -> DataFrame:
    """``keys, n`` and for each fraction the value at ``f * (n - 1)``, interpolated between its two neighbours; 0.5 is the median."""
    place = lambda n, f: F.lit(f) * (n - 1)
    ends = {f"_{side}{i}": lambda n, f=f, cut=cut: cut(place(n, f)) for i, f in enumerate(fractions.values()) for side, cut in (("lo", F.floor), ("hi", F.ceil))}
    found = at_ranks(rows, keys, value, ends, times, split)

    def between(i: int, f: float) -> Column:
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        part = place(F.col("n"), f) - F.floor(place(F.col("n"), f))
        return F.when(low == high, low.cast("double")).when(part == 0.5, (low + high) / 2).otherwise(low + (high - low) * part)

    return found.select(*keys, "n", *[between(i, f).alias(name) for i, (name, f) in enumerate(fractions.items())])


def spread(rows: DataFrame, keys: list[str], source: str, times: str | None = None) -> DataFrame:
    """``keys, sources, top_share``: number of sources of a group, and the share of the largest (3 digits)."""
    by_source = rows.groupBy(*keys, source).agg((F.sum(times) if times else F.count("*")).alias("_c"))
    return by_source.groupBy(*keys).agg(F.count(source).alias("sources"), F.bround(F.max("_c") / F.sum("_c"), 3).alias("top_share"))
