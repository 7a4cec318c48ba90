"""One description of a search, from which every reader of the catalog builds its predicate."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import all_of, any_of, holds, in_with_unknown, not_in_with_unknown

#: Range ends that are equal are widened by this much.
TOLERANCE = 0.05
MOST_TERMS, SHORTEST_TERM = 8, 2


class BadQuery(ValueError):
    """A saved search that can't be read."""


def search_terms(text: str) -> list[str]:
    """Quoted phrases first, then words of two characters or more; eight at most."""
    phrases = [p.strip() for p in re.findall(r'"([^"]+)"', text or "")]
    words = re.sub(r'"[^"]*"', " ", text or "").replace('"', " ").split()
    found = [t for t in [*phrases, *words] if len(t) >= SHORTEST_TERM]
    return list(dict.fromkeys(found))[:MOST_TERMS]


@dataclass(frozen=True)
class FilterSpec:
    """What a reader asks for. ``one_of`` and ``none_of`` are by facet; every other part is optional too."""

    text: str = ""
    one_of: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    none_of: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    at_least: Mapping[str, float] = field(default_factory=dict)
    at_most: Mapping[str, float] = field(default_factory=dict)
    flags: Mapping[str, bool] = field(default_factory=dict)
    availability: str = ""
    since_hours: int = 0
    sort: str = "newest"

    @classmethod
    def from_query_string(cls, query: str) -> FilterSpec:
        """Reads ``q=..&kind=A&kind=B&not_kind=C&min_price=1&max_price=9&is_new=true&status=available&hours=24&sort=price``."""
        parts: dict = {"one_of": {}, "none_of": {}, "at_least": {}, "at_most": {}, "flags": {}}
        out = cls()
        for key, value in parse_qsl(query.lstrip("?"), keep_blank_values=False):
            try:
                if key in ("page", "per_page"):
                    continue
                if key == "q":
                    out = replace(out, text=value)
                elif key in ("sort", "status"):
                    out = replace(out, **{{"status": "availability"}.get(key, key): value})
                elif key == "hours":
                    out = replace(out, since_hours=int(value))
                elif key.startswith(("min_", "max_")):
                    parts["at_least" if key[1] == "i" else "at_most"][key[4:]] = float(value)
                elif key.startswith("is_"):
                    parts["flags"][key[3:]] = {"true": True, "1": True, "false": False, "0": False}[value.lower()]
                else:
                    side, name = ("none_of", key[4:]) if key.startswith("not_") else ("one_of", key)
                    parts[side][name] = (*parts[side].get(name, ()), value)
            except (KeyError, ValueError) as e:
                raise BadQuery(f"{key}={value}") from e
        if out.sort not in SORTS or out.availability not in ("", *AVAILABILITY):
            raise BadQuery(query)
        return replace(out, **parts)

    def to_query_string(self) -> str:
        """The same search always gives the same string: keys in order, no paging."""
        pairs = [("q", self.text)] if self.text else []
        for prefix, values in (("", self.one_of), ("not_", self.none_of)):
            pairs += [(prefix + k, v) for k, vs in values.items() for v in sorted(vs)]
        for prefix, numbers in (("min_", self.at_least), ("max_", self.at_most)):
            pairs += [(prefix + k, f"{v:g}") for k, v in numbers.items()]
        pairs += [(f"is_{k}", str(v).lower()) for k, v in self.flags.items()]
        pairs += [("status", self.availability)] if self.availability else []
        pairs += [("hours", str(self.since_hours))] if self.since_hours else []
        pairs += [("sort", self.sort)] if self.sort != "newest" else []
        return urlencode(sorted(pairs))

    def clauses(self, now: Column | None = None, searched: tuple[str, ...] = ("title",)) -> dict[str, Column]:
        """A condition for each part of the search, null counted as no; names of facets are theirs."""
        out: dict[str, Column] = {}
        if terms := search_terms(self.text):
            document = F.lower(F.concat_ws("\n", *searched))
            out["text"] = all_of([document.contains(t.lower()) for t in terms])
        for name in {*self.one_of, *self.none_of}:
            parts = [in_with_unknown(F.col(name).cast("string"), list(self.one_of[name]))] if name in self.one_of else []
            parts += [not_in_with_unknown(F.col(name).cast("string"), list(self.none_of[name]))] if name in self.none_of else []
            out[name] = all_of(parts)
        for name in {*self.at_least, *self.at_most}:
            low, high = self.at_least.get(name), self.at_most.get(name)
            slack = TOLERANCE if low is not None and low == high else 0.0
            out[f"{name} range"] = all_of(([F.col(name) >= low - slack] if low is not None else []) + ([F.col(name) <= high + slack] if high is not None else []))
        for name, wanted in self.flags.items():
            out[f"is {name}"] = F.col(name) == F.lit(wanted)
        if self.availability:
            out["availability"] = AVAILABILITY[self.availability]()
        if self.since_hours and now is not None:
            out["since"] = F.col("first_seen") >= now - F.make_dt_interval(hours=F.lit(self.since_hours))
        return {k: holds(v) for k, v in out.items()}

    def predicate(self, now: Column | None = None, searched: tuple[str, ...] = ("title",), drop: str | None = None) -> Column:
        """All clauses, but for one facet's if ``drop`` names it."""
        return all_of([c for k, c in self.clauses(now, searched).items() if k != drop])

    def order(self) -> list[Column]:
        return [SORTS[self.sort](), F.col("item").asc()]


def _left() -> Column:
    return F.coalesce("sold_at", "delisted_at") > F.col("first_seen")


AVAILABILITY = {
    "available": lambda: F.col("active") & ~F.col("sold"),
    "sold": lambda: F.col("sold"),
    "delisted": lambda: ~F.col("active"),
    "left": _left,
    "active": lambda: F.col("active"),
    "all": lambda: F.lit(True),
}

#: Every order is total: the item decides between equals, and rows without the value come last.
SORTS = {
    "newest": lambda: F.col("first_seen").desc_nulls_last(),
    "oldest": lambda: F.col("first_seen").asc_nulls_last(),
    "price_asc": lambda: F.col("price").asc_nulls_last(),
    "price_desc": lambda: F.col("price").desc_nulls_last(),
    "title": lambda: F.lower("title").asc_nulls_last(),
    "price_drop": lambda: (F.col("previous_price") - F.col("price")).desc_nulls_last(),
}


def page(rows: DataFrame, spec: FilterSpec, number: int, per_page: int = 50, **how) -> DataFrame:
    """One page of a search: filter, total order, offset and limit."""
    return rows.where(spec.predicate(**how)).orderBy(*spec.order()).offset((number - 1) * per_page).limit(per_page)


def answer(rows: DataFrame, spec: FilterSpec, number: int, facet_names: list[str], per_page: int = 50, histogram: str = "price", **how) -> DataFrame:
    """A browse page as one long answer ``part, value, n``: the totals (rows, pages), the page's items with their places, each facet's counts and the price histogram.

    A facet is counted over every clause but its own; all of them are one scan.
    """
    from .facets import exclusive, price_histogram

    found = rows.where(spec.predicate(**how))
    total = found.agg(F.count("*").alias("n"))
    pages = F.ceil(F.col("n") / per_page).cast("long")
    totals = total.select(F.explode(F.array(F.struct(F.lit("rows").alias("value"), F.col("n").alias("n")), F.struct(F.lit("pages").alias("value"), pages.alias("n")))).alias("x")).select(F.lit("total").alias("part"), "x.value", "x.n")
    own = Window.orderBy(*spec.order())
    shown = page(rows, spec, number, per_page, **how).select("item", F.row_number().over(own).cast("long").alias("n"))  # one page at most
    items = shown.select(F.lit("page").alias("part"), F.col("item").cast("string").alias("value"), "n")
    counts = exclusive(rows, spec.clauses(**how), facet_names).select(F.col("facet").alias("part"), "value", "n")
    bars = price_histogram(found, histogram).select(F.lit(histogram).alias("part"), F.col("bucket").cast("string").alias("value"), "n")
    return totals.union(items).union(counts).union(bars)


def search_with_dimension(rows: DataFrame, text: str, searched: tuple[str, ...], dimension: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """Every term somewhere in the row's own text or in a name of the dimension entry that it belongs to.

    The dimension is reduced to one flag for each term before the join, so that only keys and flags meet the rows.
    """
    terms = search_terms(text)
    own = F.lower(F.concat_ws("\n", *searched))
    named = F.lower(F.concat_ws("\n", *names))
    hits = dimension.select(key, *[named.contains(t.lower()).alias(f"_t{i}") for i, t in enumerate(terms)])
    hits = hits.where(any_of([F.col(f"_t{i}") for i in range(len(terms))]))
    joined = rows.join(hits, key, "left")
    keep = all_of([own.contains(t.lower()) | holds(F.col(f"_t{i}")) for i, t in enumerate(terms)])
    return joined.where(keep).drop(*[f"_t{i}" for i in range(len(terms))])
