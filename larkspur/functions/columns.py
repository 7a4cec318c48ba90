"""Column expressions that the operators share. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, digits: int = 0) -> Column:
    """Rounds halves to the even neighbour."""
    return F.bround(value, digits)


def cents(price: Column) -> Column:
    """Prices are compared in whole cents."""
    return F.bround(price * 100, 0).cast("long")


def is_unknown(value: Column) -> Column:
    """Null and the empty string both mean that nothing is stated."""
    return value.isNull() | (value == "")


def in_with_unknown(value: Column, chosen: list[str], unknown: str = "Unknown") -> Column:
    """One of the chosen values; the name for the unknown stands for null and the empty string."""
    named = [v for v in chosen if v != unknown]
    parts = ([value.isin(named)] if named else []) + ([is_unknown(value)] if unknown in chosen else [])
    return F.coalesce(any_of(parts), F.lit(False))


def not_in_with_unknown(value: Column, barred: list[str], unknown: str = "Unknown") -> Column:
    """None of the barred values; rows without a value stay unless the unknown itself is barred."""
    named = [v for v in barred if v != unknown]
    free = is_unknown(value) | ~value.isin(named) if named else F.lit(True)
    return free & ~is_unknown(value) if unknown in barred else F.coalesce(free, F.lit(True))


def holds(condition: Column) -> Column:
    """A condition with null counted as no."""
    return F.coalesce(condition, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def days_between(later: Column, earlier: Column) -> Column:
    """Elapsed days with their fraction."""
    seconds = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return seconds / F.lit(86_400_000_000.0)


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed days, rounded down: not the difference of the dates."""
    return F.floor(days_between(later, earlier))


def percent_drop(was: Column, now: Column) -> Column:
    return F.when(was > 0, (was - now) / was * 100)


def in_zone(moment: Column, zone: str) -> Column:
    """A moment in UTC as a reader's clock shows it."""
    return F.from_utc_timestamp(moment.cast("timestamp"), zone).cast("timestamp_ntz")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncate_words(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at a space where there is one, with an ellipsis."""
    head = F.substring(text, 1, limit)
    cut = F.regexp_replace(head, r"\s+\S*$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.when(cut == "", head).otherwise(cut), F.lit("…")))


def money(text: Column) -> Column:
    """The first amount in a text; zero is no price."""
    digits = F.regexp_extract(text, r"\$\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)", 1)
    plain = F.regexp_extract(text, r"([0-9][0-9,]*(?:\.[0-9]{1,2})?)", 1)
    chosen = F.when(digits != "", digits).otherwise(plain)
    return F.nullif(F.regexp_replace(F.nullif(chosen, F.lit("")), ",", "").cast("double"), F.lit(0.0))


def mixed_number(text: Column) -> Column:
    """``4 1/2``, ``4-1/2``, ``4½`` or ``4.5``."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "½", " 1/2"), "¼", " 1/4"), "¾", " 3/4")
    whole = F.regexp_extract(plain, r"^\s*([0-9]+(?:\.[0-9]+)?)(?![0-9]*\s*/)", 1)
    top, bottom = (F.regexp_extract(plain, r"(?:^|[\s-])([0-9]+)\s*/\s*([0-9]+)", i) for i in (1, 2))
    part = F.when(bottom != "", top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0)))
    return F.when((whole != "") | part.isNotNull(), F.coalesce(F.nullif(whole, F.lit("")).cast("double"), F.lit(0.0)) + F.coalesce(part, F.lit(0.0)))


def years(text: Column) -> Column:
    """All stated years from 1700 to 2099, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b(1[789][0-9]{2}|20[0-9]{2})\b"), 1), lambda y: y.cast("int"))


def tokens(text: Column, noise: list[str] = (), shortest: int = 3) -> Column:
    """Distinct lower-case words of letters and digits, without noise words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1))
    return F.filter(words, lambda w: (F.length(w) >= shortest) & ~w.isin(list(noise)) if noise else F.length(w) >= shortest)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def registrable_domain(url: Column) -> Column:
    """The last two labels of the host."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1))
    return F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit(""))


def backoff(failures: Column, first: float, most: float) -> Column:
    """Waits that double with each failure, up to a ceiling."""
    return F.when(failures > 0, F.least(F.lit(first) * F.pow(F.lit(2.0), failures - 1), F.lit(most))).otherwise(F.lit(0.0))
