"""Source divergence audit: how far the words of each source of a language are from its other sources' and from the language's.

A group is a (lang, source). Every term that enough documents of a language have gets a smoothed probability in each group,
in millionths of a thousandth (integers; all arithmetic is exact), and f = floor((p - q)^2 / (p + q)) tells two of them apart.

Pairs of sources, by postings. A group's terms without occurrences all have the same probability p0, so with f00 of two
groups' p0 the sum over all V terms is

    V f00 + sum over a's terms (f(p, q0) - f00) + sum over b's terms (f(p0, q) - f00)
          + sum over common terms (f(p, q) - f(p, q0) - f(p0, q) + f00).

The first sums need only how many terms of a group have which count; the last one joins the postings of a term with each
other, at most as many as there are sources, and is summed before the shuffle.

Leading terms, by upper bounds. The terms of a group are put into buckets by their count there (eight to an octave). f
rises with p and falls with q, so no term of a bucket is further from the language than f(largest p, smallest q) of it. Buckets
are evaluated best bound first: first those that hold the ten terms wanted, then, with the tenth best of these, all further
ones whose bounds are not strictly below it. No unseen term can be among the ten, or tie with one of them.

Counts are sums of partial sums, so a group or a word with a third of all occurrences is a few rows before any shuffle.
Integers hold for up to 9 * 10^13 occurrences in a group (probabilities are divided in two steps for that).

Defined cases: null text, lang and source are read as ''; an empty text has no terms, but its group is there; a language
with no kept term gives pairs of value 0 and no leading terms; a language with one source gives no pairs; repeated rows
count each; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, bounded_batches, chunks, cut, mixed, prefix_sums, span_hashes, text_bytes, word_spans

#: What stands between two terms: all of ASCII but its letters. Bytes of other characters belong to terms.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Occurrences that a task counts at once, and bytes that it hashes at once.
HELD, HASHED = 1_500_000, 1 << 20
TERMS = ["lang", "source", "term", "n", "docs"]
#: Documents of its language that have a kept term; probabilities are in parts of SCALE; terms reported for each group.
LEAST_DOCUMENTS, SCALE, LEADING = 10, 1_000_000_000, 10
#: The rows that meet every group of a language are dealt over so many parts of it.
PARTS = 16


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + 2) / (total + 2 terms)), in two divisions, so that no product leaves 64 bits."""
    step = 100_000
    high, whole = (count + 2) * step, total + terms * 2
    rest = (high % whole) * (SCALE // step)
    return F.call_function("div", high, whole) * (SCALE // step) + F.call_function("div", rest, whole) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def spans_by_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the terms of a buffer, about HASHED bytes at a time, so that a very long text needs no more memory for it."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + HASHED, side="right")))
        out[a:b] = span_hashes(prefix_sums(data[starts[a] : ends[b - 1]]), starts[a:b] - starts[a], ends[a:b] - starts[a])
        a = b
    return out


def counted(groups: pa.RecordBatch, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """``lang, source, term, n, docs`` of the terms held (bytes, starts, ends, group, row); ``groups`` has lang and source by number.

    Terms are sorted by a hash of group and term and stay in the order of rows, so the documents of a term are the changes of row.
    """
    data = np.concatenate([h[0] for h in held])
    base = np.cumsum([0, *[len(h[0]) for h in held[:-1]]])
    starts, ends = (np.concatenate([h[k] + at for h, at in zip(held, base)]) for k in (1, 2))
    hashes, group, row = (np.concatenate([h[k] for h in held]) for k in (3, 4, 5))
    order = np.argsort(mixed(hashes + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    hashes, group, row = hashes[order], group[order], row[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (group[1:] != group[:-1])
    first = np.flatnonzero(new)
    new_row = new.copy()
    new_row[1:] |= row[1:] != row[:-1]
    n = np.diff(np.append(first, len(order)))
    docs = np.add.reduceat(new_row, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    starts, sizes = starts[order[first]], (ends - starts)[order[first]]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    letters = data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)]
    terms = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(letters)).cast(pa.string())
    of = pa.array(group[first])
    return pa.RecordBatch.from_arrays([groups.column(0).take(of), groups.column(1).take(of), terms, pa.array(n.astype(np.int64)), pa.array(docs)], TERMS)


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term of each group; and a row with the term '' for each group.

    Tasks count the terms of HELD occurrences at a time before they give them to Spark, which sums these counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        held, size, rows = [], 0, 0

        def flush() -> pa.RecordBatch:
            groups = pa.RecordBatch.from_arrays([pa.array([k[i] for k in names], pa.string()) for i in (0, 1)], TERMS[:2])
            return counted(groups, held)

        for batch in batches:
            for part in chunks(batch, 2):
                own = [names.setdefault(k, len(names)) for k in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                data, offsets = text_bytes(part.column(2))
                data = LOWER[data]
                starts, ends, number = word_spans(data, offsets, BETWEEN)
                row = np.repeat(np.arange(rows, rows + part.num_rows), number)
                held.append((data, starts, ends, spans_by_hash(data, starts, ends), np.repeat(np.array(own, np.int64), number), row))
                rows += part.num_rows
                size += len(starts)
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        if names:
            nothing = [0] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in names]), pa.array([k[1] for k in names]), pa.array([""] * len(names)), pa.array(nothing, pa.int64()), pa.array(nothing, pa.int64())], TERMS)

    bounded_batches(docs.sparkSession)
    none = F.lit("")
    rows = docs.select(*[F.coalesce(c, none).alias(c) for c in ("lang", "source", "text")])
    words = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return words.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class Counts:
    """The kept terms of all groups as written tables: ``postings`` (lang, source, term, n, lang_n), ``languages`` (lang, lang_total, terms), ``groups`` (lang, source, total, lang_total, terms)."""

    def __init__(self, docs: DataFrame, least: int = LEAST_DOCUMENTS):
        counts = cut(term_counts(docs), "terms")
        kept = counts.where("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
        kept = cut(kept.select("lang", "term", "lang_n"), "kept")
        self.postings = cut(counts.where("term != ''").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "postings")
        languages = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms"))
        totals = self.postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
        self.groups = cut(groups.fillna(0, ["total", "lang_total", "terms"]), "groups")


def pair_values(counts: Counts) -> DataFrame:
    """``lang, source, item, value``: each source with each other one of its language, by the sum over all kept terms."""
    groups = counts.groups.select("lang", "source", "total", "terms", F.when(F.col("terms") > 0, probability(F.lit(0), F.col("total"), F.col("terms"))).alias("p0"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    postings = counts.postings.join(groups, ["lang", "source"]).select("lang", "term", "source", "p0", "n", probability(F.col("n"), F.col("total"), F.col("terms")).alias("p"))

    # a's terms against the probability that b gives to what it lacks; the same of b comes with the pair the other way round
    salts = F.explode(F.array(*[F.lit(k) for k in range(PARTS)]))
    alike = postings.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("n")).withColumn("salt", F.pmod(F.hash("source", "p"), F.lit(PARTS)))
    single = alike.join(other.select("*", salts.alias("salt")), ["lang", "salt"]).where("source != item")
    single = single.groupBy("lang", "source", "item").agg(F.sum(F.col("n") * (apart(F.col("p"), F.col("q0")) - apart(F.col("p0"), F.col("q0")))).alias("single"))

    a, b = postings.alias("a"), postings.select("lang", "term", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("p").alias("q")).alias("b")
    more = apart(F.col("p"), F.col("q")) - apart(F.col("p"), F.col("q0")) - apart(F.col("p0"), F.col("q")) + apart(F.col("p0"), F.col("q0"))
    common = a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(more).alias("common"))

    pairs = groups.join(other, "lang").where("source < item").select("lang", "source", "item", F.coalesce(F.col("terms") * apart(F.col("p0"), F.col("q0")), F.lit(0)).alias("none"))
    turned = single.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("single").alias("turned"))
    key = ["lang", "source", "item"]
    value = F.col("none") + sum((F.coalesce(c, F.lit(0)) for c in ("single", "turned")), F.coalesce("common", F.lit(0)))
    whole = pairs.join(common, key, "left").join(single, key, "left").join(turned, key, "left").select(*key, value.alias("value"))
    return whole.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value").select("lang", "x.*", "value")


def bucket(count: Column) -> Column:
    """Buckets of counts, eight to an octave: counts under 16 each have their own."""
    octave = F.greatest(F.length(F.bin(count)) - 4, F.lit(0))
    return octave * 8 + F.call_function("shiftright", count, octave)


def leading_terms(counts: Counts, leading: int = LEADING) -> DataFrame:
    """``lang, source, item, value, rank``: the terms that a source has more often than its language, furthest first."""
    group = ["lang", "source"]
    rows = counts.postings.join(counts.groups, group).select(
        *group, "term", bucket(F.col("n")).alias("bucket"),
        probability(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        probability(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    rows = cut(rows, "probabilities")
    over = rows.where("p > q")
    bounds = over.groupBy(*group, "bucket").agg(apart(F.max("p"), F.min("q")).alias("bound"), F.count("*").alias("n"))
    # a few hundred buckets a group at most, however many terms it has
    best_first = Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket")
    before = F.coalesce(F.sum("n").over(best_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = cut(bounds.withColumn("before", before), "bounds")

    def evaluated(buckets: DataFrame) -> DataFrame:
        return over.join(buckets.select(*group, "bucket"), [*group, "bucket"], "left_semi").select(*group, F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))

    ranked = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    first = cut(evaluated(bounds.where(F.col("before") < leading)).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= leading), "leading")
    kth = first.where(F.col("rank") == leading).select(*group, F.col("value").alias("kth"))
    rest = bounds.where(F.col("before") >= leading).join(kth, group).where("bound >= kth")
    both = first.select(*group, "item", "value").union(evaluated(rest))
    return both.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= leading)


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, leading: int = LEADING) -> DataFrame:
    """``lang, source, part, item, value, rank``: part pair ranks the other sources, part term the leading terms."""
    counts = Counts(docs, least)
    nearest = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(counts).withColumn("rank", F.row_number().over(nearest)).withColumn("part", F.lit("pair"))
    terms = leading_terms(counts, leading).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).union(terms.select(columns))
