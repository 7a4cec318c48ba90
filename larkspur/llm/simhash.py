"""SimHash near-duplicates by anchor-point covering.

Fingerprints: one bit is set where over half of the text's shingle hashes (XXH64, seed 42) have it set.

Links at two or fewer differing bits: the anchors are the codewords of the perfect Hamming code of length 31,
laid over bits 0-30 (family 0) and over bits 31-61 (family 1). Its covering radius is 1: each block of 31 bits
has exactly one codeword within distance 1, the fingerprint's home anchor. Two fingerprints that differ in at
most 2 bits differ in at most 1 bit of one of the two blocks; in that family the second one lies within
covering radius plus threshold (1 + 1) of the first one's home. So every fingerprint goes home once per family
and visits every anchor within distance 2 (at most 16 per family), and homes are compared with visitors per
anchor: 34 small rows for each distinct fingerprint, spread over 2^27 anchors, and no link is lost.

Copies share a fingerprint and are collapsed before; a fingerprint has at most 2,080 neighbours within two bits,
so links stay linear in the number of distinct fingerprints.

Similar texts (``similar_classes``) are those whose sets of distinct shingle hashes have a Jaccard similarity of 0.8 or
more, each pair decided on the sets themselves. Texts of one set are collapsed. Pairs come from two sources:

* Anchors: each set has a sketch of two fingerprints, of its distinct hashes mixed anew, with two families of anchors each.
  Every fingerprint goes home and visits as above, and a visitor is compared with one centre of those that are at home at
  the anchor. Pairs of 0.8 differ in 15 % of the bits, so anchors lose some, but find groups of near copies in a number of
  comparisons that is linear in the group.
* Prefixes, which lose none: with all shingles in one order, two sets of that similarity share one of the first
  n - ceil(0.8 n) + 1 shingles of each. Sets that share one are compared, unless anchors have already put them into one
  component, or their sizes, the shingle's places or their parity bits rule the similarity out. The order is by the
  number of sets that have a shingle, rare ones first, so boilerplate is hardly ever in a prefix, and a shingle that one
  set has needs no place in a cell. All sets are counted (``shingle_table``). A cell of the prefixes is a join key.

512 parity bits of each set rule out most unlike ones: they differ in no more bits than the sets do in shingles.

The counts are sorted arrays in the shared folder, a file for each hash range, which workers map into memory, so that
their size may grow with the input; the folder has to be mounted on the executors for that.

Defined cases: null or wordless text has fingerprint zero and is linked like any other; a text with fewer words
than a shingle is one shingle; repeated rows are returned each; a null doc_id keeps its row, but never names a
component (null if no other document is in it); an empty table gives an empty table; other columns are ignored
(fingerprints) or kept (keep_one).
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import LOWER, bounded_batches, chunks, cut, drop, give_back, mapped_arrays, mixed, mounted, new_path, prefix_sums, save_arrays, span_hashes, text_bytes, word_spans

BLOCK = 31
#: Bit masks of the code's five parity checks: check j covers the positions 1..31 whose number has bit j set.
CHECKS = [sum(1 << (p - 1) for p in range(1, BLOCK + 1) if p >> j & 1) for j in range(5)]
FAMILIES = (0, 1)


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts with one space after each, the start and end of each shingle in them, and the number of shingles of each text."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, counts = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint8), starts, ends, np.zeros(len(counts), np.int64)
    # words one after the other with one space after each
    sizes = ends - starts
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    letters = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    joined = np.full(len(letters) + len(starts), 0x20, np.uint8)
    joined[np.arange(len(letters)) + np.repeat(np.arange(len(starts)), sizes)] = letters
    word_start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    word_end = word_start + sizes

    number = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    first_word = np.cumsum(counts) - counts
    begin = np.cumsum(number) - number
    first = np.repeat(first_word - begin, number) + np.arange(int(number.sum()))
    last = first + np.repeat(np.minimum(width, counts) - 1, number)
    return joined, word_start[first], word_end[last], number


def shingle_fingerprints(column: pa.Array, width: int) -> np.ndarray:
    """The fingerprint of each text of a batch."""
    import xxhash

    joined, starts, ends, number = shingles(column, width)
    out = np.zeros(len(number), np.uint64)
    if not len(starts):
        return out
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([digest(raw[s:e], 42) for s, e in zip(starts.tolist(), ends.tolist())], np.uint64)
    has = number > 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = np.add.reduceat(bits, (np.cumsum(number) - number)[has], axis=0, dtype=np.int32)
    ones = votes * 2 > number[has, None]
    out[has] = np.packbits(ones, axis=1, bitorder="little").copy().view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (a long with the 64 bits) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                made = pa.array(shingle_fingerprints(part.column(1), width).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), made], ["doc_id", "fingerprint"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint long")


def _block(fingerprint: Column, family: int) -> Column:
    return F.shiftrightunsigned(fingerprint, BLOCK * family).bitwiseAND(F.lit((1 << BLOCK) - 1))


def _syndrome(block: Column) -> Column:
    """The position (1..31) to flip for the nearest codeword; 0 if the block is one."""
    parts = [F.bit_count(block.bitwiseAND(F.lit(m))).bitwiseAND(F.lit(1)) * (1 << j) for j, m in enumerate(CHECKS)]
    return sum(parts[1:], parts[0])


def _flip(position: Column) -> Column:
    """The block with only this position's bit set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), position.cast("int") - 1)


def homes(fps: DataFrame, *more: str) -> DataFrame:
    """``anchor, fingerprint`` and ``more`` columns: the one anchor within the covering radius, per family."""
    rows = []
    for family in FAMILIES:
        block = _block(F.col("fingerprint"), family)
        s = _syndrome(block)
        anchor = F.when(s == 0, block).otherwise(block.bitwiseXOR(_flip(s)))
        rows.append(anchor + F.lit(family << BLOCK))
    return fps.select(F.explode(F.array(*rows)).alias("anchor"), "fingerprint", *more)


def _near_anchors(block: Column, s: Column, family: int) -> Column:
    """The anchors within 2 of a block: flips of one or two positions that bring its syndrome to zero."""

    def anchor(a: Column) -> Column:
        b = a.bitwiseXOR(s)
        one = block.bitwiseXOR(_flip(a))
        return F.when(a == s, one).when((s > 0) & (b > a), one.bitwiseXOR(_flip(b)))

    near = F.concat(F.array(F.when(s == 0, block)), F.transform(F.sequence(F.lit(1), F.lit(BLOCK)), anchor))
    return F.transform(F.filter(near, lambda x: x.isNotNull()), lambda x: x + F.lit(family << BLOCK))


def visits(fps: DataFrame, *more: str) -> DataFrame:
    """``anchor, other`` (the fingerprint) and ``more`` columns: every anchor within covering radius plus threshold, per family."""
    found = [_near_anchors(F.col(f"block{f}"), F.col(f"s{f}"), f) for f in FAMILIES]
    parts = fps.select("fingerprint", *more, *[_block(F.col("fingerprint"), f).alias(f"block{f}") for f in FAMILIES])
    parts = parts.select("*", *[_syndrome(F.col(f"block{f}")).alias(f"s{f}") for f in FAMILIES])
    return parts.select(F.explode(F.concat(*found)).alias("anchor"), F.col("fingerprint").alias("other"), *more)


def links(fps: DataFrame) -> DataFrame:
    """``a, b``: the distinct fingerprints at one or two differing bits from each other, a < b."""
    near = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other"))) <= 2
    pairs = homes(fps).join(visits(fps), "anchor").where((F.col("fingerprint") != F.col("other")) & near)
    return pairs.select(F.least("fingerprint", "other").alias("a"), F.greatest("fingerprint", "other").alias("b")).distinct()


def classes(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row; component_id: the smallest doc_id reachable over links."""
    prints = cut(fingerprints(docs, width, doc_id, text), "fingerprints")
    fps = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_doc")), "fingerprints")
    label = components(links(fps))
    of = fps.join(label, fps.fingerprint == label.id, "left").select("fingerprint", "first_doc", F.coalesce("label", "fingerprint").alias("label"))
    smallest = of.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    named = of.join(smallest, "label").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


#: Parity bits of a set of shingles.
PARITY = [f"w{k}" for k in range(8)]
#: The fingerprints of a set's sketch; what two that meet by one may differ in the other (32 of unlike sets, 10 of similar ones).
SKETCH, REST_BITS = ["f0", "f1"], 24
#: Names of columns, and what makes them of the hashes of a batch's sets and their numbers.
Marks = tuple[list[str], Callable[[np.ndarray, np.ndarray], list[np.ndarray]]]
#: Shingles that a task sorts at once and that a range of the counts has on average, and the fewest ranges.
RUN_SHINGLES, RANGE_SHINGLES, LEAST_RANGES = 2_000_000, 4_000_000, 16


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in rising order, one text after the other; and their number for each text."""
    joined, starts, ends, number = shingles(column, width)
    hashes = span_hashes(prefix_sums(joined), starts, ends)
    text = np.repeat(np.arange(len(number)), number)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.bincount(text[new], minlength=len(number))


def set_marks(hashes: np.ndarray, number: np.ndarray) -> list[pa.Array]:
    """Of each set of a batch a hash, its size and its parity bits."""
    import xxhash

    bits = 64 * len(PARITY)
    edge = np.concatenate([[0], np.cumsum(number)])
    ids = np.array([xxhash.xxh64_intdigest(hashes[a:b].tobytes(), 42) for a, b in zip(edge, edge[1:])], np.uint64)
    at = np.repeat(np.arange(len(number)), number) * bits + (hashes >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    odd = (np.bincount(at, minlength=len(number) * bits) & 1).astype(np.uint8).reshape(-1, bits)
    words = np.packbits(odd, axis=1, bitorder="little").copy().view("<i8")
    return [pa.array(ids.view(np.int64)), pa.array(number.astype(np.int32)), *[pa.array(words[:, k].copy()) for k in range(len(PARITY))]]


def set_rows(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text", more: Marks | None = None) -> DataFrame:
    """``doc_id, text, id, size, w0 .. w7`` for every row of ``docs``: a hash of its shingle set, the set's size and parity bits; and columns of longs that ``more`` makes of the sets, by name."""
    names, make = more or ([], lambda hashes, number: [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                hashes, number = shingle_sets(part.column(1), width)
                made = [*set_marks(hashes, number), *[pa.array(x.view(np.int64)) for x in make(hashes, number)]]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], ["doc_id", "text", "id", "size", *PARITY, *names])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, text string, id long, size int, " + ", ".join(f"{w} long" for w in [*PARITY, *names]))


def set_sketches(hashes: np.ndarray, number: np.ndarray) -> list[np.ndarray]:
    """The fingerprints of each set's sketch: bits that over half of its shingle hashes have, mixed anew for each. Zero for an empty set."""
    has = number > 0
    begin, out = (np.cumsum(number) - number)[has], []
    for k in range(len(SKETCH)):
        prints = np.zeros(len(number), np.uint64)
        if len(begin):
            bits = np.unpackbits(mixed(hashes + np.uint64((k + 1) * 0xD1B54A32D192ED03 & (2**64 - 1))).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
            prints[has] = np.packbits(votes * 2 > number[has, None], axis=1, bitorder="little").copy().view("<u8").ravel()
        out.append(prints)
    return out


def anchor_pairs(sets: DataFrame, width: int) -> DataFrame:
    """``a, b``: each set (``id, size, f0, f1``) with one centre at each anchor that it visits: the first in the anchor's own order of those at home there.

    The fingerprint that did not lead them there rules out most unlike sets. A written table.
    """
    both = [F.struct(F.lit(k << 32).alias("part"), F.col(name).alias("fingerprint"), F.col(SKETCH[1 - k]).alias("rest")) for k, name in enumerate(SKETCH)]
    fps = cut(sets.where("size > 0").select("id", F.inline(F.array(*both))), "anchors")
    own = ("id", "part", "rest")
    at = (F.col("anchor") + F.col("part")).alias("anchor")
    centres = homes(fps, *own).select(at, "id", "rest").groupBy("anchor").agg(F.min(F.struct(F.xxhash64("anchor", "id").alias("o"), "id", "rest")).alias("c"))
    centres = cut(centres.select("anchor", F.col("c.id").alias("b"), F.col("c.rest").alias("_rest")), "anchors")
    meet = visits(fps, *own).select(at, "id", "rest").join(centres, "anchor")
    near = F.bit_count(F.col("rest").bitwiseXOR(F.col("_rest"))) <= REST_BITS
    out = cut(meet.where((F.col("id") != F.col("b")) & near).select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct(), "anchors")
    drop(sets.sparkSession, fps, centres)
    return out


def stars(rows: DataFrame, orders: int = 0) -> DataFrame:
    """``a, b``: each row (``id, anchor``) with one of those at its anchor; the centre is the same whenever a task runs again.

    Every anchor has an order of its own, whose first set is the centre; or there are so many ``orders`` in all, and a
    group meets few different centres over its anchors. Both sides of the join are written tables, so that Spark can split an anchor at which very many meet.
    """
    rows = cut(rows, "anchors")
    centres = rows.groupBy("anchor").agg(F.min(F.struct(F.xxhash64(F.pmod("anchor", F.lit(orders)) if orders else "anchor", "id").alias("o"), "id")).alias("c"), F.count("*").alias("n")).where("n > 1")
    centres = cut(centres.select("anchor", F.col("c.id").alias("b")), "anchors")
    meet = rows.join(centres, "anchor").where(F.col("id") != F.col("b"))
    out = cut(meet.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct(), "anchors")
    drop(rows.sparkSession, rows, centres)
    return out


def shingle_table(sets: DataFrame, width: int) -> tuple[str, int]:
    """Counts the sets (``size, text``) that have each shingle; gives the folder of the sorted arrays and the number of ranges.

    A range is the hash's remainder. Its 32 upper bits stand for the hash: two shingles that have them in common are
    counted as one, which moves both in the order and loses nothing. Only counts of two and more are kept.
    """
    spark = sets.sparkSession
    ranges = max(LEAST_RANGES, -(-(sets.agg(F.sum("size")).first()[0] or 0) // RANGE_SHINGLES))
    folder = mounted(new_path(spark, "shingles"))

    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        hashes = np.concatenate(held)
        where = hashes % np.uint64(ranges)
        order = np.argsort(where, kind="stable")
        own, begin = np.unique(where[order], return_index=True)
        upper = (hashes[order] >> np.uint64(32)).astype(np.uint32)
        bounds = [*begin.tolist(), len(upper)]
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([np.sort(upper[a:b]).tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], ["range", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in chunks(batch, 0):
                held.append(shingle_sets(part.column(0), width)[0])
                n += len(held[-1])
                if n >= RUN_SHINGLES:
                    yield pack(held)
                    held, n = [], 0
        if n:
            yield pack(held)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        upper = np.sort(np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("run")]))
        begin = np.flatnonzero(np.concatenate([[True], upper[1:] != upper[:-1]]))
        counts = np.diff(np.append(begin, len(upper)))
        often = counts > 1
        save_arrays(folder, str(key[0].as_py()), keys=upper[begin[often]], counts=np.minimum(counts[often], 2**31 - 1).astype(np.int32))
        give_back()
        return pa.table({"range": pa.array([key[0].as_py()], pa.int32())})

    sets.select("text").mapInArrow(run, "range int, run binary").groupBy("range").applyInArrow(merge, "range int").count()
    return folder, ranges


def shingle_counts(folder: str, ranges: int, hashes: np.ndarray) -> np.ndarray:
    """The number of sets that have each shingle; 1 for one that is not in the table."""
    out = np.ones(len(hashes), np.int32)
    where = hashes % np.uint64(ranges)
    order = np.argsort(where, kind="stable")
    own, begin = np.unique(where[order], return_index=True)
    for k, a, b in zip(own.tolist(), begin.tolist(), [*begin.tolist()[1:], len(order)]):
        arrays = mapped_arrays(folder, str(k), ("keys", "counts"))
        keys, rows = arrays["keys"], order[a:b]
        if len(keys):
            wanted = (hashes[rows] >> np.uint64(32)).astype(np.uint32)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[at] == wanted
            out[rows[hit]] = arrays["counts"][at[hit]]
    return out


def prefix_rows(sets: DataFrame, width: int, similarity: float) -> DataFrame:
    """``shingle, id, size, place`` of the shingles in the prefix of each set (``id, text``) that other sets have too."""
    folder, ranges = shingle_table(sets, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                hashes, number = shingle_sets(part.column(1), width)
                n = shingle_counts(folder, ranges, hashes)
                text = np.repeat(np.arange(len(number)), number)
                order = np.lexsort((hashes, n, text))
                place = np.arange(len(hashes)) - np.repeat(np.cumsum(number) - number, number)
                prefix = number - np.ceil(similarity * number - 1e-9).astype(np.int64) + 1
                own = np.flatnonzero((place < prefix[text]) & (n[order] > 1))
                at = pa.array(text[own])
                made = [pa.array(hashes[order][own].view(np.int64)), part.column(0).take(at), pa.array(number[text[own]].astype(np.int32)), pa.array(place[own].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(made, ["shingle", "id", "size", "place"])

    return sets.select("id", "text").mapInArrow(run, "shingle long, id long, size int, place int")


def mixed_cells(rows: DataFrame) -> DataFrame:
    """Those of the rows (``shingle, id, label, size, place``) of the shingles that sets of more than one label have; a written table.

    The smallest and the largest label of a shingle tell, from partial sums; rows and shingles meet as written tables, so
    that Spark can split a shingle that very many sets have.
    """
    rows = cut(rows, "prefixes")
    several = rows.groupBy("shingle").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least != most")
    several = cut(several.select("shingle"), "prefixes")
    out = cut(rows.join(several, "shingle", "left_semi"), "cells")
    drop(rows.sparkSession, rows, several)
    return out


def _apart(other: str = "_") -> Column:
    """The number of parity bits in which two sets differ."""
    bits = [F.bit_count(F.col(w).bitwiseXOR(F.col(f"{other}{w}"))) for w in PARITY]
    return sum(bits[1:], bits[0])


def _may(similarity: float) -> Column:
    return _apart() <= (F.col("size") + F.col("_size")) * ((1 - similarity) / (1 + similarity)) + 1e-6


def prefix_pairs(cells: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: all sets of different labels that may have the similarity and share a shingle of their prefixes."""
    number = cells.groupBy("shingle", "label").agg(F.count("*").alias("n"))
    main = cut(number.groupBy("shingle").agg(F.max(F.struct("n", "label")).alias("m")).select("shingle", F.col("m.label").alias("main")), "cells")
    cells = cut(cells.join(main, "shingle").join(sets.select("id", *PARITY), "id"), "cells")
    # the largest component of a cell is only met, so its own pairs are not made
    others = cells.where("label != main").select("shingle", *[F.col(c).alias(f"_{c}") for c in ("id", "label", "size", "place", *PARITY)])
    once = (F.col("label") == F.col("main")) | (F.col("id") < F.col("_id"))
    sizes = F.least("size", "_size") >= F.greatest("size", "_size") * similarity - 1e-6
    most = F.least(F.col("size") - F.col("place"), F.col("_size") - F.col("_place"))
    places = most >= (F.col("size") + F.col("_size")) * (similarity / (1 + similarity)) - 1e-6
    pairs = cells.join(others, "shingle").where((F.col("label") != F.col("_label")) & once & sizes & places & _may(similarity))
    return pairs.select(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b")).distinct()


def star_candidates(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``a, b`` that sizes and parity bits (``id, size, w0 .. w7``) don't rule out."""
    marks = sets.select("id", "size", *PARITY)
    both = pairs.join(marks.withColumnRenamed("id", "a"), "a").join(marks.select(F.col("id").alias("b"), *[F.col(c).alias(f"_{c}") for c in ("size", *PARITY)]), "b")
    return both.where(_may(similarity)).select("a", "b")


def chosen(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of the ``rows`` (``id`` first) whose id is one of ``ids``, without moving the rows: sorted arrays of ids, which workers map into memory."""
    ranges = max(LEAST_RANGES, -(-ids.count() // RANGE_SHINGLES))
    folder = mounted(new_path(rows.sparkSession, "chosen"))

    def save(key: tuple, table: pa.Table) -> pa.Table:
        save_arrays(folder, str(key[0].as_py()), keys=np.sort(table.column("id").to_numpy()))
        return pa.table({"range": pa.array([key[0].as_py()], pa.int32())})

    os.makedirs(folder, exist_ok=True)  # there may be no ids
    ids.select(F.pmod("id", F.lit(ranges)).cast("int").alias("range"), "id").groupBy("range").applyInArrow(save, "range int").count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            has = np.zeros(len(own), bool)
            where = own % ranges
            for k in np.unique(where).tolist():
                keys, at = mapped_arrays(folder, str(k), ("keys",))["keys"], np.flatnonzero(where == k)
                if len(keys):
                    has[at] = keys[np.minimum(np.searchsorted(keys, own[at]), len(keys) - 1)] == own[at]
            yield batch.filter(pa.array(has))

    return rows.mapInArrow(run, rows.schema)


def similar_pairs(pairs: DataFrame, sets: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of the pairs ``a, b`` whose sets (``id, text``) have the similarity, by the sets themselves; a written table."""
    left = cut(pairs, "pairs")
    texts = cut(chosen(sets.select("id", "text"), left.select(F.col("a").alias("id")).distinct().union(left.select("b").distinct()).distinct()), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for outer in chunks(batch, 2):
                for part in chunks(outer, 3):
                    (x, nx), (y, ny) = shingle_sets(part.column(2), width), shingle_sets(part.column(3), width)
                    ex, ey = (np.concatenate([[0], np.cumsum(n)]) for n in (nx, ny))
                    shared = np.array([len(np.intersect1d(x[a:b], y[c:d], assume_unique=True)) for a, b, c, d in zip(ex, ex[1:], ey, ey[1:])], np.int64)
                    keep = pa.array(shared >= similarity * (nx + ny - shared) - 1e-9)
                    yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])

    rows = left.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    out = cut(rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "similar")
    drop(sets.sparkSession, left, texts)
    return out


def similar_links(sets: DataFrame, width: int, similarity: float, found: Callable[[DataFrame, int], DataFrame] = anchor_pairs) -> DataFrame:
    """``a, b``: pairs of sets (``id, text, size, w0 .. w7``, and what ``found`` needs) of that Jaccard similarity, enough to reach every such pair over them.

    ``found`` gives the first candidates, which need not be all; prefixes find what they left between components.
    """
    first = similar_pairs(star_candidates(found(sets, width), sets, similarity), sets, width, similarity)
    label = components(first)
    rows = prefix_rows(sets, width, similarity).join(label, "id", "left")  # texts are not moved for their labels
    cells = mixed_cells(rows.select("shingle", "id", F.coalesce("label", "id").alias("label"), "size", "place"))
    return first.union(similar_pairs(prefix_pairs(cells, sets, similarity), sets, width, similarity))


def named_sets(sets: DataFrame, links: DataFrame) -> DataFrame:
    """``id, label, component_id`` of each set (``id, first_doc``): its component, and the smallest first_doc there. A written table."""
    label = components(links).withColumnRenamed("id", "of")
    of = cut(sets.join(label, sets.id == label.of, "left").select("id", "first_doc", F.coalesce("label", "id").alias("label")), "labels")
    smallest = cut(of.groupBy("label").agg(F.min("first_doc").alias("component_id")), "labels")
    out = cut(of.join(smallest, "label").select("id", "label", "component_id"), "labels")
    drop(sets.sparkSession, of, smallest)
    return out


def similar_rows(docs: DataFrame, width: int, similarity: float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, _text, label, component_id`` for every row: a hash of the text, and the component with its smallest doc_id."""
    rows = set_rows(docs, width, doc_id, text, (SKETCH, set_sketches))
    prints = cut(rows.select("doc_id", F.xxhash64("text").alias("_text"), "id"), "sets")
    distinct = distinct_sets(rows)
    named = named_sets(distinct, similar_links(distinct, width, similarity))
    return prints.join(named, "id").select("doc_id", "_text", "label", "component_id")


def distinct_sets(rows: DataFrame) -> DataFrame:
    """Each set of ``rows`` once, with the smallest doc_id of those that have it as ``first_doc``; a written table."""
    one = [F.first(c).alias(c) for c in rows.columns if c not in ("doc_id", "id")]
    return cut(rows.groupBy("id").agg(F.min("doc_id").alias("first_doc"), *one), "sets")


def similar_classes(docs: DataFrame, width: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, component_id`` for every row: the smallest doc_id of the texts that are similar, directly or over others."""
    return similar_rows(docs, width, similarity, doc_id, text).select("doc_id", "component_id")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each class of similar texts: the one with the smallest doc_id, once if its row repeats.

    Rows of one doc_id and different texts are decided each on its own. A row with a null doc_id stays, as nothing tells it from another one.
    """
    named = similar_rows(docs, width, similarity).where("doc_id is not null")
    kept = named.groupBy("label").agg(F.min(F.struct("doc_id", "_text")).alias("k")).select("k.*")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("_text"))  # columns of docs may have any name
    first = rows.where("doc_id is not null").join(kept, ["doc_id", "_text"], "left_semi").dropDuplicates(["doc_id", "_text"])
    return first.select("row").union(rows.where("doc_id is null").select("row")).select("row.*")
