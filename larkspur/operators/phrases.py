"""Many phrases of a reference table in many texts: one automaton for a block of phrases, one pass over the texts for a block.

A block is bounded by phrases and by characters, and blocks are made by a hash, so what goes to a worker does not grow with
the table; a table of several blocks means as many passes. Texts are never joined with phrases. Both sides are compared in
lower case with spaces collapsed; a phrase is found anywhere (``whole=False``, as a search does) or as whole words.

Columns of one row are apart: no phrase reaches from one into the next. A row counts once for a phrase, in however many
columns and however often it is there. Null texts are empty, empty phrases are none, spellings that several values share
count for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import collapse_space
from ..sources.tables import dealt
from ..written import cut

#: The most phrases, and characters of phrases, of a block on average; a block beyond LARGEST times that is an error of the hash.
BLOCK_PHRASES, BLOCK_CHARS, LARGEST = 50_000, 4_000_000, 4
#: Between two columns; the texts' own ones are spaces by then.
APART = "\x00"

Spellings = dict[str, list]


def plain(text: Column) -> Column:
    return collapse_space(F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit(APART), F.lit(" "))))


def blocks(phrases: DataFrame, phrase: str, value: str, most: int = BLOCK_PHRASES, together: str = "phrase") -> Iterator[Spellings]:
    """The phrases with their values, a bounded block at a time; what one ``phrase`` (or one ``value``) has is in one block."""
    rows = phrases.select(plain(F.col(phrase)).alias("phrase"), F.col(value).alias("value")).where("phrase <> '' and value is not null").distinct()
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("phrase")), F.lit(0))).first()
    number = max(-(-n // most), -(-chars // BLOCK_CHARS))
    for k in range(number):
        out: Spellings = {}
        for row in rows.where(F.pmod(F.xxhash64(together), F.lit(number)) == k).limit(LARGEST * most + 1).collect():
            out.setdefault(row.phrase, []).append(row.value)
        if sum(map(len, out.values())) > LARGEST * most:
            raise ValueError(f"too many phrases in a block: one {together} has too many")
        if out:
            yield {p: sorted(v) for p, v in out.items()}


def automaton(spellings: Spellings):
    import ahocorasick

    made = ahocorasick.Automaton()
    for phrase in spellings:
        made.add_word(phrase, phrase)
    made.make_automaton()
    return made


def found_in(made, text: str, whole: bool) -> Iterator[tuple[int, str]]:
    """Where each phrase begins in a text."""
    for end, phrase in made.iter(text):
        begin = end - len(phrase) + 1
        if not whole or stands_alone(text, begin, end + 1):
            yield begin, phrase


def stands_alone(text: str, begin: int, end: int) -> bool:
    """Whether a piece of a text is whole words: no letter or digit goes on at its ends, and no number is cut at its point."""
    before, after = text[begin - 1 : begin], text[end : end + 1]
    if text[begin].isalnum() and (before.isalnum() or before == ".") or text[begin] == "." and before.isalnum():
        return False
    return not (text[end - 1].isalnum() and after.isalnum() or text[end - 1].isdigit() and after == "." and text[end + 1 : end + 2].isdigit())


def hits(rows: DataFrame, key: str, texts: list[str], phrases: DataFrame, phrase: str = "phrase", value: str = "value", whole: bool = True, most: int = BLOCK_PHRASES) -> DataFrame:
    """``key, value`` for each value that has a spelling in the row; each once, unless its spellings are in several blocks."""
    spark = rows.sparkSession
    kinds = f"{key} {rows.schema[key].dataType.simpleString()}, value {phrases.schema[value].dataType.simpleString()}"
    source = rows.select(key, F.concat_ws(APART, *[plain(F.col(t)) for t in texts]).alias("_text"))
    out, passes = spark.createDataFrame([], kinds), 0
    for spellings in blocks(phrases, phrase, value, most):
        sent = spark.sparkContext.broadcast(spellings)  # one block

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            made = automaton(sent.value)
            for batch in batches:
                at, values = [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    own = {v for _, p in found_in(made, text, whole) for v in sent.value[p]}
                    at += [k] * len(own)
                    values += own
                if values:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(values)], [key, "value"])

        one = source.mapInArrow(run, kinds)
        out, passes = (one if not passes else out.union(one)), passes + 1
    return out.distinct() if passes > 1 else out


def mention_counts(rows: DataFrame, texts: list[str], phrases: DataFrame, phrase: str = "phrase", value: str = "value", whole: bool = False, most: int = BLOCK_PHRASES) -> DataFrame:
    """``value, mentions`` for every value of the table: the rows that have one of its spellings, zeros included.

    Equal texts are searched once. Tasks count; what they shuffle is one row for each value that they have seen.
    """
    spark = rows.sparkSession
    kind = f"value {phrases.schema[value].dataType.simpleString()}, mentions long"
    source = rows.select(F.concat_ws(APART, *[plain(F.col(t)) for t in texts]).alias("_text"))
    source = dealt(cut(source.groupBy("_text").agg(F.count("*").alias("_n")), "texts"))  # read once for each block
    every = phrases.select(F.col(value).alias("value")).where("value is not null").distinct().select("value", F.lit(0).cast("long").alias("mentions"))
    for spellings in blocks(phrases, phrase, value, most, "value"):
        sent = spark.sparkContext.broadcast(spellings)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            made, n = automaton(sent.value), {}
            for batch in batches:
                for text, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for v in {v for _, p in found_in(made, text, whole) for v in sent.value[p]}:
                        n[v] = n.get(v, 0) + times
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()), pa.int64())], ["value", "mentions"])

        every = every.union(source.mapInArrow(run, kind))
    return every.groupBy("value").agg(F.sum("mentions").alias("mentions"))


def tagged(rows: DataFrame, text: Column, phrases: DataFrame, into: str, phrase: str = "phrase", value: str = "value", first: bool = False, most: int = BLOCK_PHRASES) -> DataFrame:
    """``rows`` with the value of the longest spelling that a text has as whole words; null without one.

    Of spellings of one length the one that comes first in the text decides, then the smaller value; with ``first``
    the place in the text decides before the length. The rows themselves pass by the automaton: nothing is joined or shuffled.
    """
    out = rows.withColumn(into, F.lit(None).cast(phrases.schema[value].dataType)).withColumn("_best", F.lit(None).cast("array<long>"))
    for spellings in blocks(phrases, phrase, value, most):
        sent = rows.sparkSession.sparkContext.broadcast(spellings)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            made = automaton(sent.value)
            for batch in batches:
                best, values = batch.column("_best").to_pylist(), batch.column(into).to_pylist()
                for k, t in enumerate(batch.column("_text").to_pylist()):
                    own = [((begin, -len(p)) if first else (-len(p), begin), p) for begin, p in found_in(made, t, True)]
                    if own:
                        rank, p = min(own)
                        new = sent.value[p][0]
                        if best[k] is None or list(rank) < best[k] or list(rank) == best[k] and new < values[k]:
                            best[k], values[k] = list(rank), new
                made_columns = {into: pa.array(values, batch.schema.field(into).type), "_best": pa.array(best, pa.list_(pa.int64()))}
                names = [n for n in batch.schema.names if n != "_text"]
                yield pa.RecordBatch.from_arrays([made_columns.get(n, batch.column(n)) if n in made_columns else batch.column(n) for n in names], names)

        out = out.withColumn("_text", plain(text)).mapInArrow(run, out.schema)
    return out.drop("_best")
