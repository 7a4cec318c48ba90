"""Matching rows to reference tables: rules, ranges, tolerances, tokens, votes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import tokens
from ..written import cut


def rule_hits(rows: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """``key, position, value, weight`` for each rule whose spelling is among the words of a text (or is a phrase in it).

    ``rules``: position, spelling, value. Spellings of one word meet the text's words in an equi-join; only phrases are
    looked for in whole texts, and only in those that have the phrase's first word.
    """
    spelled = rules.select("position", "value", F.lower("spelling").alias("spelling"))
    spelled = spelled.withColumn("word", F.regexp_extract("spelling", "^([a-z0-9]+)", 1)).withColumn("weight", F.length(F.regexp_replace("spelling", "[^a-z0-9]", "")))
    words = rows.select(key, F.lower(text).alias("_text"), F.explode(tokens(F.col(text), shortest=1)).alias("word"))
    padded = F.concat(F.lit(" "), F.regexp_replace("_text", "[^a-z0-9]+", " "), F.lit(" "))
    phrase = F.concat(F.lit(" "), F.regexp_replace("spelling", "[^a-z0-9]+", " "), F.lit(" "))
    found = words.join(spelled, "word").where((F.col("spelling") == F.col("word")) | F.contains(padded, phrase))
    return found.select(key, "position", "value", "weight")


def first_match(rows: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """The value of the first rule in the table's order that matches."""
    return rule_hits(rows, key, text, rules).groupBy(key).agg(F.min_by("value", "position").alias("value"))


def longest_match(rows: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """The value of the rule with the most letters and digits; of equally long ones the earlier."""
    hits = rule_hits(rows, key, text, rules)
    return hits.groupBy(key).agg(F.max_by("value", F.struct("weight", -F.col("position"))).alias("value"), F.max("weight").alias("weight"))


def canonical(rows: DataFrame, name: str, aliases: DataFrame, into: str = "canonical") -> DataFrame:
    """``rows`` with the canonical name of ``name``: its exact spelling first, then one without case and punctuation.

    ``aliases``: alias, canonical. A forgiving spelling that two names claim decides nothing.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    exact = aliases.groupBy("alias").agg(F.min("canonical").alias("_exact"))
    loose = aliases.groupBy(plain(F.col("alias")).alias("_plain")).agg(F.min("canonical").alias("_loose"), F.count_distinct("canonical").alias("_claims")).where("_claims = 1").drop("_claims")
    out = rows.withColumn("_plain", plain(F.col(name))).join(exact, F.col(name) == F.col("alias"), "left").join(loose, "_plain", "left")
    return out.withColumn(into, F.coalesce("_exact", "_loose")).drop("_plain", "alias", "_exact", "_loose")


def contested(aliases: DataFrame) -> DataFrame:
    """Spellings claimed by more than one name."""
    return aliases.groupBy("alias").agg(F.count_distinct("canonical").alias("claims")).where("claims > 1")


def in_ranges(points: DataFrame, ranges: DataFrame, keys: list[str], value: str, bucket: int) -> DataFrame:
    """Points with the ranges ``[low, high]`` of the same keys that hold them.

    Ranges are cut into buckets of a fixed width, which join by equality, so that no point is compared with
    all ranges of its key.
    """
    cut = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col("low") / bucket), F.floor(F.col("high") / bucket))))
    here = points.withColumn("_b", F.floor(F.col(value) / bucket))
    return here.join(cut, [*keys, "_b"]).where(F.col(value).between(F.col("low"), F.col("high"))).drop("_b")


def bracket(points: DataFrame, evidence: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """For each point the nearest evidence below and above (strictly), in one pass over the sorted union from each end.

    ``below_at, below, above_at, above``: null where there is none.
    """
    known = F.struct(F.col(at).alias("at"), F.col(value).alias("value"))
    both = points.select(key, at, "point", F.lit(None).alias("_e").cast(evidence.select(known.alias("x")).schema["x"].dataType)).unionByName(
        evidence.select(key, at, F.lit(None).cast(points.schema["point"].dataType).alias("point"), known.alias("_e"))
    )
    upto = lambda order: Window.partitionBy(key).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    low = F.max("_e").over(upto(F.col(at).asc()))
    high = F.min("_e").over(upto(F.col(at).desc()))  # from the other end: a frame that only grows is summed up once, one that shrinks anew for each row
    out = both.withColumn("_low", low).withColumn("_high", high).where("point is not null")
    return out.select(key, at, "point", F.col("_low.at").alias("below_at"), F.col("_low.value").alias("below"), F.col("_high.at").alias("above_at"), F.col("_high.value").alias("above"))


def unanimous(rows: DataFrame, key: str, value: str, source: str, least: int = 5, sources: int = 2) -> DataFrame:
    """Keys whose rows all agree on one value, with enough rows from enough sources."""
    stated = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    votes = stated.groupBy(key).agg(F.min(value).alias("value"), F.max(value).alias("_max"), F.count("*").alias("rows"), F.count_distinct(source).alias("sources"))
    return votes.where((F.col("value") == F.col("_max")) & (F.col("rows") >= least) & (F.col("sources") >= sources)).drop("_max")


def usual(rows: DataFrame, key: str, value: str, yields: int | None = None, share: float = 1 / 3, agreeing: int = 2) -> DataFrame:
    """The most common value of each key (the smaller of equals), agreed on by enough rows.

    The value ``yields`` gives way to the most common larger one that has two rows and a share of all.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    rank = F.struct("n", -F.col("value"))
    agg = [F.sum("n").alias("all"), F.max(F.struct(F.col("n"), -F.col("value"), F.col("value").alias("v"))).alias("top")]
    if yields is not None:
        agg.append(F.max(F.when(F.col("value") > yields, F.struct(rank.alias("r"), F.col("value").alias("v"), F.col("n").alias("m")))).alias("larger"))
    out = counts.groupBy(key).agg(*agg).where(F.col("top.n") >= agreeing)
    chosen = F.col("top.v")
    if yields is not None:
        enough = (F.col("larger.m") >= 2) & (F.col("larger.m") >= share * F.col("all"))
        chosen = F.when((chosen == yields) & F.coalesce(enough, F.lit(False)), F.col("larger.v")).otherwise(chosen)
    return out.select(key, chosen.alias("value"), F.col("top.n").alias("n"), "all")


def best_donors(rows: DataFrame, key: str, source: str, text: str, wanted: Column, donor: Column, noise: list[str] = (), score: float = 1.5, shared: int = 2, overlap: float = 0.34) -> DataFrame:
    """For each row that wants something, the row of another source with the highest sum of shared words' rarities.

    Rarity is log(N / df) / log(N). Rows with the same set of words and source are one class, so that copies
    never meet each other one by one. Two classes meet only on words of their prefixes: the rarest words of a class, as far
    as the rest could not reach the score by itself; common words make no pairs, and no pair that scores is lost.
    """
    words = rows.select(key, source, wanted.alias("wants"), donor.alias("gives"), F.array_sort(tokens(F.col(text), noise)).alias("words"))
    sets = words.groupBy(source, "words").agg(F.min(F.when(F.col("gives"), F.col(key))).alias("giver"))
    titles = sets.groupBy("words").agg(F.count("*").alias("_n"))
    total = titles.count()
    df = titles.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    rarity = F.log(F.lit(float(total)) / F.col("df")) / F.log(F.lit(float(max(total, 2))))
    weighted = df.select("word", rarity.alias("rarity"))
    tail = F.sum("rarity").over(Window.partitionBy("words").orderBy("rarity", "word"))
    prefix = titles.select("words", F.explode("words").alias("word")).join(weighted, "word").withColumn("_tail", tail).where(F.col("_tail") >= score - 1e-9)
    pairs = prefix.select("word", F.col("words").alias("a")).join(prefix.select("word", F.col("words").alias("b")), "word").select("a", "b").distinct()
    common = F.array_intersect("a", "b")
    cells = pairs.select("a", "b", F.size(common).alias("shared"), F.explode(common).alias("word")).join(weighted, "word")
    scored = cells.groupBy("a", "b").agg(F.max("shared").alias("shared"), F.sum("rarity").alias("score"))
    scored = scored.where((F.col("shared") >= shared) & (F.col("score") >= score) & (F.col("shared") / F.least(F.size("a"), F.size("b")) >= overlap))
    wanting = words.where("wants").select(source, F.col("words").alias("a")).distinct()
    offers = wanting.join(scored, "a").join(sets.where("giver is not null").select(F.col(source).alias("_from"), F.col("words").alias("b"), "giver"), "b").where(F.col("_from") != F.col(source))
    best = offers.groupBy(source, "a").agg(F.max(F.struct(F.bround("score", 9).alias("score"), (-F.col("shared")).alias("s"))).alias("top"), F.min(F.struct(-F.bround("score", 9), F.col("giver"))).alias("x"))
    wants = words.where("wants").select(key, source, F.col("words").alias("a"))
    return wants.join(best, [source, "a"]).select(key, F.col("x.giver").alias("donor"), F.bround(F.col("top.score"), 6).alias("score"))


def corroborated(rows: DataFrame, name: Column, key: str, least: int = 3) -> DataFrame:
    """Names read out of texts that enough different rows have."""
    named = rows.select(key, name.alias("name")).where("name is not null and name <> ''").distinct()
    return named.groupBy("name").agg(F.count("*").alias("sightings")).where(F.col("sightings") >= least)


def within_tolerance(rows: DataFrame, variants: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """``rows`` with the variant of the same keys within a tolerance, where exactly one fits; each of equal rows is kept.

    The variants are found once for each distinct (keys, value). Both sides meet in buckets as wide as the tolerance, so
    that a value is compared only with variants of its own and the two neighbouring buckets.
    """
    bucket = lambda c: F.floor(c / F.lit(tolerance))
    asked = rows.select(*keys, value).distinct().withColumn("_b", F.explode(F.sequence(bucket(F.col(value)) - 1, bucket(F.col(value)) + 1)))
    offered = variants.select(*keys, F.col(value).alias("_v"), "variant").distinct().withColumn("_b", bucket(F.col("_v")))
    fits = asked.join(offered, [*keys, "_b"]).where(F.abs(F.col(value) - F.col("_v")) <= tolerance)
    one = fits.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min("variant").alias("variant")).where("_n = 1").drop("_n")
    return rows.join(one, [*keys, value]).select(*rows.columns, "variant")


def lows_by_weight(offers: DataFrame, wanted: DataFrame, key: str, weight: str, price: str, share: float = 0.03) -> DataFrame:
    """The lowest price within 3 % of each wanted weight of a key, and how many offers there are.

    Offers are summed up by weight first. Weights meet in buckets of their logarithm that are as wide as the share, so that
    a wanted weight is compared with its own and the two neighbouring buckets only. Weights of nothing and below meet none.
    """
    width = -math.log(1 - share)
    bucket = lambda w: F.floor(F.log(w) / F.lit(width))
    found = offers.where(F.col(weight) > 0).groupBy(key, weight).agg(F.min(price).alias("_low"), F.count("*").alias("_n")).withColumn("_b", bucket(F.col(weight)))
    asked = wanted.where(F.col(weight) > 0).select(key, F.col(weight).alias("_w")).distinct().withColumn("_b", F.explode(F.sequence(bucket(F.col("_w")) - 1, bucket(F.col("_w")) + 1)))
    near = asked.join(found, [key, "_b"]).where(F.abs(F.col(weight) - F.col("_w")) <= share * F.col("_w"))
    return near.groupBy(key, F.col("_w").alias(weight)).agg(F.bround(F.min("_low"), 4).alias("low"), F.sum("_n").alias("offers"))


def diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """What a new version of a table adds, removes and changes: key, change, and the names of the changed fields."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), f) for f in fields]))
    kind = F.when(F.col(f"o.{key}").isNull(), "added").when(F.col(f"n.{key}").isNull(), "removed").when(F.size(changed) > 0, "changed")
    out = both.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), kind.alias("change"), F.when(kind == "changed", F.array_join(changed, ",")).otherwise("").alias("fields"))
    return out.where("change is not null")


def merge_rows(table: DataFrame, merges: DataFrame, key: str, aliases: str) -> DataFrame:
    """Reference rows after merges (``loser, winner``): the winner takes the losers' aliases, the losers point to it."""
    points = table.join(merges, table[key] == merges.loser, "left").withColumn("into", F.coalesce("winner", key))
    union = points.groupBy("into").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(aliases)))).alias("_all"))
    out = points.drop("loser", "winner").join(union.withColumnRenamed("into", "_into"), points[key] == F.col("_into"), "left")
    return out.withColumn(aliases, F.when(F.col("into") == F.col(key), F.col("_all")).otherwise(F.array().cast("array<string>"))).drop("_all", "_into")


def delivered(rows: DataFrame, shipping: DataFrame, source: str, price: str, fee: float | None) -> DataFrame:
    """Price with shipping and fee; what is unknown counts as nothing and marks the sum incomplete."""
    out = rows.join(shipping, source, "left")
    total = F.col(price) + F.coalesce("shipping", F.lit(0.0)) + (0.0 if fee is None else fee)
    complete = F.col("shipping").isNotNull() & F.lit(fee is not None)
    return out.withColumn("delivered", F.when(F.col(price) > 0, F.bround(total, 2))).withColumn("complete", F.when(F.col(price) > 0, complete))


#: Hashes of a block that is compared with another one, and at least so many blocks.
BLOCK_HASHES, LEAST_BLOCKS = 16_384, 16
#: Distances that are held at once.
STRIP = 2_000_000


def near_bits(rows: DataFrame, bits: str, distance: int) -> DataFrame:
    """``a, b, distance, rows_a, rows_b``: distinct 64-bit hashes ``a < b`` at most ``distance`` bits apart, and how many rows have each.

    Equal hashes are one class, whose rows are never paired with each other: join the classes back to the rows by hash for
    membership. At a distance like 16 of 64 no key of bits keeps a hash from meeting most others, so all distinct hashes are
    compared, in packed blocks: every two blocks are a row of a shuffled join, and a task holds two blocks and a strip of
    their distances. Time is the square of the number of distinct hashes (a few nanoseconds a pair), memory is not.
    """
    spark = rows.sparkSession
    hashes = cut(rows.where(F.col(bits).isNotNull()).groupBy(F.col(bits).cast("long").alias("h")).agg(F.count("*").alias("n")), "hashes")
    number = max(LEAST_BLOCKS, -(-hashes.count() // BLOCK_HASHES))
    tasks = min(number * (number + 1) // 2, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "h": [table.column("h").to_numpy().tobytes()], "n": [table.column("n").to_numpy().tobytes()]})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                i, j = batch.column("i")[k].as_py(), batch.column("j")[k].as_py()
                (x, m), (y, n) = [[np.frombuffer(batch.column(c)[k].as_buffer(), np.int64) for c in names] for names in (("h", "n"), ("_h", "_n"))]
                strip = max(1, STRIP // max(len(y), 1))
                for start in range(0, len(x), strip):
                    apart = np.bitwise_count((x[start : start + strip, None] ^ y[None, :]).view(np.uint64))  # of a signed number the size is counted
                    p, q = np.nonzero(apart <= distance)
                    p, d = p + start, apart[p, q]
                    if i == j:  # each two once
                        own = p < q
                        p, q, d = p[own], q[own], d[own]
                    if len(p):
                        turned = x[p] > y[q]
                        made = [np.where(turned, y[q], x[p]), np.where(turned, x[p], y[q]), d.astype(np.int32), np.where(turned, n[q], m[p]), np.where(turned, m[p], n[q])]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], ["a", "b", "distance", "rows_a", "rows_b"])

    packed = cut(hashes.withColumn("block", F.pmod(F.xxhash64("h"), F.lit(number)).cast("int")).groupBy("block").applyInArrow(pack, "block int, h binary, n binary"), "blocks")
    first = packed.select(F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(number - 1))).alias("j"), "h", "n")
    second = packed.select(F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("h").alias("_h"), F.col("n").alias("_n"))
    cells = first.repartition(tasks, "i", "j").join(second.repartition(tasks, "i", "j").hint("merge"), ["i", "j"])
    return cells.mapInArrow(compare, "a long, b long, distance int, rows_a long, rows_b long")
