"""Expressions and order statistics against plain Python."""

import random
import statistics

from pyspark.sql import functions as F

from larkspur.functions import columns as C
from larkspur.functions.ranks import nearest_ranks, spread


def values(spark, rows, kind, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", expression(F.col("v")).alias("x")).collect())]


def test_rounding_and_cents(spark):
    assert values(spark, [0.5, 1.5, 2.5, -0.5], "double", C.half_even) == [round(x) for x in (0.5, 1.5, 2.5, -0.5)]
    assert values(spark, [9.99, 12.345, None], "double", C.cents) == [999, round(12.345 * 100), None]


def test_money_and_numbers(spark):
    assert values(spark, ["$1,234.50", "now 12", "$0.00", "none", None, "was $5 now $4"], "string", C.money) == [1234.5, 12.0, None, None, None, 5.0]
    assert values(spark, ["4 1/2", "4-1/2 in", "4½", "16.5", "1/2", "x", None], "string", C.mixed_number) == [4.5, 4.5, 4.5, 16.5, 0.5, None, None]
    assert values(spark, ["made 1943, sold 2001", "12345 1699", ""], "string", C.years) == [[1943, 2001], [], []]


def test_text(spark):
    assert values(spark, ["  a \n b  ", "", None], "string", C.collapse_space) == ["a b", "", None]
    assert values(spark, ["short", "a longer line of words", "unbrokenunbroken"], "string", lambda c: C.truncate_words(c, 10)) == ["short", "a longer…", "unbrokenun…"]
    assert values(spark, ["The Red-Red RING of a 98k", None], "string", lambda c: C.tokens(c, ["the"])) == [["red", "ring", "98k"], []]
    assert values(spark, ["https://shop.Example.com:80/x", "//a.b.co/", "no url", None], "string", C.registrable_domain) == ["example.com", "b.co", None, None]


def test_unknown_and_exclusion(spark):
    rows = ["a", "b", "", None]
    assert values(spark, rows, "string", lambda c: C.in_with_unknown(c, ["a", "Unknown"])) == [True, False, True, True]
    assert values(spark, rows, "string", lambda c: C.not_in_with_unknown(c, ["a"])) == [False, True, True, True]
    assert values(spark, rows, "string", lambda c: C.not_in_with_unknown(c, ["a", "Unknown"])) == [False, True, False, False]
    assert values(spark, rows, "string", lambda c: C.in_with_unknown(c, [])) == [False] * 4


def test_days(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-03 11:00:00' AS b, timestamp_ntz'2024-01-01 12:00:00' AS a")
    row = df.select(C.days_between(F.col("b"), F.col("a")), C.whole_days(F.col("b"), F.col("a")), C.hamming(F.lit(5), F.lit(6)), C.backoff(F.lit(3), 60.0, 200.0), C.backoff(F.lit(0), 60.0, 200.0)).first()
    assert abs(row[0] - 47 / 24) < 1e-9 and tuple(row[1:]) == (1, 2, 200.0, 0.0)


def test_nearest_ranks(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([1.5, 2.0, 3.25, 7.0, rng.random()])) for g in range(1, 60) for _ in range(g)] + [(60, None)]
    fractions = {"a": 0.02, "b": 0.1, "c": 0.5, "d": 0.75, "e": 0.98}
    got = {r.g: r for r in nearest_ranks(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", fractions).collect()}
    assert 60 not in got
    for g in range(1, 60):
        ordered = sorted(v for k, v in rows if k == g)
        assert [got[g][n] for n in fractions] == [ordered[round(f * (len(ordered) - 1))] for f in fractions.values()]
        assert got[g].n == g


def test_spread(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("y", 3)], "k string, s int")
    assert {tuple(r) for r in spread(df, ["k"], "s").collect()} == {("x", 2, 0.667), ("y", 1, 1.0)}


def test_medians_agree(spark):
    rows = [(i % 3, float(i * 7 % 11)) for i in range(40)]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "g int, v double").groupBy("g").agg(F.median("v")).collect()}
    assert got == {g: statistics.median(v for k, v in rows if k == g) for g in range(3)}
