"""What the readers make of sentences."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from larkspur.operators import reading as R


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).first().x


TRAITS = [
    ("import_marked", "Small import mark under the barrel.", True),
    ("import_marked", "No visible import marks.", False),
    ("import_marked", "No import marks on the receiver; small import stamp on the barrel.", True),
    ("import_marked", "There may be an import mark.", None),
    ("import_marked", "Collectors look for those without import marks", None),
    ("import_marked", "No pitting and an import mark on the barrel", True),
    ("import_marked", "A fine rifle", None),
    ("numbers_match", "All matching numbers.", True),
    ("numbers_match", "Matching numbers except the bolt.", False),
    ("numbers_match", "All matching. Mismatched magazine.", False),
    ("numbers_match", "The bolt does not match.", False),
    ("numbers_match", "Numbers are not matching", False),
    ("refinished", "It has been refinished.", True),
    ("refinished", "Never refinished.", False),
    ("refinished", "Appears to be an old refinish.", None),
    ("refinished", "Original blued finish.", False),
    ("refinished", "The refinished stock is nice.", None),
]


@pytest.mark.parametrize(("trait", "text", "value"), TRAITS)
def test_traits(spark, trait, text, value):
    got = one(spark, text, R.TRAITS[trait].read)
    assert got.value is value and (got.quote is None) == (value is None)


def test_null_texts(spark):
    assert one(spark, None, R.TRAITS["import_marked"].read).value is None
    for f in (R.overall_grade, R.finish_percent, R.made, R.serial, R.offer, R.without_notices, R.bore_grade):
        assert one(spark, None, f) is None


def test_grades(spark):
    words = {"Excellent+": "excellent", "very  good plus": "very good", "Poor to Fair": "poor", "near-mint": "like new", "NEW": "like new", "odd": None, "good to odd": "good"}
    for word, want in words.items():
        assert one(spark, word, R.grade) == want, word
    assert one(spark, "Overall condition is very good. Bore is dark.", R.overall_grade) == "very good"
    assert one(spark, "The rifle is in fair to good condition", R.overall_grade) == "fair"
    assert one(spark, "in good working order", R.overall_grade) is None
    assert one(spark, "Overall excellent. The bore is fair", R.bore_grade) == "fair"
    assert one(spark, "Retains 93-94% of its original finish", R.finish_percent) == 93
    assert one(spark, "Retains 3% finish", R.finish_percent) is None


def test_years(spark):
    assert tuple(one(spark, "Manufactured in 1917 by x", R.made)) == (1917, 1917)
    assert tuple(one(spark, "made from 1941 to 1944", R.made)) == (1941, 1944)
    assert tuple(one(spark, "circa 1920s", R.made)) == (1920, 1929)
    assert tuple(one(spark, "C&R eligible, dated 1990", R.curio)) == (True, None)
    assert tuple(one(spark, "Not C&R eligible", R.curio)) == (False, None)
    assert tuple(one(spark, "receiver dated 1943, rebuilt and dated 1955", R.curio)) == (None, 1943)
    assert tuple(one(spark, "Replica of an 1858", R.curio)) == (None, None)
    kind = "m int, t int, s string, c boolean"
    df = spark.createDataFrame([(1950, 1990, "stated", None), (1950, 1990, "serial", None), (None, 1960, "serial", None), (None, None, None, None), (1999, None, None, True), (1900, None, None, False)], kind)
    got = [r[0] for r in df.select(R.verdict(F.col("c"), R.judged_year(F.col("m"), F.col("t"), F.col("s")), 2024)).collect()]
    assert got == ["not_eligible", "eligible", "eligible", "unknown", "eligible", "not_eligible"]


def test_measures(spark):
    def barrel(t, d=None):
        return spark.createDataFrame([(t, d)], "t string, d string").select(R.barrel_inches(F.col("t"), F.col("d"))).first()[0]

    def rounds(t, d=None):
        return spark.createDataFrame([(t, d)], "t string, d string").select(R.capacity(F.col("t"), F.col("d"))).first()[0]

    assert barrel('Rifle 16.5" barrel') == 16.5 and barrel("x", "Barrel length: 4 1/2 in") == 4.5 and barrel("6 inch round barrel", "barrel 9 inches") == 6.0
    assert barrel("no length") is None and barrel('99" barrel') is None
    assert rounds("with 20rnd magazine") == 20 and rounds("x", "Capacity: 8") == 8 and rounds("15+1") == 15 and rounds("900 rounds") is None
    assert tuple(one(spark, "Serial number AB-1234XX", R.serial)) == ("AB", 123400, 123499)
    assert one(spark, "no number", R.serial) is None


def test_offers(spark):
    got = one(spark, "Take 15% off! Use code AUTUMN15 today, just for you", R.offer)
    assert tuple(got) == ("15% off", "AUTUMN15", True)
    assert one(spark, "New arrivals. Code of conduct", R.offer) is None
    sent = F.lit(datetime(2024, 12, 20, 12)).cast("timestamp")
    end = lambda t: spark.createDataFrame([(t,)], "t string").select(F.date_format(R.offer_end(F.col("t"), sent), "yyyy-MM-dd HH:mm")).first()[0]
    assert end("valid for 24 hours") == "2024-12-21 12:00" and end("good for 3 days") == "2024-12-23 12:00"
    assert end("ends 12/24") == "2024-12-25 04:59" and end("through 1/5") == "2025-01-06 04:59" and end("no end") is None


def test_notices(spark):
    text = "A fine old rifle with a bright bore and good wood, all matching. It shoots well. No returns. All sales are final."
    assert one(spark, text, R.without_notices).endswith("It shoots well.")
    assert one(spark, "Nice. All sales final.", R.without_notices) == "Nice. All sales final."
    assert one(spark, "One sentence", R.without_notices) == "One sentence"


def test_kinds_and_provenance(spark):
    df = spark.createDataFrame([(False, None, True, False, True, False), (False, False, False, False, False, False)], ", ".join(f"is_{k} boolean" for k in R.Kinds().order))
    got = df.select(R.Kinds().single().alias("a"), R.Kinds().several(F.lit(True)).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [("carry", ["carry", "pistol"]), (None, [])]
    rows = spark.createDataFrame([("a", "vendor", "b"), ("a", "derived", "b"), (None, None, "b"), ("a", "vendor", None)], "v string, s string, f string")
    call = lambda mode: [tuple(r[0]) for r in rows.select(R.provenance(F.col("v"), F.col("s"), F.col("f"), "derived", mode)).collect()]
    assert call("fill") == [("a", "vendor"), ("a", "derived"), ("b", "derived"), ("a", "vendor")]
    assert call("claim") == [("a", "vendor"), ("b", "derived"), ("b", "derived"), ("a", "vendor")]
    assert call("respell") == [("b", "vendor"), ("b", "derived"), ("b", None), ("a", "vendor")]


def test_trait_filter_and_table(spark):
    df = spark.createDataFrame([("r1", "No import marks. All matching."), ("r2", "Import marked."), ("r3", None)], "title string, description string")
    out = R.read_traits(df)
    assert {r.title: (r.import_marked, r.numbers_match) for r in out.collect()} == {"r1": (False, True), "r2": (True, None), "r3": (None, None)}
    assert [r.title for r in out.where(R.trait_filter({"import_marked": [False], "numbers_match": [True, False]})).collect()] == ["r1"]


@pytest.mark.parametrize("name", ["read_measures", "enrich_listings", "reclassify_listings"])
def test_rows_are_dealt_over_all_cores(spark, name):
    from larkspur import queries

    assert queries.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
