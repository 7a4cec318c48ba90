"""Collections, wishes, reference tables, queues and orders on rows made by hand."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from larkspur.operators import collection, matching, reference
from larkspur.plans import orders
from larkspur.plans.filters import FilterSpec

T0 = datetime(2024, 1, 1)


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_paired_totals_and_series(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", None, 5.0), ("a", 3.0, 4.0), ("b", 1.0, None)], "k string, c double, v double")
    assert rows(collection.paired_totals(df, ["k"], "c", "v")) == [("a", 4.0, 6.0, 2, 1), ("b", None, None, 0, 1)]
    taken = spark.createDataFrame([("a", T0, 1.0), ("b", T0, None), ("a", T0 + timedelta(days=9), 2.0)], "k string, recorded_at timestamp_ntz, v double")
    assert rows(collection.series(taken, F.to_date("recorded_at"), "v"))[0][1:] == (1.0, 1)
    due = collection.snapshots_due(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), taken, "k", T0 + timedelta(days=10))
    assert [r.k for r in due.orderBy("k").collect()] == ["b", "c"]


def test_want_list_news(spark):
    old, new = T0 - timedelta(days=9), T0 + timedelta(days=1)
    made = [
        ("new", 5.0, None, new, None, None, True), ("old", 4.0, None, old, None, None, True), ("cheaper", 3.0, 4.0, old, new, None, True), ("dearer", 5.0, 4.0, old, new, None, True),
        ("cut long ago", 3.0, 4.0, old, old, None, True), ("back", 6.0, None, old, None, new, True), ("gone", 5.0, None, new, None, None, False), ("told", 5.0, None, new, None, None, True), ("no price", None, 4.0, old, new, None, True),
    ]
    df = spark.createDataFrame([(i, "ring", p, q, f, c, b, a, False) for i, p, q, f, c, b, a in made], "item string, title string, price double, previous_price double, first_seen timestamp_ntz, price_changed_at timestamp_ntz, restocked_at timestamp_ntz, active boolean, sold boolean")
    specs = {"up": FilterSpec.from_query_string("q=ring&sort=price_asc&status=sold"), "down": FilterSpec.from_query_string("sort=price_desc"), "silent": FilterSpec()}
    told = spark.createDataFrame([("up", "told"), ("up", "told"), ("down", "new")], "search string, item string")
    hits = collection.want_hits(df, specs, {"up": T0, "down": T0, "silent": None}, told)
    assert sorted((r.search, r.item) for r in hits.collect()) == [("down", "back"), ("down", "cheaper"), ("down", "told"), ("up", "back"), ("up", "cheaper"), ("up", "new")]
    got = sorted(tuple(r) for r in collection.want_news(hits, specs, 2).select("search", "place", "item", "fresh").collect())
    assert got == [("down", 1, "back", 3), ("down", 2, "told", 3), ("up", 1, "cheaper", 3), ("up", 2, "new", 3)]
    assert collection.want_news(hits.limit(0), specs).count() == 0 and collection.want_hits(df, {}, {}, told).count() == 0


def test_saved_searches(spark):
    df = spark.createDataFrame([("i1", "red ring", 5.0), ("i2", "blue ring", None)], "item string, title string, price double")
    specs = {"rings": FilterSpec(text="ring"), "cheap": FilterSpec.from_query_string("max_price=6"), "none": FilterSpec(text="anvil")}
    found = collection.saved_matches(df, specs)
    assert rows(found) == [("cheap", "i1"), ("rings", "i1"), ("rings", "i2")]
    assert rows(collection.untold(found, spark.createDataFrame([("rings", "i1"), ("rings", "i1")], "search string, item string"))) == [("cheap", "i1"), ("rings", "i2")]


def test_wish_totals(spark):
    listings = spark.createDataFrame([("a", 1, 100.0, True, False), ("b", 1, 50.0, True, False), ("c", 2, 10.0, True, False), ("d", 2, 10.0, True, True)], "item string, source int, price double, active boolean, sold boolean")
    wishes = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "c"), ("r", "d"), ("s", "c")], "reader string, item string")
    shipping = spark.createDataFrame([(1, 5.0)], "source int, shipping double")
    assert rows(collection.wish_totals(wishes, listings, shipping, 20.0, 120.0)) == [("r", 3, 160.0, 190.0, False), ("s", 1, 10.0, 30.0, False)]


def test_fits_of_several_models(spark):
    owned = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "b"), (4, "a"), (4, "b"), (5, None)], "owned int, model string")
    accessories = spark.createDataFrame([(10, 100.0, True, ["a"]), (10, 1.0, False, ["b"]), (11, 50.0, True, ["a"]), (12, 60.0, True, ["a", "b"]), (13, None, True, ["b"])], "accessory int, price double, in_stock boolean, lines array<string>")
    both = [(1, 10, 1.0, True, 1), (1, 11, 50.0, True, 2)]
    want = [*both, (2, 11, 50.0, True, 1), (2, 12, 60.0, True, 2), (3, 12, 60.0, True, 1), (3, 13, None, True, 2), *[(4, *x[1:]) for x in both]]
    assert rows(collection.fits(owned, accessories, 2)) == sorted(want, key=str)


def test_fits_ranks_each_set_of_models_once(spark):
    owned = spark.range(3000).selectExpr("id AS owned", "id % 2 AS model")
    accessories = spark.range(3000).selectExpr("id AS accessory", "cast(id AS double) AS price", "true AS in_stock", "array(id % 2) AS lines")
    out = collection.fits(owned, accessories, 4)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.index("Join") < plan.index("Window")  # ranked below the join with the items: a plan lists what is below later
    assert out.count() == 12000


def test_rename_and_undo(spark):
    table = spark.createDataFrame([(1, "Old", ["o", "New"]), (2, "Same", [])], "id int, name string, aliases array<string>")
    names = spark.createDataFrame([(1, "New"), (2, "Same")], "id int, new string")
    assert rows(reference.rename(table, names, "id")) == [(1, "New", ["Old", "o"]), (2, "Same", [])]
    log = reference.logged(table, "id", "rename", 3)
    assert rows(reference.reverted(reference.rename(table, names, "id").where("id = 1"), log, "id", 3)) == rows(table)
    assert rows(reference.reverted(table, log, "id", 9)) == rows(table)


def test_rekey(spark):
    known = spark.createDataFrame([("old1", 1), ("old2", 2), ("stays", 3), ("here", 4)], "k string, first_seen int")
    read = spark.createDataFrame([("new", ["old1", "old2"]), ("stays", []), ("here", ["stays"]), ("also", ["old1"])], "k string, replaces array<string>")
    assert sorted(r.k for r in reference.rekeyed(known, read, "k").collect()) == ["also", "here", "new", "stays"]


def test_rekey_within_a_shop(spark):
    known = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (None, "a", 3)], "shop int, k string, first_seen int")
    read = spark.createDataFrame([(0, "b", ["a"]), (1, "c", ["b"]), (None, "d", ["a"])], "shop int, k string, replaces array<string>")
    assert rows(reference.rekeyed(known, read, "k", ["shop"]).select("first_seen", "k")) == [(1, "b"), (2, "c"), (3, "d")]


def test_near_bits(spark):
    df = spark.createDataFrame([(0,), (0,), (0xFFFF,), (-1,), (0x1FFFF,), (None,)], "b long")
    assert rows(matching.near_bits(df, "b", 16)) == [(0, 0xFFFF, 16, 2, 1), (0xFFFF, 0x1FFFF, 1, 1, 1)]
    copies = spark.range(300).selectExpr("7L as b")
    assert matching.near_bits(copies, "b", 16).count() == 0


def test_within_tolerance_keeps_equal_rows(spark):
    variants = spark.createDataFrame([("k", "v1", 5.0), ("k", "v2", 9.0), ("k", "v2", 9.0)], "k string, variant string, size double")
    df = spark.createDataFrame([("k", 5.5), ("k", 5.5), ("k", 7.0), ("k", 9.9), ("k", None), ("x", 5.0)], "k string, size double")
    assert rows(matching.within_tolerance(df, variants, ["k"], "size", 2.0)) == [("k", 5.5, "v1"), ("k", 5.5, "v1"), ("k", 9.9, "v2")]


def test_orders_and_cover(spark):
    df = spark.createDataFrame([("a10",), ("a9",), ("A09b",), ("b1",)], "t string")
    assert [r.t for r in df.orderBy(orders.natural(F.col("t")), "t").collect()] == ["a9", "A09b", "a10", "b1"]
    long = ["a2", "a10", "a2000000000000", "a10000000000000000", "a" + "9" * 30, "a1" + "0" * 30]
    assert [r.t for r in spark.createDataFrame([(t,) for t in long[::-1]], "t string").orderBy(orders.natural(F.col("t"))).collect()] == long
    assert [r.t for r in df.orderBy(*orders.prefix_first(F.col("t"), "B")).collect()][0] == "b1"
    assert [r[0] for r in df.select(orders.by_list(F.col("t"), ["b1", "a9"])).collect()] == [3, 2, 3, 1]
    rows = lambda groups: spark.createDataFrame([(g, v, n) for g, x in groups.items() for v, n in x.items()], "facet string, value string, n long")
    cover = lambda groups: {(r.facet, r.value, r.enough) for r in orders.cover(rows(groups), 50).collect()}
    assert cover({"size": {"s": 40, "l": 50}, "brand": {"x": 30, "y": 30, "z": 40}, "year": {"old": 100}}) == {("brand", "x", True), ("brand", "y", True), ("brand", "z", True)}
    assert cover({"year": {"old": 100, "new": 20}}) == {("year", "new", False)}
    assert cover({"a": {"x": 51, "y": 49}, "b": {"p": 60, "q": 10}}) == {("a", "y", False), ("b", "q", False)}
    assert cover({"a": {}}) == set()


def test_near_bits_of_many_hashes(spark):
    hashes = [(k * 0x9E3779B97F4A7C15 + (k % 7 << 60)) % 2**64 - 2**63 for k in range(400)] + [k * 3 for k in range(60)] + [-1, -1, None]
    df = spark.createDataFrame([(h,) for h in hashes], "b long")
    n = {h: hashes.count(h) for h in hashes if h is not None}
    apart = lambda a, b: bin((a ^ b) % 2**64).count("1")
    out = matching.near_bits(df, "b", 16)
    assert rows(out) == sorted(((a, b, apart(a, b), n[a], n[b]) for a in n for b in n if a < b and apart(a, b) <= 16), key=str)
    assert "broadcast" not in out._jdf.queryExecution().executedPlan().toString().lower()  # nothing of the hashes goes by the driver
    assert matching.near_bits(df.limit(0), "b", 16).count() == 0
