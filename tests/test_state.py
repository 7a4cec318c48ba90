"""Merging, news, guards and matching on rows made by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larkspur.operators import market, matching, state

T0 = datetime(2024, 1, 1)


def at(days):
    return T0 + timedelta(days=days)


KNOWN = "item string, title string, price double, previous_price double, sold boolean, active boolean, first_seen timestamp_ntz, last_seen timestamp_ntz, sold_at timestamp_ntz, restocked_at timestamp_ntz, price_changed_at timestamp_ntz"


def test_merge(spark):
    old = [(k, "t", p, None, s, a, T0, T0, T0 if s else None, None, None) for k, p, s, a in [("same", 1.0, False, True), ("cheaper", 2.0, False, True), ("cent", 2.001, False, True), ("sells", 3.0, False, True), ("back", 4.0, True, True), ("away", 5.0, False, True), ("again", 6.0, False, False), ("silent", 7.0, False, True)]]
    new = [("same", "t", 1.0, False), ("cheaper", "t2", 1.5, False), ("cent", "t", 2.002, False), ("sells", "t", 3.0, True), ("back", "t", 4.0, False), ("again", "t", 6.0, False), ("silent", None, None, None), ("first", "n", None, False)]
    out = state.merge(spark.createDataFrame(old, KNOWN), spark.createDataFrame(new, "item string, title string, price double, sold boolean"), "item", at(1))
    got = {r.item: r for r in out.collect()}
    assert {k: r.change for k, r in got.items()} == {"same": "same", "cheaper": "repriced", "cent": "same", "sells": "sold", "back": "restocked", "away": "unseen", "again": "reactivated", "silent": "same", "first": "new"}
    assert (got["cheaper"].price, got["cheaper"].previous_price, got["cheaper"].title, got["cheaper"].price_changed_at) == (1.5, 2.0, "t2", at(1))
    assert got["sells"].sold_at == at(1) and got["back"].sold_at is None and got["back"].restocked_at == at(1)
    assert (got["silent"].price, got["silent"].title) == (7.0, "t") and got["away"].last_seen == T0 and got["first"].first_seen == at(1) and got["first"].active


def test_delisting_guard(spark):
    active = spark.createDataFrame([("a", f"a{i}") for i in range(30)] + [("b", f"b{i}") for i in range(30)] + [("c", f"c{i}") for i in range(5)], "source string, item string")
    seen = spark.createDataFrame([(f"a{i}",) for i in range(20)] + [("b1",)], "item string")
    out = state.delisting(active, seen, ["item"], "source")
    assert {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()} == {"a": 10, "c": 5}


@pytest.mark.parametrize(("price", "told", "told_days", "peak", "news"), [(5.0, None, None, None, True), (5.0, 5.0, 0, None, False), (4.0, 5.0, 0, None, True), (4.997, 5.0, 0, None, False), (5.0, 5.0, 0, 6.0, True), (6.0, 5.0, 0, 6.0, False), (5.0, 5.0, -31, None, True)])
def test_is_news(spark, price, told, told_days, peak, news):
    df = spark.createDataFrame([(price, told, at(told_days) if told_days is not None else None, peak)], "price double, told double, told_at timestamp_ntz, peak double")
    assert df.select(state.is_news(*[F.col(c) for c in df.columns], at(0))).first()[0] is news


def test_watch_news(spark):
    kind = "k string, target double, price double, previous_price double, sold boolean, active boolean, last_seen timestamp_ntz, price_changed_at timestamp_ntz, restocked_at timestamp_ntz"
    rows = [("SOLD", None, 1.0, 2.0, True, True, at(2), None, None), (None, None, 1.0, 2.0, True, True, at(0), None, None), ("GONE", None, 1.0, 2.0, False, False, at(0), None, None), ("BACK", None, 1.0, 2.0, False, True, at(0), None, at(2)), ("TARGET", 1.0, 1.0, 2.0, False, True, at(0), at(2), None), (None, 0.5, 1.0, 2.0, False, True, at(0), at(2), None), ("CHEAPER", None, 1.0, 2.0, False, True, at(0), at(2), None), ("DEARER", None, 3.0, 2.0, False, True, at(0), at(2), None), (None, None, 3.0, 2.0, False, True, at(0), at(0), None)]
    out = spark.createDataFrame(rows, kind).select("k", state.watch_news(market.instant(at(1))).alias("n")).collect()
    assert [r.k for r in out] == [r.n for r in out]


def test_cooldown_and_episodes(spark):
    flags = [1, 1, 0, 0, 0, 1, 1, 1]
    rows = [("s", i, at(i), bool(f)) for i, f in enumerate(flags)] + [("ok", 0, at(0), False)]
    df = spark.createDataFrame(rows, "source string, seq int, at timestamp_ntz, failed boolean")
    assert {tuple(r) for r in state.cooldown(df, 10.0, 30.0).collect()} == {("s", 3, 30.0), ("ok", 0, 0.0)}
    assert sorted(map(tuple, state.episodes(df).collect()), key=str) == [("s", at(0), at(2), 2), ("s", at(5), None, 3)]


def test_change_log_and_last_write(spark):
    df = spark.createDataFrame([("a", 1, at(1), 5.0), ("a", 2, at(2), 5.001), ("a", 3, at(3), 4.0), ("b", 4, at(1), 1.0)], "item string, seq int, at timestamp_ntz, price double")
    assert sorted(r.seq for r in state.change_log(df).collect()) == [1, 3, 4]
    assert {(r.item, r.price, r.writes) for r in state.last_write(df, ["item"], "seq").collect()} == {("a", 4.0, 3), ("b", 1.0, 1)}


def test_usual_and_unanimous(spark):
    df = spark.createDataFrame([("m", 10)] * 5 + [("m", 15)] * 3 + [("m", 5)] * 2 + [("n", 10)] * 5 + [("n", 12)] * 1 + [("o", 3)], "k string, v int")
    assert {(r.k, r.value) for r in matching.usual(df, "k", "v", yields=10, share=0.25).collect()} == {("n", 10), ("m", 15)}
    assert {(r.k, r.value) for r in matching.usual(df, "k", "v").collect()} == {("n", 10), ("m", 10)}
    rows = spark.createDataFrame([("x", "A", i % 2) for i in range(5)] + [("y", "A", 1)] * 5 + [("z", "A", i) for i in range(4)] + [("z", "B", 9)], "k string, v string, s int")
    assert [(r.k, r.value) for r in matching.unanimous(rows, "k", "v", "s").collect()] == [("x", "A")]


def test_rules_and_aliases(spark):
    rows = spark.createDataFrame([(1, "A Red-Widget, new"), (2, "widgets"), (3, None), (4, "bolt widget")], "k int, t string")
    rules = spark.createDataFrame([(1, "widget", "w"), (2, "red widget", "rw"), (3, "bolt", "b")], "position int, spelling string, value string")
    assert {tuple(r) for r in matching.first_match(rows, "k", "t", rules).collect()} == {(1, "w"), (4, "w")}
    assert {(r.k, r.value) for r in matching.longest_match(rows, "k", "t", rules).collect()} == {(1, "rw"), (4, "w")}
    aliases = spark.createDataFrame([("S&W", "Smith"), ("s w", "Other"), ("CZ", "Zbrojovka")], "alias string, canonical string")
    names = spark.createDataFrame([("S&W",), ("sw",), ("c.z.",), (None,)], "name string")
    assert {(r.name, r.canonical) for r in matching.canonical(names, "name", aliases).collect()} == {("S&W", "Smith"), ("sw", None), ("c.z.", "Zbrojovka"), (None, None)}
    assert matching.contested(spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "alias string, canonical string")).collect()[0].alias == "a"


def test_ranges_and_brackets(spark):
    points = spark.createDataFrame([("k", 5), ("k", 99), ("k", 100), ("j", 5)], "k string, v int")
    ranges = spark.createDataFrame([("k", 0, 5, 1), ("k", 90, 250, 2), ("j", 6, 7, 3)], "k string, low int, high int, id int")
    assert {(r.k, r.v, r.id) for r in matching.in_ranges(points, ranges, ["k"], "v", 16).collect()} == {("k", 5, 1), ("k", 99, 2), ("k", 100, 2)}
    marks = spark.createDataFrame([("k", 1, 1900), ("k", 5, 1910), ("k", 9, 1899), ("k", 12, 1920)], "k string, n int, y int")
    out = matching.bracket(spark.createDataFrame([("k", 5, 50), ("k", 0, 51)], "k string, n int, point int"), marks, "k", "n", "y").collect()
    assert {(r.point, r.below_at, r.below, r.above_at, r.above) for r in out} == {(50, 1, 1900, 9, 1899), (51, None, None, 1, 1900)}


def test_reference_tables(spark):
    table = spark.createDataFrame([(1, ["a"]), (2, ["b", "a"]), (3, ["c"])], "id int, aliases array<string>")
    merges = spark.createDataFrame([(2, 1)], "loser int, winner int")
    assert {(r.id, r.into, tuple(r.aliases)) for r in matching.merge_rows(table, merges, "id", "aliases").collect()} == {(1, 1, ("a", "b")), (2, 1, ()), (3, 3, ("c",))}


def test_brackets_sum_up_frames_that_grow(spark):
    points = spark.range(0, 1000, 3).selectExpr("'k' AS k", "id AS n", "id AS point")
    marks = spark.range(0, 1000, 2).selectExpr("'k' AS k", "id AS n", "id * 10 AS y")
    out = matching.bracket(points, marks, "k", "n", "y")
    assert "unboundedfollowing" not in out._jdf.queryExecution().analyzed().toString().lower()
    below, above = (lambda n: n - 1 if n % 2 else n - 2), (lambda n: n + 1 if n % 2 else n + 2)
    clip = lambda n: n if 0 <= n <= 998 else None
    assert sorted((r.point, r.below_at, r.above_at, r.above) for r in out.collect()) == [(n, clip(below(n)), clip(above(n)), None if clip(above(n)) is None else above(n) * 10) for n in range(0, 1000, 3)]
