"""Order statistics against numpy and plain sorting, with and without ranges; the median without one's own rows by definition."""

import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import ranks
from larkspur.operators import market


def table(spark, seed):
    rng = random.Random(seed)
    draws = [lambda: rng.choice([-3.5, 0.0, 2.0, 2.0, 7.25]), lambda: rng.lognormvariate(0, 4), lambda: rng.gauss(0, 1) * 10 ** rng.randrange(-9, 9), lambda: 5.0 if rng.random() < 0.6 else rng.random()]
    rows = [(k, draws[i]()) for i, k in enumerate(["a", "b", "c", None]) for _ in range(rng.randrange(1, 400))] + [("a", None), ("only null", None)]
    return rows, spark.createDataFrame(rows, "k string, v double")


@pytest.mark.parametrize("split", [False, True])
def test_percentiles(spark, split):
    fractions = {"low": 0.1, "median": 0.5, "high": 0.9, "most": 1.0}
    for seed in range(3):
        rows, df = table(spark, seed)
        groups = {k: sorted(v for g, v in rows if g == k and v is not None) for k in ("a", "b", "c", None)}
        got = {r.k: r for r in ranks.nearest_ranks(df, ["k"], "v", fractions, split=split).collect()}
        assert got.keys() == groups.keys()
        linear = {r.k: r for r in ranks.linear_percentiles(df, ["k"], "v", fractions, split=split).collect()}
        for k, own in groups.items():
            assert got[k].n == len(own)
            for name, f in fractions.items():
                assert got[k][name] == own[round(f * (len(own) - 1))]
                assert linear[k][name] == pytest.approx(float(np.percentile(own, f * 100)), rel=1e-12, abs=1e-12)


def test_times_count(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 3.0, 2), ("a", 3.0, 4)], "k string, v double, t long")
    assert [tuple(r) for r in ranks.linear_percentiles(df, ["k"], "v", {"m": 0.5}, "t").collect()] == [("a", 11, 3.0)]


def test_median_of_the_others(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("mn"), rng.choice([1, 1, 1, 2, 3, 4]), float(rng.choice([10, 20, 20, 20, rng.randrange(1, 900)]))) for i in range(700)]
    rows += [(1000 + i, "hot", i % 2 if i < 12 else 0, float(1 + i % 90)) for i in range(400)] + [(5000 + i, "one", 1, 5.0) for i in range(9)]
    df = spark.createDataFrame(rows, "item int, model string, source int, price double").withColumns({"active": F.lit(True), "sold": F.lit(False)})
    got = {(r.model, r.source): r["median"] for r in market.others_median(df).collect()}
    want = {}
    for model, source in {(m, s) for _, m, s, _ in rows}:
        others = [p for _, m, s, p in rows if m == model and s != source]
        if len(others) >= 5:
            want[model, source] = median(others)
    assert got == want


def test_bands_read_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(1000).select((F.col("id") % 3).alias("kind"), (F.col("id") % 7).alias("source"), (F.col("id") % 11).cast("double").alias("price"))
    found = market.bands(rows.mapInArrow(count, rows.schema), "kind").collect()
    assert seen.value == 1000
    assert sorted((r.value, r.listings, r.sources) for r in found) == [(0, 334, 7), (1, 333, 7), (2, 333, 7)]


def test_similar_lists_are_short_and_lose_nothing(spark):
    rng = random.Random(5)
    pool = [(f"i{k:04}", rng.choice([None, *range(4)]), rng.choice([None, "a", "b"]), rng.choice([None, *"uvwxyz"]), rng.choice([None, *map(float, range(30))]), True, False) for k in range(900)]
    pool += [(f"m{k:04}", 0, "a", "uvwxyz"[k % 6], 0.5, True, False) for k in range(200)]  # the cheapest of a kind are one model's
    asked = pool[::90] + pool[900:903]
    frame = spark.createDataFrame(pool, "item string, model long, kind string, country string, price double, active boolean, sold boolean")
    found = market.similar(frame.where(F.col("item").isin([r[0] for r in asked])), frame)
    got = {(r.query, r.place): (r["item"], r.rung) for r in found.collect()}
    want = {}
    for item, model, kind, country, *_ in asked:
        rungs = {}
        for other, m, k, c, price, *_ in pool:
            mine, alike = model is not None and m == model, kind is not None and k == kind
            rung = (1 if k == kind else 2) if mine else 0 if not alike else 3 if country is not None and c == country else 4
            if rung and other != item:
                rungs.setdefault(rung, []).append((price is None, price or 0.0, other))
        first = min(rungs, default=0)
        ranked = [(r, k, o) for r, rows in rungs.items() for k, (_, _, o) in enumerate(sorted(rows)[:10], 1)]
        wider = sum(r > first for r, _, _ in ranked)
        order = sorted((r == first and k > 8 - min(2, wider), r, k, o) for r, k, o in ranked)
        want |= {(item, place): (o, r) for place, (_, r, _, o) in enumerate(order[:8], 1)}
    assert got == want


def test_scorecards_count_prices_and_need_no_item(spark):
    from datetime import datetime

    day = datetime(1999, 12, 1)
    rows = [(s, 1, float(10 * s + k % 3), day, False, True, None, None) for s in (1, 2, 3) for k in range(6)]
    kinds = "source long, model long, price double, first_seen timestamp_ntz, sold boolean, active boolean, sold_at timestamp_ntz, delisted_at timestamp_ntz"
    frame = spark.createDataFrame(rows, kinds)
    since = spark.createDataFrame([(s, datetime(1999, 1, 1)) for s in (1, 2, 3)], "source long, since timestamp_ntz")
    got = {r.source: (r.for_sale, r.compared, r.price_vs_market) for r in market.scorecards(frame, since, datetime(2000, 1, 1)).collect()}
    # the others' middle: 22 and 30 of 20 .. 32; 12 and 30; 12 and 20
    assert got == {1: (6, 6, round(11 / 26, 3)), 2: (6, 6, 1.0), 3: (6, 6, round(31 / 16, 3))}
