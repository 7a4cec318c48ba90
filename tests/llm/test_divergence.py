"""Source divergence against sums over all terms."""

import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur.llm import divergence
from larkspur.llm.queries import op11_divergence

SF = "/root/testdata/sf0.001"


def plainly(docs, least=10, leading=10):
    docs = [tuple(x or "" for x in d) for d in docs]
    out = []
    for lang in {d[0] for d in docs}:
        seen, everywhere, counts = Counter(), Counter(), {}
        for own, source, text in docs:
            if own == lang:
                terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
                seen.update(set(terms))
                everywhere.update(terms)
                counts.setdefault(source, Counter()).update(terms)
        kept = [t for t, n in seen.items() if n >= least]
        v = len(kept)

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * v) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        language, own = share(everywhere), {s: share(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(-sum(f(own[s][t], own[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            terms = [(-f(own[s][t], language[t]), t.encode(), t) for t in kept if counts[s][t] and own[s][t] > language[t]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:leading])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(rows, 1)]
    return sorted(out)


def check(frame, docs, **settings):
    assert sorted(map(tuple, frame.collect())) == plainly(docs, **settings)


def test_query(spark):
    docs = [(r.lang, r.source, r.text) for r in pd.read_parquet(f"{SF}/documents.parquet").itertuples()]
    check(op11_divergence(spark, SF), docs)


@pytest.mark.parametrize("seed", [1, 2])
def test_ties_and_odd_rows(spark, seed):
    rng = random.Random(seed)
    words = ["the", "The", "THE", "of", "and", "straße", "ÄRGER", "ärger", "naïve", "日本", "a1b", "x_y", "\x00nul"] + [f"w{chr(97 + k)}" for k in range(26)]
    docs = [(rng.choice(["en", "de"]), rng.choice(["hot", "hot", "a", "b", "é"]), " ".join(rng.choices(words, k=rng.randrange(40)))) for _ in range(200)]
    docs += [("en", "hot", "the the end")] * 100 + [("en", "ties", "wa wb wc wd we wf wg wh wi wj wk wl wm wn")] * 3
    docs += [(None, None, None), ("", "s", ""), ("xx", None, "Rare words here"), ("xx", "only", None), ("en", "silent", "12 34"), ("en", "long", "lorem of " * 60_000)]
    frame = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "lang string, source string, text string, n int, term string, p int")
    check(divergence.audit(frame), docs)
    check(divergence.audit(frame, least=1, leading=3), docs, least=1, leading=3)
    assert divergence.audit(frame.limit(0)).count() == 0


def test_only_buckets_that_can_matter_are_evaluated(spark, monkeypatch):
    """With frequent words of one source far ahead, hardly any term of the long tail is looked at."""
    rng = random.Random(3)
    tail = [f"t{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)]
    docs = [("en", s, " ".join(rng.sample(tail, 40) + [f"own{s}{chr(97 + k)}" for k in range(12)] * 20)) for s in "ab" for _ in range(60)]
    looked = []
    monkeypatch.setattr(divergence, "cut", lambda df, name, real=divergence.cut: (looked.append((name, real(df, name))), looked[-1][1])[1])
    check(divergence.audit(spark.createDataFrame(docs, "lang string, source string, text string")), docs)
    bounds = next(df for name, df in looked if name == "bounds")
    first = next(df for name, df in looked if name == "leading")
    kth = first.where("rank = 10").select("lang", "source", F.col("value").alias("kth"))
    read = bounds.join(kth, ["lang", "source"]).where("before < 10 or bound >= kth").agg(F.sum("n")).first()[0]
    assert read < 0.2 * bounds.agg(F.sum("n")).first()[0]


def test_probabilities_of_very_large_counts(spark):
    rows = [(0, 0, 1), (5, 10, 3), (10**13, 4 * 10**13, 10**9), (4 * 10**13 - 1, 4 * 10**13, 17), (12_345_678_901, 98_765_432_109, 1000)]
    frame = spark.createDataFrame(rows, "n long, total long, terms long")
    got = [r[0] for r in frame.select(divergence.probability(F.col("n"), F.col("total"), F.col("terms"))).collect()]
    assert got == [1 + 10**9 * (n + 2) // (total + 2 * v) for n, total, v in rows]


def test_buckets_are_in_order(spark):
    rows = [r[0] for r in spark.range(1, 5000).select(divergence.bucket(F.col("id"))).collect()]
    assert rows[:15] == list(range(1, 16)) and all(0 <= b - a <= 1 for a, b in zip(rows, rows[1:]))
