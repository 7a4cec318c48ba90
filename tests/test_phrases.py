"""Phrases by automaton against plain search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from larkspur.operators import phrases


def plain(t):
    return " ".join((t or "").replace("\x00", " ").lower().split())


def there(text, phrase, whole):
    end = r"(?![^\W_])" + (r"(?!\.\d)" if phrase[-1:].isdigit() else "")
    return phrase and (re.search(rf"(?<![^\W_])(?<!\.){re.escape(phrase)}{end}", text) if whole else phrase in text)


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("most", [50_000, 7])
def test_against_plain_search(spark, whole, most):
    rng = random.Random(5)
    words = ["ab", "abc", "b", "c d", "é", "x-1", "ABC", "a.b", "cd"]
    rows = [(k, " ".join(rng.choices(words, k=6)), rng.choice([None, " ".join(rng.choices(words, k=3))])) for k in range(120)] + [(900, None, ""), (901, "ab  \n c", "d")]
    table = [(p, v) for v, p in enumerate({" ".join(rng.choices(words, k=rng.choice([1, 1, 2]))) for _ in range(30)})] + [("ab", 77), ("AB ", 78), ("", 79), (None, 80), ("never there", 81), ("b c", None), ("c", 82), ("d", 82)]
    frames = spark.createDataFrame(rows, "k long, t string, u string"), spark.createDataFrame(table, "phrase string, value long")
    want = {(k, v) for k, t, u in rows for p, v in table if v is not None and p and any(there(plain(x), plain(p), whole) for x in (t, u))}
    got = [tuple(r) for r in phrases.hits(frames[0], "k", ["t", "u"], frames[1], whole=whole, most=most).collect()]
    assert set(got) == want and len(got) == len(want)
    counts = {r.value: r.mentions for r in phrases.mention_counts(frames[0], ["t", "u"], frames[1], whole=whole, most=most).collect()}
    assert counts == {v: sum(x == v for _, x in want) for v in {v for _, v in table if v is not None}}


@pytest.mark.parametrize("most", [50_000, 2])
def test_longest_spelling_decides(spark, most):
    table = spark.createDataFrame([(".45", "bare"), (".45 colt", "colt"), (".45 acp", "acp"), ("colt", "maker"), ("45 colt", "spelled"), ("zz", "b"), ("yy", "a"), ("zz", "c")], "phrase string, value string")
    texts = ["A .45 Colt revolver", ".45 ACP and .45 Colt", "a.45 coltx", "x.45", None, "", "yy zz", "zz yy", "Colt  .45"]
    rows = spark.createDataFrame([(k, t, [k]) for k, t in enumerate(texts)], "k long, t string, keep array<long>")
    out = phrases.tagged(rows, F.col("t"), table, "tag", most=most)
    assert out.columns == ["k", "t", "keep", "tag"]
    assert [r.tag for r in out.orderBy("k").collect()] == ["colt", "colt", None, None, None, None, "a", "b", "maker"]
    first = phrases.tagged(rows, F.col("t"), table, "tag", first=True, most=most)
    assert [r.tag for r in first.orderBy("k").collect()] == ["colt", "acp", None, None, None, None, "a", "b", "maker"]


def test_no_phrases(spark):
    rows, none = spark.createDataFrame([(1, "x")], "k long, t string"), spark.createDataFrame([], "phrase string, value string")
    assert phrases.hits(rows, "k", ["t"], none).count() == 0 and phrases.mention_counts(rows, ["t"], none).count() == 0
    assert phrases.tagged(rows, F.col("t"), none, "v").first().v is None


def test_equal_texts_are_searched_once(spark, monkeypatch):
    from larkspur.operators import phrases as P

    written = []
    monkeypatch.setattr(P, "cut", lambda df, name: written.append(df.count()) or df, raising=False)
    texts = spark.range(3000).selectExpr("if(id % 3 = 0, 'A red  ring', 'a red ring') AS t").union(spark.createDataFrame([(None,), ("Ring",)], "t string"))
    names = spark.createDataFrame([("ring", 1), ("red ring", 2), ("blue", 3)], "phrase string, value long")
    out = P.mention_counts(texts, ["t"], names, most=1)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 3001), (2, 3000), (3, 0)]
    assert written == [3]
