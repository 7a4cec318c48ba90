"""Planted leaks, paraphrases, clean documents, and odd rows; the query against a word-sequence search."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from larkspur.llm import decontamination as dc
from larkspur.llm.queries import op5_decontamination

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_query_finds_every_verbatim_leak_and_nothing_else(spark):
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    grams = defaultdict(set)
    for i, w in items.items():
        for k in range(len(w) - 7):
            grams[tuple(w[k : k + 8])].add(i)
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = words(r.text)
        want |= {(r.doc_id, i) for k in range(len(w) - 7) for i in grams.get(tuple(w[k : k + 8]), ())}
    got = {(r.doc_id, r.item_id) for r in op5_decontamination(spark, SF).collect()}
    assert want and got == want


@pytest.fixture(scope="module")
def world():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(3, 9))) for _ in range(4000)]
    often = vocabulary[:30]
    prose = lambda n: [rng.choice(often) if rng.random() < 0.5 else rng.choice(vocabulary) for _ in range(n)]
    return rng, prose


def test_leaks_and_paraphrases(spark, world):
    rng, prose = world
    items = [(i, " ".join(prose(rng.choice([12, 30, 45, 150])))) for i in range(40)]
    docs, want = [], set()
    for d in range(300):
        body = prose(rng.randrange(20, 400))
        if d % 10 == 0:
            k = rng.randrange(40)
            leak = items[k][1].split()
            if d % 20 == 0:  # every sixth word is another one
                leak = [rng.choice(prose(1)) if j % 6 == 3 else w for j, w in enumerate(leak)]
            at = rng.randrange(len(body))
            body[at:at] = leak
            want.add((d, k))
        docs.append((d, " ".join(body).upper() if d % 3 == 0 else ", ".join(body)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(df, bench).collect()}
    assert got == want
    kept = dc.clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_common_subsequence():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert dc.common(a, b) == table[-1, -1]


def test_odd_rows(spark, world):
    _, prose = world
    item = " ".join(prose(30))
    texts = [None, "", " .,;", item, "x " * 50_000 + item, item]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, item, 7)], "doc_id long, text string, matches int")
    bench = spark.createDataFrame([(1, item), (2, None), (None, item), (3, " -- ")], "item_id long, text string")
    out = dc.annotate(df, bench)
    assert out.columns == ["doc_id", "text", "matches"]
    assert sorted((r.doc_id is None, r.doc_id, [m.item_id for m in r.matches]) for r in out.where("doc_id is not null").collect()) == [(False, i, [1] if i > 2 else []) for i in range(6)]
    assert [len(r.matches) for r in out.where("doc_id is null").collect()] == [1]
    assert dc.clean(df, bench.limit(0)).count() == 7 and dc.annotate(df.limit(0), bench).count() == 0


def test_item_in_a_third_of_the_documents(spark):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(8)) for _ in range(30_000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [prose(n) for n in (16, 22, 35, 50)] + [prose(40) for _ in range(20)]
    docs, want = [], set()
    for d in range(600):
        body = prose(rng.randrange(100, 300))
        if d % 3 == 0:
            k = d // 3 % 4 if d % 2 else 0
            at = rng.randrange(len(body))
            body[at:at] = items[k]
            want.add((d, k))
        docs.append((d, " ".join(body)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(df, bench).collect()} == want
