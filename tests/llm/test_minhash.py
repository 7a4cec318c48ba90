"""Tensored banding: sets, keys and components against all pairs."""

import random
import re

import numpy as np
import pandas as pd

from larkspur.llm import minhash
from larkspur.llm.queries import op12_minhash

SF = "/root/testdata/sf0.001"


def grams(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    return frozenset(" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def by_all_pairs(docs):
    """doc_id, n_shingles, component_id, kept of each row."""
    sets = [grams(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    linked = 0
    for b, y in enumerate(sets):
        for a in range(b):
            if y and 100 * len(sets[a] & y) >= 80 * len(sets[a] | y):
                linked += sets[a] != y
                parent[root(b)] = root(a)
    best = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            best[root(k)] = min(best.get(root(k), i), i)
    ids = [(i, s, best.get(root(k)) if s else i) for k, ((i, _), s) in enumerate(zip(docs, sets))]
    return sorted(((i, len(s), c, i is not None and i == c) for i, s, c in ids), key=str), linked


def check(frame, docs):
    want, linked = by_all_pairs(docs)
    assert sorted(map(tuple, frame.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str) == want
    return linked


def test_query_against_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in pd.read_parquet(f"{SF}/documents.parquet").itertuples()]
    check(op12_minhash(spark, SF), docs)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "a b c d " * 9000), (7, "a b c d " * 9000), (None, "one"), (None, "alone here"), (None, None), (8, "é\x00x ñ"), (9, "x" * 300_000), (9, "another text of that id"), (10, "one two three four")]
    frame = spark.createDataFrame([(i, t, 5, 6, 7) for i, t in docs], "doc_id long, text string, id int, size int, kept int")
    check(minhash.classes(frame), docs)
    assert minhash.classes(frame.limit(0)).count() == 0


def test_hot_groups_and_pairs_around_the_limit(spark):
    rng = random.Random(21)
    vocabulary = [f"w{rng.getrandbits(40):x}" for _ in range(3000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]

    def changed(words, times):
        out = list(words)
        for k in rng.sample(range(len(out)), times):
            out[k] = rng.choice(vocabulary)
        return out

    near, boilerplate, texts = some(150), some(150), []
    texts += [changed(near, rng.randrange(4)) for _ in range(120)]  # a third of all rows
    texts += [near] * 30
    for _ in range(60):  # half of each is the boilerplate
        text = boilerplate + some(100)
        texts += [text, text[:150] + changed(text[150:], rng.randrange(3, 12))]
    for _ in range(40):
        text = some(rng.randrange(20, 200))
        texts += [text, changed(text, len(text) // 30)]
    rng.shuffle(texts)
    docs = [(k, " ".join(t)) for k, t in enumerate(texts)]
    assert check(minhash.classes(spark.createDataFrame(docs, "doc_id long, text string")), docs) > 3000


def test_the_limit_itself_is_linked(spark):
    words = lambda n, x: [f"{x}{k}" for k in range(n)]
    # 83 words have 80 shingles; texts that go on for 20 more shingles share 80 of 100 with it, and for 21 more 80 of 101
    base = words(83, "a")
    docs = [(1, " ".join(base)), (2, " ".join(base + words(20, "b"))), (3, " ".join(base + words(21, "c")))]
    check(minhash.classes(spark.createDataFrame(docs, "doc_id long, text string")), docs)


def test_collections_agree_as_often_as_two_minima_should():
    rng = np.random.default_rng(5)
    same = []
    for _ in range(300):
        shared, one, two = (rng.integers(0, 1 << 64, size=n, dtype=np.uint64) for n in (80, 10, 10))
        hashes = np.concatenate([np.sort(np.concatenate([shared, one])), np.sort(np.concatenate([shared, two]))])
        same += [c[0] == c[1] for c in minhash.collections(hashes, np.array([90, 90]))]
    assert 0.6 < np.mean(same) < 0.68  # 0.8 twice
    assert all((c == 0).all() for c in minhash.collections(np.zeros(0, np.uint64), np.array([0, 0])))
