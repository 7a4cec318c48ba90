"""Fingerprints, links and components against brute force."""

import random
import re

import pandas as pd
import pytest
import xxhash

from larkspur.llm import components, simhash
from larkspur.llm.queries import op6_simhash

SF = "/root/testdata/sf0.001"


def fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reached(ids, prints, distance=2):
    """Smallest id reachable, by union of all close pairs."""
    parent = {p: p for p in set(prints)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(parent)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if bin(a ^ b).count("1") <= distance:
                parent[root(b)] = root(a)
    best = {}
    for i, p in zip(ids, prints):
        if i is not None:
            best[root(p)] = min(best.get(root(p), i), i)
    return [best.get(root(p)) for p in prints]


def check(frame, docs):
    prints = [fingerprint(t) for _, t in docs]
    want = sorted(zip([i for i, _ in docs], prints, reached([i for i, _ in docs], prints)), key=str)
    got = sorted(((r.doc_id, r.fingerprint & (2**64 - 1), r.component_id) for r in frame.collect()), key=str)
    assert got == want


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in pd.read_parquet(f"{SF}/documents.parquet").itertuples()]
    out = op6_simhash(spark, SF)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in out.collect()}
    prints = [fingerprint(t) for _, t in docs]
    want = {i: (f"{p:016x}", c) for (i, _), p, c in zip(docs, prints, reached([i for i, _ in docs], prints))}
    assert got == want


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c " * 3000), (7, "a b c " * 3000), (None, "one"), (8, "é\x00x ñ")]
    frame = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, fingerprint int")
    check(simhash.classes(frame), docs)
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 4, 6, 7, 8, None], key=str)
    assert simhash.classes(frame.limit(0)).count() == 0


def test_links_lose_nothing(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(12)} | set(base) | {0, 2**64 - 1}
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    got = {(r.a, r.b) for r in simhash.links(frame).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert got == want
    assert simhash.homes(frame).count() == 2 * len(prints)


def test_components(spark):
    chain = [(i, i + 1) for i in range(50, 90)] + [(3, 2), (2, 3), (7, 7), (100, 5), (100, 6), (100, 8), (None, 1)]
    got = {r.id: r.label for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 50 for i in range(50, 91)}, 2: 2, 3: 2, 5: 5, 6: 5, 8: 5, 100: 5}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_texts_are_found_and_others_left(spark):
    rng = random.Random(8)
    vocabulary = [f"w{rng.getrandbits(40):x}" for _ in range(3000)]
    docs, family = [], {}
    for g in range(120):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(80, 300))]
        for copy in range(rng.choice([1, 2, 3])):
            text = list(base)
            for _ in range(len(base) // 60 if copy else 0):  # similarity of about 0.85 to the first
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            family[len(docs)] = g
            docs.append((len(docs), " ".join(text)))
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    first = {}
    for i, g in family.items():
        first.setdefault(g, i)
    assert all(family[got[i]] == family[i] for i in got)  # no clean document is taken for another's copy
    copies = [i for i, g in family.items() if first[g] != i]
    assert sum(got[i] == first[family[i]] for i in copies) >= 0.97 * len(copies)


def grams(text, width=5):
    words = re.findall("[^\x20\x09-\x0d]+", text.lower())
    return frozenset(" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def check_similar(spark, docs):
    """The classes are those of all pairs of 0.8 or more; returns the number of such pairs."""
    sets = [grams(t) for _, t in docs]
    links = [(a, b) for b, y in enumerate(sets) for a, x in enumerate(sets[:b]) if 5 * len(x & y) >= 4 * len(x | y)]
    smallest = list(range(len(docs)))
    for _ in docs:
        before = list(smallest)
        for a, b in links:
            smallest[a] = smallest[b] = min(smallest[a], smallest[b])
        if smallest == before:
            break
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(frame).collect()}
    assert got == {docs[k][0]: docs[s][0] for k, s in enumerate(smallest)}
    return len(links)


def changed(rng, words, times, vocabulary):
    out = list(words)
    for k in rng.sample(range(len(out)), times):
        out[k] = rng.choice(vocabulary)
    return out


def test_similar_texts_of_a_hot_source_are_all_found(spark):
    rng = random.Random(12)
    vocabulary = [f"w{rng.getrandbits(40):x}" for _ in range(3000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    boilerplate, near, docs = some(200), some(150), []
    for g in range(150):  # two thirds of each is the boilerplate; pairs from 0.7 to 0.9
        text = boilerplate + some(100)
        docs += [text, text[:200] + changed(rng, text[200:], rng.randrange(3, 9), vocabulary)]
    docs += [changed(rng, near, rng.randrange(4), vocabulary) for _ in range(150)]
    assert check_similar(spark, [(k, " ".join(t)) for k, t in enumerate(docs)]) > 200


def test_repeated_line_does_not_decide(spark):
    rng = random.Random(13)
    vocabulary = [f"w{rng.getrandbits(40):x}" for _ in range(3000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    line, docs = some(10) * 100, []
    for g in range(20):
        docs.append(some(200) + line)
    for g in range(60):  # around the limit
        text = some(200)
        docs += [text, changed(rng, text, rng.randrange(3, 7), vocabulary)]
    assert check_similar(spark, [(k, " ".join(t)) for k, t in enumerate(docs)]) > 20


def test_rows_of_one_id_are_decided_by_text(spark):
    one, other, third = (" ".join(f"{w}{k}" for k in range(40)) for w in "abc")
    docs = spark.createDataFrame([(1, one), (2, one), (2, other), (3, third), (3, other), (3, third)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(docs).collect())) == [(1, one), (2, other), (3, third)]


def test_similar_sets_meet_by_simhash_anchors(spark):
    rng = random.Random(14)
    vocabulary = [f"w{rng.getrandbits(40):x}" for _ in range(3000)]
    docs = []
    for g in range(100):  # pairs of about 0.95
        text = [rng.choice(vocabulary) for _ in range(400)]
        docs += [(2 * g, " ".join(text)), (2 * g + 1, " ".join(changed(rng, text, 2, vocabulary)))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    sets = simhash.distinct_sets(simhash.set_rows(frame, 5, more=(simhash.SKETCH, simhash.set_sketches)))
    rows = {r.id: r for r in sets.collect()}

    def apart(a, b, word):
        return bin((rows[a][word] ^ rows[b][word]) & (2**64 - 1)).count("1")

    met = {(r.a, r.b) for r in simhash.anchor_pairs(sets, 5).collect()}
    assert all(min(apart(a, b, "f0"), apart(a, b, "f1")) <= simhash.REST_BITS for a, b in met)
    pair = {}
    for r in rows.values():
        pair.setdefault(r.first_doc // 2, []).append(r.id)
    pairs = [tuple(sorted(p)) for p in pair.values()]
    # in one block at most one bit apart: one is at home where the other one visits, and nobody else is there
    sure = [p for p in pairs if any(bin((rows[p[0]][w] ^ rows[p[1]][w]) >> 31 * f & 2**31 - 1).count("1") <= 1 for w in simhash.SKETCH for f in (0, 1))]
    assert len(sure) > 50 and sum(p in met for p in sure) >= 0.9 * len(sure)
    assert simhash.anchor_pairs(sets.limit(0), 5).count() == 0
