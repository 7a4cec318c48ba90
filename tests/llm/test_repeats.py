"""Removed bytes against brute force over all strings, the index against all pairs of suffixes, and odd rows."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from larkspur.llm import repeats

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(d), int(gone.sum()), bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def check(spark, texts, length=400, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    df = spark.createDataFrame([(i, t, 3) for i, t in zip(ids, texts)], "doc_id long, text string, n_bytes int")
    out = repeats.remove_repeats(df, length)
    assert out.columns == ["doc_id", "text", "n_bytes", "n_removed", "spans", "kept", "kept_text"]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in out.collect())
    assert got == Counter((i, *w) for i, w in zip(ids, brute(texts, length)))
    for r in out.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        data, cuts = (r.text or "").encode(), [0, *(x for s in r.spans for x in (s.start, s.end)), r.n_bytes]
        assert r.kept_text == "".join(data[a:b].decode("utf-8", "ignore") for a, b in zip(cuts[::2], cuts[1::2]))


def test_matching_statistics_by_all_pairs():
    rng = random.Random(2)
    for _ in range(30):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))) * rng.choice([1, 1, 2]) for _ in range(rng.randrange(1, 8))]
        codes = np.frombuffer("".join(texts).encode(), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        left = np.repeat(ends, [len(t) for t in texts]) - np.arange(len(codes))
        first = np.zeros(len(codes), bool)
        first[[0, *ends[:-1]]] = True
        got = repeats.matching_statistics(codes, left, first)
        suffixes = [bytes(codes[i : i + left[i]]) for i in range(len(codes))]

        def lcp(a, b):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            return n

        want = [max([lcp(s, o) for j, o in enumerate(suffixes) if j != i], default=0) for i, s in enumerate(suffixes)]
        assert got.tolist() == want


@pytest.mark.parametrize("unit", [repeats.BYTE, repeats.WORD])
def test_shards_sort_each_symbol_once(monkeypatch, unit):
    """A shard's answers by all pairs of strings under the same anchor, without sorting its symbols again for each doubling."""
    monkeypatch.setattr(repeats, "suffix_order", None)
    rng, length = random.Random(4), 6
    for _ in range(40):
        rows = []
        for i in range(rng.randrange(1, 30)):
            lead, starts = rng.randrange(4), rng.randrange(1, 4)
            symbols = [rng.choice([7, 7, 7, 8, 255]) for _ in range(max(lead + 1, starts + length - 1))]
            rows += [(rng.choice([-5, 3, 9]), i, k, lead, symbols) for k in range(rng.choice([1, 1, 2]))]
        rng.shuffle(rows)
        hashes, contexts, copies, leads, symbols = zip(*rows)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        values = (hashes, contexts, copies, leads, [np.array(s, unit.code).tobytes() for s in symbols])
        got = repeats._index(length, unit)(pa.table([pa.array(v, k) for v, k in zip(values, kinds)], ["hash", "context", "copy", "lead", "symbols"]))
        seen = Counter((h, lead - s, *x[s : s + length]) for h, _, _, lead, x in rows for s in range(min(lead, len(x) - length) + 1))
        for (h, c, copy, lead, x), ranges in zip(rows, got.column("ranges").to_pylist()):
            want = [s for s in range(min(lead, len(x) - length) + 1) if seen[(h, lead - s, *x[s : s + length])] > 1]
            assert [s for a, b in zip(ranges[::2], ranges[1::2]) for s in range(a, b)] == (want if copy == 0 else [])


def prose(rng, n):
    return "".join(rng.choice("abcdefgh éß\n") for _ in range(n))


@pytest.mark.parametrize("hot", [4096, 2])
def test_planted_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", hot)
    rng = random.Random(7)
    shared = [prose(rng, n) for n in (60, 90, 200, 400)]
    texts = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(150)), rng.choice(shared)[rng.randrange(20) :], prose(rng, rng.randrange(150))]
        if i % 7 == 0:
            parts += [shared[2], prose(rng, 5), shared[2][30:]]
        texts.append("".join(parts))
    texts += [texts[3], texts[3], texts[5][:-1] + "z", None, "", "a" * 500, "ab" * 300, "short", prose(rng, 64)]
    check(spark, texts, 64)


@pytest.mark.parametrize("hot", [2048, 3])
def test_an_anchor_of_many_contexts(spark, monkeypatch, hot):
    """Ten thousand texts with one passage, most of them unlike around it: their anchor's contexts are cut, once or twice, and answered by the index."""
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", hot)
    rng = random.Random(11)
    passage, edges = prose(rng, 60), [prose(rng, 40) for _ in range(40)]
    texts = [prose(rng, 30) + passage + prose(rng, 30) for _ in range(10_000 if hot > 3 else 300)]
    texts += [rng.choice(edges)[rng.randrange(8) :] + passage + rng.choice(edges)[: 30 + rng.randrange(10)] for _ in range(400)]
    at = repeats.anchors(*repeats.BYTE.symbols(pa.array(texts)), 64, 32)
    assert max(Counter(at["hash"].tolist()).values()) > hot
    check(spark, texts, 64)


def test_words_of_a_hot_anchor(spark, monkeypatch):
    """Cutting hot anchors of words changes no answer."""
    rng = random.Random(12)
    words = [prose(rng, 5).replace(" ", "x").replace("\n", "y") for _ in range(300)]
    said = lambda n: [rng.choice(words) for _ in range(n)]
    passage = said(18)
    texts = [" ".join([*said(rng.randrange(12)), *passage[rng.randrange(3) :], *said(12)]) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = []
    for hot in (4096, 2):
        monkeypatch.setattr(repeats, "HOT_CONTEXTS", hot)
        found.append(sorted((r.doc_id, r.n_removed, r.kept_text) for r in repeats.remove_repeats(df, 16, unit=repeats.WORD).collect()))
    assert found[0] == found[1] and sum(n > 0 for _, n, _ in found[0]) > 100


def test_repeated_rows_and_null_ids(spark):
    rng = random.Random(1)
    a, b = prose(rng, 900), prose(rng, 900)
    check(spark, [a, a, b, b[:500] + a[100:600], None], 400, [1, 1, None, 4, 5])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(empty).count() == 0


def test_names_and_pieces(spark, monkeypatch):
    rng = random.Random(3)
    a = prose(rng, 700)
    names = ["doc_id", "text", "_text", "_said", "_k1", "k2", "hash", "said"]
    rows = [(i, t, "x", "y", i, i, i, "z") for i, t in enumerate([a, "q" + a[:650], prose(rng, 500)])]
    out = repeats.remove_repeats(spark.createDataFrame(rows, names), 100)
    assert out.columns[: len(names)] == names and sorted(tuple(r)[: len(names)] for r in out.collect()) == rows
    whole = np.frombuffer(prose(rng, 5000).encode() * 2, np.uint8)
    for size in (1 << 22, 700):  # the same starts are covered, by more anchors
        monkeypatch.setattr(repeats, "PIECE", size)
        x = repeats.anchors(whole, np.array([0, 3000, len(whole)]), 400, 32)
        starts = [(t, s + k) for t, s, n in zip(x["text"].tolist(), x["start"].tolist(), x["starts"].tolist()) for k in range(n)]
        assert starts == [(0, s) for s in range(3000 - 399)] + [(1, s) for s in range(3000, len(whole) - 399)]


def test_query_table_against_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    check(spark, docs.text.tolist(), 400, docs.doc_id.tolist())
