"""Scores against a plain dictionary model, sums to one, and odd rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import ngram_lm
from larkspur.llm.queries import op1_lm_score

SF = "/root/testdata/sf0.001"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), None]


class Plain:
    def __init__(self, texts):
        self.pairs, self.one = Counter(), Counter()
        for t in texts:
            ws = tokens(t)
            self.one.update(ws)
            self.pairs.update(zip(["<start>", *ws], ws))
        self.follows, self.context, self.types = Counter(v for _, v in self.pairs), Counter(), defaultdict(Counter)
        for (u, _), c in self.pairs.items():
            self.context[u] += c
            self.types[u][min(c, 3)] += 1
        n = Counter(self.pairs.values())
        self.d = (0, *ngram_lm.discounts(n[1], n[2], n[3], n[4]))
        f = Counter(self.follows.values())
        self.e = (0, *ngram_lm.discounts(f[1], f[2], f[3], f[4]))
        self.all = sum(self.follows.values())
        self.uniform = sum(self.e[min(c, 3)] for c in self.follows.values()) / self.all / (len(self.one) + 1)

    def p1(self, w):
        c = self.follows[w]
        return (c - self.e[min(c, 3)]) / self.all + self.uniform

    def p(self, u, w):
        if not self.context[u]:
            return self.p1(w)
        c = self.pairs[u, w]
        free = sum(self.d[k] * n for k, n in self.types[u].items()) / self.context[u]
        return max(c - self.d[min(c, 3)], 0) / self.context[u] + free * self.p1(w)

    def row(self, text):
        ws = tokens(text)
        total, distinct = sum(self.one.values()), len(self.one)
        base = sum(math.log10((self.one[w] + 1) / (total + distinct + 1)) for w in ws)
        return len(ws), sum(self.one[w] > 0 for w in ws), total, base, sum(math.log10(self.p(u, w)) for u, w in zip(["<start>", *ws], ws))


def test_query_against_plain_model(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out_fold = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    plain = Plain([t for i, t in docs.items() if not out_fold[i]])
    rows = op1_lm_score(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain.row(docs[r.doc_id])
        assert r.held_out == out_fold[r.doc_id] and (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3], rel=1e-9) and r.score == pytest.approx(want[4], rel=1e-6)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    known = [w for w in plain.one]
    for u in ("<start>", known[0], "never seen"):
        assert sum(plain.p(u, w) for w in known) + plain.p(u, "unknown word") == pytest.approx(1)


def test_odd_rows(spark, monkeypatch):
    texts = ["a b a b", None, "", " \n", "A\tb", "x" * 100_000, "a b " * 50_000, "a b a b", "漢 \x00 é"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a", 2)], "doc_id long, text string, score int")
    plain = Plain([*texts, "a"])
    model = ngram_lm.train(df)
    for r in ngram_lm.score(df, model).collect():
        want = plain.row("a" if r.doc_id is None else texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3] and r.score == pytest.approx(want[4], rel=1e-6)
    assert ngram_lm.score(df.limit(0), model).count() == 0
    empty = ngram_lm.train(df.limit(0))
    assert [(r.train_tokens, r.base_score, r.score) for r in ngram_lm.score(df.limit(1), empty).collect()] == [(0, 0.0, 0.0)]


def test_frequent_contexts_are_spread_without_loss(spark, monkeypatch):
    texts = [f"the w{i % 40} the the w{i % 7} of" for i in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    plain = Plain(texts)
    contexts = ngram_lm.token_pairs(pa.array(["the w1 of"]))[0]
    monkeypatch.setattr(ngram_lm, "_plan", lambda texts: ngram_lm.Buckets(16, np.sort(contexts[:3])))
    model = ngram_lm.train(df)
    for r in ngram_lm.score(df, model).collect():
        assert r.score == pytest.approx(plain.row(texts[r.doc_id])[4], rel=1e-6)
