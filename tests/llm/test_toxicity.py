"""Segments against brute force, odd rows, and held-out accuracy."""

import random

import pytest

from larkspur.llm import toxicity
from larkspur.llm.queries import op3_toxicity, toxicity_model

SF = "/root/testdata/sf0.1"


def all_maximal(scores):
    """Maximal segments by definition: the best segment of a range (leftmost, then shortest), then both sides of it."""
    out = []

    def split(lo, hi):
        best = max(((sum(scores[i : j + 1]), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i, hi)), default=(0,))
        if best[0] <= 0:
            return
        _, _, _, i, j = best
        split(lo, i)
        out.append((i, j, best[0]))
        split(j + 1, hi)

    split(0, len(scores))
    return out


def test_segments_are_the_maximal_ones():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-3, -1, -1, -1, 2, 5]) * 1.0 + rng.random() * 1e-3 for _ in range(rng.randrange(25))]
        at = [i for i, s in enumerate(scores) if s > -1.5 and s < -0.5]
        scores = [-1.0 if i in at else s for i, s in enumerate(scores)]
        given = [i for i in range(len(scores)) if i not in at]
        got = toxicity.segments(given, [scores[i] for i in given], -1.0)
        want = all_maximal(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want))


@pytest.fixture(scope="module")
def model(spark):
    return toxicity_model(spark, SF)


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [(labels[r.doc_id], r.predicted, r.score) for r in op3_toxicity(spark, SF).collect() if r.held_out and r.doc_id in labels]
    toxic, clean = [p for t, p, _ in rows if t], [p for t, p, _ in rows if not t]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)
    assert all(0 <= s <= 1 and (s >= 0.5) == bool(p) for _, p, s in rows)


def test_odd_rows(spark, model):
    insults = "This was fine but you IDIOT, moron; pathetic worthless scum! and so on"
    texts = [None, "", " .,;", "thing of the ering", insults, ("thing of the " * 20000) + insults, insults]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, toxicity int")
    out = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert toxicity.score(df, model).columns == ["doc_id", "text", "toxicity", "passages"]
    assert len(out) == 7 and out[0].toxicity == out[1].toxicity == out[2].toxicity < 0.5 and not out[3].passages
    assert out[4].toxicity > 0.5 and out[5].toxicity > 0.5 and out[4].toxicity == out[6].toxicity
    span = out[4].passages[0]
    assert insults.encode()[span.start : span.end].decode().startswith("IDIOT") and insults.encode()[span.start : span.end].decode().endswith("scum")
    assert toxicity.score(df.limit(0), model).count() == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert all(r.toxicity < 1e-9 for r in toxicity.score(docs, model).collect())
