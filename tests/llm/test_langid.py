"""Held-out accuracy, the backoff, and odd rows."""

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import langid
from larkspur.llm.queries import language_model, op2_langid

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return language_model(spark, SF)


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in op2_langid(spark, SF).collect() if r.held_out]
    wrong = [r for r in rows if truth[r.doc_id] != r.lang_pred]
    assert len(rows) > 1000 and len(wrong) <= 0.02 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_backoff_uses_longest_known_ngrams(model):
    words, counts, grams = langid.spans(pa.array(["thé ab", "x"]), 3)
    assert len(words) == 3 and counts.tolist() == [2, 1]
    found = {n: np.bincount(of, minlength=3).tolist() for n, _, of in grams(np.ones(3, bool))}
    assert found == {3: [1, 0, 0], 2: [2, 1, 0], 1: [3, 2, 1]}
    lang, score = langid.predict(model, pa.array(["ciónezadoqqq", "keitungschqq", "zzzz zz"]))
    assert lang[0] == "es" and lang[1] == "de"


def test_odd_rows(spark, model):
    texts = [None, "", " 123 --", "!!!", "漢字", "the and that of with", "der die und " * 50000, "é"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, lang_score int")
    out = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert [out[i].lang_pred for i in range(4)] == ["und"] * 4 and all(out[i].lang_score == 0 for i in range(4))
    assert out[4].lang_pred == "en" and abs(out[4].lang_score - 0.25) < 1e-6
    assert out[5].lang_pred == "en" and out[6].lang_pred == "de"
    assert langid.identify(df, model).columns == ["doc_id", "text", "lang_pred", "lang_score"]
    assert langid.identify(df.limit(0), model).count() == 0
    nothing = langid.fit(spark.createDataFrame([(1, None, "en"), (2, "a", None)], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}
