"""The pipeline's run against a chain of brute-force stages, and its stages on odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur.llm.queries import toxicity_model, vocabulary_path
from larkspur.llm import toxicity


SF = "/root/testdata/sf0.001"
pipeline = pytest.importorskip("corpus_pipeline")


def without_repeats(texts, length=50):
    """Texts without the words that repeated strings of ``length`` words cover, and the white space in and after these; nothing is left of a text without other words."""
    found = [[(m.start(), m.end(), m[0].lower()) for m in re.finditer("[^\\x20\\x09-\\x0d]+", t or "")] for t in texts]
    grams = [[tuple(w for _, _, w in f[i : i + length]) for i in range(len(f) - length + 1)] for f in found]
    seen = Counter(g for own in grams for g in own)
    out = []
    for t, f, own in zip(texts, found, grams):
        gone = {k for i, g in enumerate(own) if seen[g] > 1 for k in range(i, i + length)}
        begin = lambda k: f[k][0] if k < len(f) else len(t)
        cut = {x for k in gone for x in range(f[k][0], begin(k + 1))}
        out.append("" if f and len(gone) == len(f) else "".join(c for x, c in enumerate(t or "") if x not in cut))
    return out


def leaks(text, items):
    w = re.findall(r"[^\W_]+", text.lower())
    grams = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
    return any(tuple(i[k : k + 8]) in grams for i in items for k in range(len(i) - 7))


def check_near_duplicates(rows, left):
    """Who went is similar to somebody of a smaller id; nearly all pairs of 0.85 and more are down to one."""
    grams = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t.lower())
        grams[i] = frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    share = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    ids = sorted(grams)
    for i in ids:
        if i not in left:
            assert max(share(i, j) for j in ids if j != i) >= 0.7
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if share(a, b) >= 0.85]
    assert sum(not (a in left and b in left) for a, b in pairs) >= 0.9 * len(pairs)
    same = [(a, b) for a, b in pairs if grams[a] == grams[b]]
    assert not any(a in left and b in left for a, b in same)


def test_run_against_brute_force(spark):
    import hashlib

    from tokenizers import Tokenizer

    docs = pd.read_parquet(f"{SF}/documents.parquet")
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.score(frame, toxicity_model(spark, SF)).where("toxicity >= 0.5").collect()}
    rows = [(r.doc_id, r.text) for r in docs.itertuples() if r.doc_id not in toxic]
    left = {r.doc_id for r in pipeline.near_duplicate_stage(spark, frame.where(~F.col("doc_id").isin(list(toxic))), SF).collect()}
    check_near_duplicates(rows, left)
    rows = [(i, t) for i, t in rows if i in left]
    rows = list(zip([i for i, _ in rows], without_repeats([t for _, t in rows])))
    items = [re.findall(r"[^\W_]+", t.lower()) for t in pd.read_parquet(f"{SF}/benchmark.parquet").text]
    rows = [(i, t) for i, t in rows if not leaks(t, items)]
    library = Tokenizer.from_file(vocabulary_path())
    want = set()
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want.add((i, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(library.decode(ids, skip_special_tokens=False).encode())))
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < len(docs)


def test_short_passages_over_fifty_words_go(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 7)))
    passages = [" ".join(word() for _ in range(n)) for n in range(51, 71)]
    assert min(map(len, passages)) < 300
    rows = []
    for k, passage in enumerate(passages):
        for place in range(2 + k % 3):
            before, after = (" ".join(word() for _ in range(rng.randrange(1, 90))) for _ in range(2))
            rows.append((len(rows), f"{before}\n{passage if place else passage.upper()} {after}", "en", "hot", 7))
    rows += [(len(rows), " ".join(word() for _ in range(200)), "en", "clean", 7), (len(rows) + 1, passages[0].rsplit(" ", 2)[0], "en", "49 words", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = {r.doc_id: r for r in pipeline.repeat_stage(spark, docs, SF).collect()}
    want = without_repeats([t for _, t, *_ in rows])
    assert [got[i].text for i, *_ in rows] == want and len(got) == len(rows)
    assert not any(p in r.text.lower() for r in got.values() for p in passages)
    assert [got[i].text for i, *_ in rows[-2:]] == [t for _, t, *_ in rows[-2:]] and got[0].n_chars == len(got[0].text)


def test_stages_keep_columns_and_odd_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, toxicity double, _text string, said string, k1 int"
    text = " ".join(chr(97 + i % 7) + ("é" if i % 5 == 0 else "z") for i in range(300)) + " end"
    odd = [(1, None, None, None, None, 1.0), (2, "", "en", "s", 0, None), (3, text, "en", "s", len(text), 0.5), (4, "x y z " + text, None, None, None, None), (None, "alone here", "en", "s", 10, 0.1), (3, text, "en", "s", len(text), 0.5)]
    docs = spark.createDataFrame([(*row, "kept as it is", "", 9) for row in odd], kind)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    cut = {r.doc_id: r for r in pipeline.repeat_stage(spark, docs, SF).collect()}
    assert cut[1].text is None and cut[2].text == "" and cut[3].n_chars == len(cut[3].text) < len(text)
    kept = pipeline.near_duplicate_stage(spark, docs, SF)
    assert Counter(r.doc_id for r in kept.collect())[3] == 1
    assert {n for n, _ in pipeline.STAGES} and pipeline.ORACLE_SQL is None
