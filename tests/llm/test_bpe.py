"""Encoding equals the public library; decoding is an exact round trip."""

import random

import numpy as np
import pytest

from larkspur.llm import bpe
from larkspur.llm.queries import vocabulary_path

TEXTS = [None, "", " ", "hello world", "a<|endoftext|>b", "<|endoftext|>", "it's  we'll\n\n x", "é漢字🙂 ñ", "x" * 5000, "ab" * 3000, "\x00\x01 \x1c\x85᠎ z", "   trailing  ", "12345 67٣"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_same_ids_as_library(library):
    codec = bpe.Codec(open(vocabulary_path(), "rb").read())
    rng = random.Random(5)
    alphabet = "ab cdeé'sst\n\t  12,.!?<|>endoftxt漢🙂\x1c\x85\xa0"
    for text in [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(2000)]:
        got = np.frombuffer(codec.encode(text), "<u4").tolist()
        want = library.encode(text, add_special_tokens=False).ids
        assert got == want, text
        assert codec.decode(codec.encode(text)) == library.decode(want, skip_special_tokens=False)


def test_frame_keeps_columns_and_rows(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, "twice", None), (1, "twice", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    out = bpe.decode(bpe.encode(df, vocabulary_path()), vocabulary_path())
    assert out.columns == ["doc_id", "text", "token_ids", "decoded"]
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == sorted((i, t or "") for i, t, _ in rows)
    assert all(r.decoded == (r.text or "") for r in out.collect())
    assert bpe.encode(df.limit(0), vocabulary_path()).count() == 0
