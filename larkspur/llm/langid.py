"""Language identification, words first, with a backoff to ever shorter character n-grams.

A word that was seen in training adds its log frequency in each language. An unseen word is scored by its longest
character n-grams of which any is known (from 5 characters down to 1): the mean log frequency of those n-grams,
times a small number of observations. The language with the highest sum wins; the score is its share of the
likelihoods, tempered by the number of words.

The model is fitted on a bounded sample of the rows with a language (``sample`` rows a language, drawn by a hash
of the id, so that rows of one id are drawn together), so its size does not grow with the table; counting is a Spark
aggregate. It is sent to the workers by broadcast. Every text is scored whole.

Defined cases: a null text and one without a letter are ``und`` with score 0; rows without text or language teach
nothing; a text none of whose words or characters is known gets the language with the most training rows, score
1/number of languages; ties go to the language first in order; repeated rows are scored each; with nothing to
learn from, every text is ``und``; a null id is drawn like any other value, and no id is used beyond that; other columns are kept, but for the output names, which replace columns of the
same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import LOWER, bounded_batches, chunks, cut, prefix_sums, span_hashes, text_bytes, word_spans

UNDETERMINED = "und"
#: Word bytes: ASCII letters, the apostrophe and everything outside ASCII.
SEPARATORS = np.ones(256, dtype=bool)
SEPARATORS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0x27, *range(0x80, 0x100)]] = False
ASCII_LETTER = np.zeros(256, dtype=bool)
ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


@dataclass(frozen=True)
class Settings:
    sample: int = 1_500  # rows of a language at most (expected) that teach
    longest: int = 5  # characters of the longest n-gram
    weight: float = 0.5  # observations that an unseen word counts for
    seed: int = 2


@dataclass(frozen=True)
class Model:
    languages: list[str]
    common: int  # the language with the most rows
    keys: list[np.ndarray]  # sorted hashes of words, then of n-grams of 1, 2, ... characters
    logs: list[np.ndarray]  # their log frequencies, a column for each language
    settings: Settings


def spans(column: pa.Array, longest: int, wanted: np.ndarray | None = None):
    """Hashes of the words; and for each n the hashes of the n-grams and the word that each is in (of the ``wanted`` words)."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, counts = word_spans(data, offsets, SEPARATORS)
    sums = prefix_sums(data)
    words = span_hashes(sums, starts, ends)

    def grams(mask: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        chosen = np.flatnonzero(mask)
        sizes = (ends - starts)[chosen]
        of = np.repeat(chosen, sizes)
        at = np.repeat(starts[chosen] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        lead = (data[at] & 0xC0) != 0x80  # the first byte of each character
        at, of = at[lead], of[lead]
        after = np.concatenate([at[1:], [0]])
        last = np.ones(len(at), bool)
        last[:-1] = of[1:] != of[:-1]
        after[last] = ends[of[last]]
        for n in range(longest, 0, -1):
            if len(at) < n:
                continue
            i = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :])
            yield n, span_hashes(sums, at[i], after[i + n - 1]), of[i]

    return words, counts, grams


def _lookup(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return at, keys[at] == hashes


def _has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter; only texts without an ASCII letter are looked at one by one."""
    data, offsets = text_bytes(column)
    seen = np.concatenate([[0], np.cumsum(ASCII_LETTER[data])])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = any(c.isalpha() for c in column[i].as_py() or "")
    return out


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a batch."""
    n_texts, n_langs = len(column), len(model.languages)
    letters = _has_letter(column)
    if not n_langs:
        return [UNDETERMINED] * n_texts, np.zeros(n_texts)
    words, counts, grams = spans(column, model.settings.longest)
    value = np.zeros((len(words), n_langs), np.float32)
    at, known = _lookup(model.keys[0], words)
    value[known] = model.logs[0][at[known]]
    counted = known.astype(np.float32)
    left = ~known
    if left.any():
        for n, hashes, of in grams(left):
            at, hit = _lookup(model.keys[n], hashes)
            hit &= left[of]
            if hit.any():
                of, rows = of[hit], model.logs[n][at[hit]]
                begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                word, size = of[begin], np.diff(np.append(begin, len(of)))
                value[word] = np.add.reduceat(rows, begin, axis=0) / size[:, None] * model.settings.weight
                counted[word] = model.settings.weight
                left[word] = False
    first = np.concatenate([[0], np.cumsum(counts)])
    sums = np.vstack([np.zeros((1, n_langs)), np.cumsum(value, axis=0, dtype=np.float64)])
    seen = np.concatenate([[0.0], np.cumsum(counted, dtype=np.float64)])
    total, n = sums[first[1:]] - sums[first[:-1]], seen[first[1:]] - seen[first[:-1]]
    total = total - total.max(axis=1, keepdims=True)
    share = np.exp(total / np.sqrt(np.maximum(n, 1.0))[:, None])
    share /= share.sum(axis=1, keepdims=True)
    best = total.argmax(axis=1)
    best[n == 0] = model.common
    score = np.where(letters, share[np.arange(n_texts), best], 0.0)
    return [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters.tolist())], score


def fit(docs: DataFrame, lang: str = "lang", settings: Settings = Settings()) -> Model:
    """The model of the texts of ``docs`` (doc_id, text and the language's column)."""
    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col(lang).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return Model([], 0, [np.zeros(0, np.uint64)] * (settings.longest + 1), [np.zeros((0, 0))] * (settings.longest + 1), settings)
    limits = F.create_map(*[F.lit(x) for name in languages for x in (name, int(min(1.0, settings.sample / sizes[name]) * 1_000_000))])
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(settings.seed), F.col("doc_id")), F.lit(1_000_000)) < limits[F.col("lang")])
    number = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 0):
                words, sizes, grams = spans(part.column(0), settings.longest)
                lang = np.repeat(np.array([number[x] for x in part.column(1).to_pylist()]), sizes)
                for n, hashes, of in [(0, words, np.arange(len(words))), *grams(np.ones(len(words), bool))]:
                    for value in np.unique(lang).tolist():
                        key, times = np.unique(hashes[lang[of] == value], return_counts=True)
                        same = np.full(len(key), n, np.int32), np.full(len(key), value, np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(same[0]), pa.array(same[1]), pa.array(key.view(np.int64)), pa.array(times)], ["n", "lang", "key", "times"])

    counted = drawn.select("text", "lang").mapInArrow(count, "n int, lang int, key long, times long").groupBy("n", "lang", "key").agg(F.sum("times").alias("times"))
    table = cut(counted, "langid").toArrow()  # bounded by the sample
    n, lang_of, key, times = (table.column(c).to_numpy() for c in ("n", "lang", "key", "times"))
    keys, logs = [], []
    for size in range(settings.longest + 1):
        own = n == size
        unique, at = np.unique(key[own].view(np.uint64), return_inverse=True)
        counts = np.zeros((len(unique), len(languages)))
        counts[at, lang_of[own]] = times[own]
        keys.append(unique)
        logs.append(np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * (len(unique) + 1))).astype(np.float32))
    common = max(range(len(languages)), key=lambda i: sizes[languages[i]])
    return Model(languages, common, keys, logs, settings)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``."""
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "lang_score")]
    at, keep = docs.columns.index(text), [docs.columns.index(c) for c in kept]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, at):
                lang, score = predict(sent.value, part.column(at))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*kept, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, schema)
