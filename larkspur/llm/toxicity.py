"""Toxic passages by maximum-scoring segments of token log-odds, calibrated as extreme values.

Learning: the numbers of toxic and clean texts with a token give log-odds with an informative Dirichlet prior (the
prior of a token is its share of all counts, and half a text). Tokens whose log-odds are many standard errors from
zero keep them; all others share one small negative score, so that the expected score of clean text is negative.
The first letters of tokens are counted as well, and stand in for a token without evidence of its own, so that new
endings of a known stem are found. Copies of a text teach once.

Scanning: every maximal scoring segment of a text is found in one linear pass (a stack of candidate segments with
their running totals); runs of tokens without evidence count as one step. A segment of score S in a text of n
tokens has E-value K n exp(-lambda S): lambda solves the equation that the clean tokens' scores give, K comes from
the clean texts' best segments. A segment whose E-value is under the limit is a toxic passage.

A text's evidence is the sum of lambda S - ln(K n) over its passages and the excess of its best one; a logistic fit on the training
rows turns these into a probability.

The model is fitted on a bounded sample of the labelled rows (``sample``, drawn by a hash of the id), so its size
is bounded too; it is sent to the workers with the function. Every text is scored whole.

Defined cases: null and empty texts have no passage and get the score of no evidence; an id with several labels is
toxic if one of them says so; null labels and labels of a null id teach nothing; a document with a null id is scored; without any labelled row every score is 0; repeated rows
are scored each; other columns are kept, but for the output names, which replace columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import LOWER, bounded_batches, chunks, cut, prefix_sums, span_hashes, text_bytes, word_spans

#: Token bytes: letters, digits, the apostrophe and everything outside ASCII; all others separate tokens.
SEPARATORS = np.ones(256, dtype=bool)
SEPARATORS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x27, *range(0x80, 0x100)]] = False


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000  # labelled rows at most (expected) that teach
    prior: float = 200.0  # total weight of the Dirichlet prior, in tokens
    least_z: float = 3.5  # standard errors from zero below which a token is no evidence
    stems: tuple[int, ...] = (6, 5, 4)  # bytes of the stems that stand in, longest first
    step: float = -0.15  # score of a token without evidence
    floor: float = -1.5  # lowest score of a token
    e_value: float = 0.05  # expected number of such segments in a clean text of the same length
    seed: int = 3


@dataclass(frozen=True)
class Model:
    tokens: np.ndarray  # sorted hashes of the tokens with evidence
    scores: np.ndarray
    settings: Settings
    rate: float = 1.0  # lambda
    log_k: float = 0.0
    weights: tuple[float, ...] = (-30.0, 0.0, 0.0, 0.0)


def token_hashes(column: pa.Array, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of all tokens of a batch, and the first token of each text (with the total at the end).

    Hashes have a row for the whole token and one for each stem length (0: the token is no longer than that).
    """
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, counts = word_spans(data, offsets, SEPARATORS)
    sums = prefix_sums(data)
    rows = [span_hashes(sums, starts, ends)]
    for size in stems:
        longer = ends - starts > size
        rows.append(np.where(longer, span_hashes(sums, starts, np.minimum(starts + size, ends)) ^ np.uint64(size), np.uint64(0)))
    return np.stack(rows), starts, ends, np.concatenate([[0], np.cumsum(counts)])


def evidence(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the tokens with evidence and their scores; the whole token's comes before its stems'."""
    if not len(model.tokens):
        return np.zeros(0, np.int64), np.zeros(0)
    scores = np.full(hashes.shape[1], np.nan)
    for row in hashes[::-1]:
        at = np.minimum(np.searchsorted(model.tokens, row), len(model.tokens) - 1)
        known = model.tokens[at] == row
        scores[known] = model.scores[at[known]]
    known = np.flatnonzero(~np.isnan(scores))
    return known, scores[known]


def segments(positions: list[int], scores: list[float], step: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first position, last position, score), in order.

    Tokens between the given positions score ``step`` each. Each candidate on the stack keeps the totals before and
    after it, and the nearest earlier candidate with a smaller total before is found by popping: linear in all.
    """
    stack: list[list] = []  # first, last, total before, total after
    total, previous = 0.0, -1
    for position, score in zip(positions, scores):
        total += step * (position - previous - 1)
        previous = position
        before, total = total, total + score
        if score <= 0:
            continue
        new = [position, position, before, total]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
        stack.append(new)
    return [(a, b, after - before) for a, b, before, after in stack]


def text_segments(model: Model, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float]], np.ndarray, np.ndarray]]:
    """For each text: number of tokens, maximal segments (token positions), starts and ends of its tokens in bytes of the text."""
    hashes, starts, ends, first = token_hashes(column, model.settings.stems)
    _, offsets = text_bytes(column)
    known, scores = evidence(model, hashes)
    cuts = np.searchsorted(known, first)
    for i in range(len(first) - 1):
        a, b = cuts[i], cuts[i + 1]
        found = segments((known[a:b] - first[i]).tolist(), scores[a:b].tolist(), model.settings.step) if a < b else []
        own = slice(first[i], first[i + 1])
        yield int(first[i + 1] - first[i]), found, starts[own] - offsets[i], ends[own] - offsets[i]


def excess(model: Model, score: float, n: int) -> float:
    """-ln of the E-value of a segment."""
    return model.rate * score - model.log_k - math.log(max(n, 1))


def features(model: Model, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float, float]:
    """Of a text: whether it has a passage, the total of its passages' excess, and that of its best segment, both with a ceiling."""
    values = [excess(model, s, n) for _, _, s in found]
    limit = -math.log(model.settings.e_value)
    passages = [v for v in values if v >= limit]
    return float(bool(passages)), min(sum(passages), 40.0), min(max([*values, -10.0]), 20.0)


def probability(model: Model, x: tuple[float, ...]) -> float:
    return 1 / (1 + math.exp(-min(max(model.weights[0] + float(np.dot(model.weights[1:], x)), -30), 30)))


def _teaching(docs: DataFrame, labels: DataFrame, label: str, settings: Settings) -> DataFrame:
    """``text, label`` of the sampled labelled rows."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("label"))
    share = min(1.0, settings.sample / max(known.count(), 1))
    drawn = known.where(F.pmod(F.xxhash64(F.lit(settings.seed), F.col("doc_id")), F.lit(1_000_000)) < int(share * 1_000_000))
    drawn = drawn.groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    rows = docs.select("doc_id", "text").join(drawn, "doc_id")
    return rows.groupBy("text").agg(F.max("label").alias("label"))


def _counts(rows: DataFrame, settings: Settings) -> DataFrame:
    """``token, toxic, clean``: the number of toxic and clean texts with each token or stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 0):
                hashes, _, _, first = token_hashes(part.column(0), settings.stems)
                text = np.repeat(np.arange(part.num_rows), np.diff(first))
                label = part.column(1).to_numpy(zero_copy_only=False) > 0
                seen = np.unique(np.stack([np.concatenate(hashes), np.tile(text.astype(np.uint64), len(hashes))]), axis=1)
                seen = seen[:, seen[0] != 0]
                toxic = label[seen[1].astype(np.int64)]
                token, at = np.unique(seen[0], return_inverse=True)
                n = [pa.array(np.bincount(at, weights=w, minlength=len(token)).astype(np.int64)) for w in (toxic, ~toxic)]
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), *n], ["token", "toxic", "clean"])

    return rows.mapInArrow(run, "token long, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _log_odds(counts: DataFrame, settings: Settings) -> DataFrame:
    """``token, score, toxic, clean`` of the tokens with evidence."""
    n1, n0 = (counts.agg(F.sum("toxic"), F.sum("clean")).first() or (0, 0))
    n1, n0 = n1 or 0, n0 or 0
    prior = F.lit(settings.prior) * (F.col("toxic") + F.col("clean")) / F.lit(float(max(n1 + n0, 1))) + 0.5

    def odds(y, n):
        return F.log((y + prior) / (F.lit(n + settings.prior + 1) - y - prior))

    delta = odds(F.col("toxic"), n1) - odds(F.col("clean"), n0)
    error = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    scored = counts.select("token", "toxic", "clean", delta.alias("delta"), (delta / error).alias("z"))
    return scored.where(F.abs("z") >= settings.least_z).select("token", F.greatest("delta", F.lit(settings.floor)).alias("score"), "toxic", "clean")


def _rate(scores: np.ndarray, clean: np.ndarray, total: float, step: float) -> float:
    """The positive root of sum p exp(lambda s) = 1 over the clean tokens' scores (with half a count for each token never seen clean)."""
    p = (clean + 0.5) / (total + 0.5 * len(clean) + 1)
    rest = max(1 - p.sum(), 1e-9)

    def f(x: float) -> float:
        return float((p * np.exp(np.minimum(x * scores, 600))).sum() + rest * math.exp(x * step)) - 1

    if not (scores > 0).any() or f(1e-6) >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if f(middle) < 0 else (low, middle)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic fit by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = 1e-2 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        new = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings = Settings()) -> Model:
    """The model of ``labels`` (doc_id and a 0/1 column) on the texts of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    rows = cut(_teaching(docs, labels, label, settings), "toxicity")
    counts = cut(_counts(rows, settings), "toxicity")
    known = _log_odds(counts, settings).toPandas().sort_values("token", key=lambda c: c.to_numpy().view(np.uint64))
    scores = known["score"].to_numpy(float)
    clean_total = float(counts.agg(F.sum("clean")).first()[0] or 0)
    model = Model(known["token"].to_numpy(np.int64).view(np.uint64), scores, settings, _rate(scores, known["clean"].to_numpy(float), clean_total, settings.step))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 0):
                top = [(n, max([0.0, *(s for _, _, s in found)])) for n, found, _, _ in text_segments(model, part.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in top], pa.int64()), pa.array([s for _, s in top], pa.float64()), part.column(1)], ["n", "s", "label"])

    # K: the mean of lambda S - ln n over clean texts is ln K plus Euler's constant; texts without a segment have S = 0
    tops = rows.mapInArrow(best, "n long, s double, label int")
    mean = tops.where("label = 0 and n > 0").agg(F.avg(model.rate * F.col("s") - F.log("n"))).first()[0]
    model = Model(model.tokens, model.scores, settings, model.rate, 0.0 if mean is None else max(mean - 0.5772156649, -math.log(1000.0)))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 0):
                x = [features(model, n, found) for n, found, _, _ in text_segments(model, part.column(0))]
                yield pa.RecordBatch.from_arrays([*[pa.array(v, pa.float64()) for v in zip(*x)], part.column(1)], ["a", "b", "c", "label"])

    seen = rows.mapInArrow(measured, "a double, b double, c double, label int").toPandas()
    if seen["label"].nunique() < 2:
        weights = (30.0 if len(seen) and seen["label"].iloc[0] else -30.0, 0.0, 0.0, 0.0)
    else:
        weights = tuple(map(float, _logistic(seen[["a", "b", "c"]].to_numpy(float), seen["label"].to_numpy(float))))
    return Model(model.tokens, model.scores, settings, model.rate, model.log_k, weights)


PASSAGE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("e_value", T.DoubleType())]))
_ARROW_PASSAGE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("e_value", pa.float64())]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``passages`` (byte spans of the text in UTF-8, with their E-values)."""
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("toxicity", "passages")]
    at, keep = docs.columns.index(text), [docs.columns.index(c) for c in kept]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("toxicity", T.DoubleType()), T.StructField("passages", PASSAGE)])
    limit = -math.log(model.settings.e_value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, at):
                values, spans = [], []
                for n, found, starts, ends in text_segments(model, part.column(at)):
                    values.append(probability(model, features(model, n, found)))
                    spans.append([{"start": int(starts[a]), "end": int(ends[b]), "e_value": math.exp(-min(v, 700.0))} for a, b, s in found if (v := excess(model, s, n)) >= limit])
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], pa.array(values, pa.float64()), pa.array(spans, _ARROW_PASSAGE)], [*kept, "toxicity", "passages"])

    return docs.mapInArrow(run, schema)
