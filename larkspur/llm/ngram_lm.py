"""An interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, memory-mapped by workers.

Tokens are words of any bytes but white space, A-Z in lower case, and one end token after each text; a start token
is the first context. P(w | u) = max(c(uw) - D, 0) / c(u) + g(u) P1(w), where D depends on c(uw) being 1, 2 or
more, g(u) is the mass that u's discounts free, and P1 is the discounted share of the distinct contexts that w
follows, interpolated with the uniform distribution over all V known tokens and one unknown token. Nothing is
pruned or capped.

Counting: each task sorts the bigrams of its part of the text and sends one packed run of counts to each bucket;
a bucket (a hash of the context, spread further by the word for the few contexts that make up a large share of the
text) merges its runs, writes them to the shared folder as two arrays (sorted 64-bit bigram hashes, counts), and
passes on a row of sums for each token, which are pre-aggregated before the next shuffle. Which contexts are
frequent is estimated on one text in 64; this moves rows between buckets and changes no count. Unigram arrays are written likewise, by hash range.

Scoring: workers map the arrays into memory, look up the sorted distinct hashes of a piece of text at a time, and
keep no copy of the model; nothing of it goes through the driver but a few totals and file names. The shared
folder has to be mounted on the executors for that.

Defined cases: null is the empty text, whose only token is the end; with no training text N and V are 0 and every
token gets log10(1); counts of counts that are zero (tiny corpora) give the discounts 0.5, 1 and 1.5; repeated
rows are counted and scored each; a null id is in no fold but the training set; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, chunks, cut, give_back, mapped_arrays, mixed, mounted, new_path, save_arrays, word_hashes

START, END = np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x5A5A5A5A5A5A5A5A)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
#: Tokens that a task sorts at once, tokens of a bucket, tokens of a piece that is scored at once (bytes), and the share of the text that makes a context frequent.
RUN_TOKENS, BUCKET_TOKENS, LEAST_BUCKETS, PIECE_BYTES, FREQUENT = 1_200_000, 1_500_000, 16, 2 << 20, 1 / 1024


def token_pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and token of every position of a batch of texts, and the number of tokens of each text."""
    words, counts = word_hashes(column)
    sizes = counts + 1
    ends = np.cumsum(sizes) - 1
    tokens = np.empty(len(words) + len(counts), np.uint64)
    inside = np.ones(len(tokens), bool)
    inside[ends] = False
    tokens[inside], tokens[ends] = words, END
    contexts = np.empty_like(tokens)
    contexts[1:] = tokens[:-1]
    contexts[ends - counts] = START
    return contexts, tokens, sizes


def pair_keys(contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mixed(contexts * _PAIR + tokens)


@dataclass(frozen=True)
class Buckets:
    """Where the counts of a bigram are: by its context, and for a frequent context by its token as well."""

    number: int
    frequent: np.ndarray  # sorted hashes

    def of(self, contexts: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = (contexts >> np.uint64(20)) % np.uint64(self.number)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, contexts), len(self.frequent) - 1)
            spread = self.frequent[at] == contexts
            out[spread] = (keys[spread] >> np.uint64(20)) % np.uint64(self.number)
        return out.astype(np.int64)


@dataclass(frozen=True)
class Model:
    folder: str  # a mounted path
    buckets: Buckets
    parts: int  # of the unigram arrays
    discounts: tuple[float, float, float]
    unknown: float  # P1 of a token that was never seen
    total: int  # N
    distinct: int  # V


def _pack(contexts: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> bytes:
    order = np.argsort(contexts, kind="stable")
    u, n = np.unique(contexts[order], return_counts=True)
    return b"".join([np.array([len(u), len(tokens)], np.int64).tobytes(), u.tobytes(), n.astype(np.uint32).tobytes(), tokens[order].tobytes(), counts[order].astype(np.uint32).tobytes()])


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nu, nv = np.frombuffer(data, np.int64, 2)
    u = np.frombuffer(data, np.uint64, nu, 16)
    n = np.frombuffer(data, np.uint32, nu, 16 + 8 * nu)
    tokens = np.frombuffer(data, np.uint64, nv, 16 + 12 * nu)
    return np.repeat(u, n), tokens, np.frombuffer(data, np.uint32, nv, 16 + 12 * nu + 8 * nv)


def _plan(texts: DataFrame) -> Buckets:
    """Number of buckets and the frequent contexts, from one text in 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 0):
                u, n = np.unique(token_pairs(part.column(0))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["u", "n"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(64)) == 0)
    counts = cut(some.mapInArrow(run, "u long, n long").groupBy("u").agg(F.sum("n").alias("n")), "lm-sample")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.where(F.col("n") > max(total * FREQUENT, 16)).select("u").toArrow().column("u").to_numpy()  # at most 1/FREQUENT rows
    return Buckets(max(LEAST_BUCKETS, -(-total * 64 // BUCKET_TOKENS)), np.sort(often.astype(np.int64).view(np.uint64)))


def _runs(texts: DataFrame, buckets: Buckets) -> DataFrame:
    def pack(contexts: list[np.ndarray], tokens: list[np.ndarray]) -> pa.RecordBatch:
        u, v = np.concatenate(contexts), np.concatenate(tokens)
        keys, first, counts = np.unique(pair_keys(u, v), return_index=True, return_counts=True)
        u, v = u[first], v[first]
        where = buckets.of(u, keys)
        order = np.argsort(where, kind="stable")
        u, v, counts, where = u[order], v[order], counts[order], where[order]
        own, begin = np.unique(where, return_index=True)
        bounds = [*begin.tolist(), len(where)]
        packed = [_pack(u[a:b], v[a:b], counts[a:b]) for a, b in zip(bounds, bounds[1:])]
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(packed, pa.binary())], ["bucket", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, tokens, held = [], [], 0
        for batch in batches:
            for part in chunks(batch, 0):
                u, v, _ = token_pairs(part.column(0))
                contexts.append(u)
                tokens.append(v)
                held += len(u)
                if held >= RUN_TOKENS:
                    yield pack(contexts, tokens)
                    contexts, tokens, held = [], [], 0
        if held:
            yield pack(contexts, tokens)

    return texts.mapInArrow(run, "bucket int, run binary")


SUMS = ("total", "types", "n1", "n2", "n3", "n4", "follows")


def _merge(runs: DataFrame, folder: str) -> DataFrame:
    """Writes each bucket's arrays; gives for each token the sums over its bigrams as a context, and the contexts it follows."""

    def bucket(key: tuple, table: pa.Table) -> pa.Table:
        u, v, c = (np.concatenate(x) for x in zip(*(_unpack(r.as_py()) for r in table.column("run"))))
        keys = pair_keys(u, v)
        order = np.argsort(keys)
        keys = keys[order]
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.add.reduceat(c[order].astype(np.int64), begin)
        keys, u, v = keys[begin], u[order][begin], v[order][begin]
        save_arrays(folder, f"pairs-{key[0].as_py()}", keys=keys, counts=np.minimum(counts, 2**32 - 1).astype(np.uint32))
        token, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        of_u, of_v = at[: len(u)], at[len(u) :]
        sums = [np.bincount(of_u, weights=w, minlength=len(token)) for w in (counts, counts > 0, counts == 1, counts == 2, counts == 3, counts == 4)]
        sums.append(np.bincount(of_v, minlength=len(token)))
        give_back()
        return pa.table({"token": pa.array(token.view(np.int64))} | {n: pa.array(x.astype(np.int64)) for n, x in zip(SUMS, sums)})

    parts = runs.groupBy("bucket").applyInArrow(bucket, "token long, " + ", ".join(f"{n} long" for n in SUMS))
    return parts.groupBy("token").agg(*[F.sum(n).alias(n) for n in SUMS])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, from the numbers of entries counted once to four times."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.0), float(i + 1)) for i, d in enumerate(raw))


def _discount(count: Column, d: tuple[float, float, float]) -> Column:
    return F.when(count <= 0, 0.0).when(count == 1, d[0]).when(count == 2, d[1]).otherwise(d[2])


def train(texts: DataFrame, text: str = "text") -> Model:
    """Counts and writes the model of all rows of ``texts``."""
    spark = texts.sparkSession
    bounded_batches(spark)
    texts = texts.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    folder = mounted(new_path(spark, "lm"))
    buckets = _plan(texts)
    sums = cut(_merge(_runs(texts, buckets), folder), "lm-sums")
    end, start = (int(np.array(x).view(np.int64)) for x in (END, START))
    often = [F.sum((F.col("follows") == i).cast("long")).alias(f"f{i}") for i in range(1, 5)]
    known = F.col("follows") > 0  # every token but the start follows something
    t = sums.agg(*[F.sum(n).alias(n) for n in SUMS], *often, F.sum(known.cast("long")).alias("distinct"), F.sum(F.when(F.col("token") == start, F.col("total"))).alias("texts")).first()
    total, distinct = t["total"] or 0, t["distinct"] or 0
    if not total:
        return Model(folder, buckets, 0, (0.5, 1.0, 1.5), 1.0, 0, 0)
    d = discounts(t["n1"], t["n2"], t["n3"], t["n4"])
    lower = discounts(t["f1"], t["f2"], t["f3"], t["f4"])
    rest = distinct - t["f1"] - t["f2"]
    uniform = (lower[0] * t["f1"] + lower[1] * t["f2"] + lower[2] * rest) / t["follows"] / (distinct + 1)
    p1 = F.when(known, (F.col("follows") - _discount(F.col("follows"), lower)) / t["follows"]).otherwise(0.0) + uniform
    free = (d[0] * F.col("n1") + d[1] * F.col("n2") + d[2] * (F.col("types") - F.col("n1") - F.col("n2"))) / F.col("total")
    # the count of a token is that of its bigrams as a context; the end token is no context, and there is one in each text
    count = F.when(F.col("token") == end, F.lit(t["texts"])).when(F.col("token") == start, 0).otherwise(F.col("total"))
    parts = max(LEAST_BUCKETS, -(-distinct // 1_000_000))
    rows = sums.select(F.pmod(F.shiftrightunsigned("token", 20), F.lit(parts)).cast("int").alias("part"), "token", count.cast("long").alias("count"), F.col("total"), F.when(F.col("total") > 0, free).otherwise(1.0).alias("free"), p1.alias("p1"))

    def write(key: tuple, table: pa.Table) -> pa.Table:
        token = table.column("token").to_numpy().view(np.uint64)
        order = np.argsort(token)
        columns = {n: table.column(n).to_numpy()[order] for n in ("count", "total", "free", "p1")}
        save_arrays(folder, f"tokens-{key[0].as_py()}", keys=token[order], **columns)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32())})

    rows.groupBy("part").applyInArrow(write, "part int").count()
    return Model(folder, buckets, parts, d, uniform, total, distinct)


def _find(folder: str, name: str, columns: tuple[str, ...], wanted: np.ndarray, into: dict[str, np.ndarray], where: np.ndarray) -> None:
    """Puts the values of the ``wanted`` hashes (sorted) at ``where`` of the output columns; others stay as they are."""
    arrays = mapped_arrays(folder, name, columns)
    keys = arrays["keys"]
    if len(keys):
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        for c in into:
            into[c][where[hit]] = arrays[c][at[hit]]


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(buckets, kind="stable")
    own, begin = np.unique(buckets[order], return_index=True)
    bounds = [*begin.tolist(), len(order)]
    for b, x, y in zip(own.tolist(), bounds, bounds[1:]):
        yield b, order[x:y]


TOKEN_COLUMNS = ("keys", "count", "total", "free", "p1")


def _scored(model: Model, column: pa.Array) -> list[np.ndarray]:
    """Number of tokens, of known ones, base score and score of each text of a batch."""
    contexts, tokens, sizes = token_pairs(column)
    first = np.cumsum(sizes) - sizes
    if not model.total:
        return [sizes, np.zeros_like(sizes), np.zeros(len(sizes)), np.zeros(len(sizes))]
    words, at = np.unique(np.concatenate([tokens, [START]]), return_inverse=True)
    of = {"count": np.zeros(len(words), np.int64), "total": np.zeros(len(words), np.int64), "free": np.ones(len(words)), "p1": np.full(len(words), model.unknown)}
    for b, rows in _by_bucket(((words >> np.uint64(20)) % np.uint64(model.parts)).astype(np.int64)):
        _find(model.folder, f"tokens-{b}", TOKEN_COLUMNS, words[rows], of, rows)
    token = at[:-1]
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[first] = at[-1]
    keys, one, back = np.unique(pair_keys(contexts, tokens), return_index=True, return_inverse=True)
    pairs = {"counts": np.zeros(len(keys), np.int64)}
    for b, rows in _by_bucket(model.buckets.of(contexts[one], keys)):
        _find(model.folder, f"pairs-{b}", ("keys", "counts"), keys[rows], pairs, rows)
    count = pairs["counts"]
    over = count - np.array([0.0, *model.discounts])[np.minimum(count, 3)]
    total = np.maximum(of["total"][context[one]], 1)
    chance = np.maximum(over, 0) / total + of["free"][context[one]] * of["p1"][token[one]]
    known = of["count"][token]
    base = np.log10((known + 1) / (model.total + model.distinct + 1))
    return [sizes, np.add.reduceat((known > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(np.log10(chance)[back], first)]


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1, PIECE_BYTES):
                sizes, known, base, value = _scored(model, part.column(1))
                columns = [part.column(0), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), model.total)), pa.array(base), pa.array(value), pa.array(10.0 ** np.minimum(-value / sizes, 300))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
