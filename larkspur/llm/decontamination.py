"""Benchmark decontamination by latent semantic retrieval, with sequence and answer checks.

1. Document frequencies of hashed words over all documents (``BUCKETS`` buckets, so their number is bounded).
2. Benchmark items are split into passages; their TF-IDF rows are factored by a randomised SVD: tasks multiply their
   rows by a random matrix and its images (partial sums are added up by a shuffle), and the driver orthonormalises
   the result, whose size is bounded by BUCKETS x RANK.
3. Every document is read in overlapping windows. A window is a candidate by its cosine with a passage, or by the share
   of the passage's own squared weight that it covers, whatever else is in the window: the words of an item that many
   documents carry are cheap, and the other words of the window would outweigh them. A window that cannot reach the
   covered share with any passage, by each word's largest share in one, nor the cosine limit, by
   its weight in the benchmark's rare words and in its common ones (for each part the smaller of the bound by Cauchy
   and Schwarz and of the sum with each word's largest weight in a passage), is passed over without loss; the others are folded into the latent space and compared with all passages. Cosines are corrected
   for the part of a passage that the factors hold.
4. Around each candidate the longest common subsequence of the words with the whole item is found (bit-parallel),
   and its answer (the last quarter of its words) is looked for in the same place. A document is contaminated by an
   item if the subsequence covers ``exact`` of the item, or ``paraphrase`` of it and the answer is there.

Benchmarks are searched in blocks of ``BLOCK_ITEMS`` items and ``BLOCK_CHARS`` characters at most on average; what a
block sends to the workers is bounded. Documents are never shuffled.

Defined cases: null and empty texts match nothing; items without words take no part; repeated items count once;
repeated documents are marked each; an empty benchmark marks nothing; other columns are kept, but for ``matches``,
which replaces a column of that name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, bounded_batches, chunks, cut, prefix_sums, span_hashes, text_bytes, word_spans

BUCKETS, RANK, EXTRA, ROUNDS, BLOCK_ITEMS, BLOCK_CHARS = 1 << 17, 256, 8, 2, 4096, 8 << 20
#: Words are letters (capitals of ASCII and Latin-1 in lower case), digits and everything outside ASCII; punctuation separates.
SEPARATORS = np.ones(256, dtype=bool)
SEPARATORS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


@dataclass(frozen=True)
class Settings:
    windows: tuple[int, ...] = (32, 64)  # words; a passage is looked for in the smallest window that holds it
    cosine: float = 0.35
    covered: float = 0.45  # or this share of the passage's own squared weight, a quarter below what ``paraphrase`` keeps
    floor: float = 0.1  # least idf, so that words which all documents carry still count
    common: float = 0.01  # share of documents from which on a word counts as common (for the bound only)
    exact: float = 0.8
    paraphrase: float = 0.6
    answer: float = 0.75  # part of the answer's words that has to be there, in order


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, and the number of words of each text."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    # capitals of Latin-1 are a byte 0xC3 and one of 0x80-0x9E (0x97 is a sign) in UTF-8
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[capital] += 32
    starts, ends, counts = word_spans(data, offsets, SEPARATORS)
    return span_hashes(prefix_sums(data), starts, ends), counts


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def inverse_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log((N + 1) / (df + 1)) for each bucket, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part in chunks(batch, 0):
                hashes, counts = words_of(part.column(0))
                pair = np.sort(np.repeat(np.arange(len(counts)), counts) * BUCKETS + bucket_of(hashes))
                pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
                df += np.bincount(pair % BUCKETS, minlength=BUCKETS)
                n += len(counts)
        own = np.flatnonzero(df)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(own, -1).astype(np.int32)), pa.array(np.append(df[own], n))], ["bucket", "n"])

    sums = docs.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS + 1 rows at most
    df = np.zeros(BUCKETS + 1, np.int64)
    df[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()  # the number of documents is at -1
    return np.log((df[-1] + 1) / (df[:-1] + 1)).astype(np.float32)


def passages(hashes: np.ndarray, longest: int) -> list[tuple[int, int]]:
    """Ranges of words that cover an item, none longer than a window and none much shorter than the others."""
    parts = max(1, -(-len(hashes) // longest))
    cuts = [round(len(hashes) * i / parts) for i in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


def weights(hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and TF-IDF weights of a passage, scaled to length one."""
    bucket, n = np.unique(bucket_of(hashes), return_counts=True)
    w = n * idf[bucket]
    length = math.sqrt(float((w * w).sum()))
    return bucket, (w / length if length > 0 else w).astype(np.float32)


def _products(rows: DataFrame, spark, right: np.ndarray, index: np.ndarray) -> np.ndarray:
    """A^T (A right) for the sparse rows of A: partial sums in the tasks, added up by bucket."""
    shared = spark.sparkContext.broadcast((right, index))
    width = right.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, at = shared.value
        out = np.zeros_like(matrix)
        some = False
        for batch in batches:
            for bucket, weight in zip(batch.column("bucket").to_pylist(), batch.column("weight").to_pylist()):
                row, w = at[np.array(bucket, np.int64)], np.array(weight, np.float32)
                out[row] += w[:, None] * (w @ matrix[row])
                some = True
        if some:
            own = np.flatnonzero(np.abs(out).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(out[own].ravel()), width).cast(pa.list_(pa.float32()))], ["row", "v"])

    def add(table: pa.Table) -> pa.Table:
        row = table.column("row").to_numpy()
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(row), width)
        order = np.argsort(row, kind="stable")
        own, begin = np.unique(row[order], return_index=True)
        sums = np.add.reduceat(v[order], begin, axis=0).astype(np.float32)
        return pa.table({"row": pa.array(own.astype(np.int32)), "v": pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), width).cast(pa.list_(pa.float32()))})

    kind = "row int, v array<float>"
    summed = rows.select("bucket", "weight").mapInArrow(run, kind).groupBy(F.pmod(F.col("row"), F.lit(64))).applyInArrow(add, kind).toArrow()
    out = np.zeros_like(right)
    if summed.num_rows:
        out[summed.column("row").to_numpy()] = summed.column("v").combine_chunks().flatten().to_numpy().reshape(summed.num_rows, width)
    return out


def factors(rows: DataFrame, n_rows: int, index: np.ndarray, n_words: int, rank: int = RANK) -> np.ndarray:
    """The right singular vectors (n_words x rank at most) of the passages' TF-IDF rows, by randomised subspace iteration."""
    width = min(rank + EXTRA, n_rows, n_words)
    v = np.linalg.qr(np.random.default_rng(11).standard_normal((n_words, width)))[0].astype(np.float32)
    for _ in range(ROUNDS):
        v, r = np.linalg.qr(_products(rows, rows.sparkSession, v, index))
    # the small factor's singular vectors put the directions in order of weight
    u = np.linalg.svd(r.T)[0] if width else np.zeros((0, 0))
    return (v @ u)[:, :rank].astype(np.float32)


@dataclass(frozen=True)
class Index:
    """What a block of items sends to the workers."""

    idf: np.ndarray
    words: np.ndarray  # sorted hashes of the items' words
    maybe: np.ndarray  # whether a word with these 20 leading bits is among them
    limit: float  # idf of the rarest common word
    shared: dict[int, float]  # for each window size the largest common part of a passage
    at: np.ndarray  # bucket -> row of ``vectors``, or -1
    most: np.ndarray  # for each row the largest weight in a passage
    most_share: np.ndarray  # for each row the largest weight in a passage, over the passage's length
    vectors: np.ndarray
    items: list[tuple[int, np.ndarray]]  # item_id and its words
    passage_item: np.ndarray
    passage_range: np.ndarray
    passage_window: np.ndarray
    passage_length: np.ndarray  # of the TF-IDF row before scaling
    latent: np.ndarray  # passages x rank, divided by the squared length that the factors hold


def build(spark, items: list[tuple[int, np.ndarray]], idf: np.ndarray, settings: Settings) -> Index:
    longest = max(settings.windows)
    of, ranges, rows = [], [], []
    for k, (_, words) in enumerate(items):
        for a, b in passages(words, longest):
            bucket, weight = weights(words[a:b], idf)
            of.append(k)
            ranges.append((a, b))
            rows.append((bucket.tolist(), weight.tolist()))
    used = np.unique(np.concatenate([r for r, _ in rows])).astype(np.int64)
    at = np.full(BUCKETS, -1, np.int32)
    at[used] = np.arange(len(used))
    most, most_share = np.zeros(len(used)), np.zeros(len(used))
    length = np.ones(len(rows))
    for k, (bucket, weight) in enumerate(rows):
        raw = np.unique(bucket_of(items[of[k]][1][slice(*ranges[k])]), return_counts=True)[1] * idf[bucket]
        length[k] = max(math.sqrt(float((raw * raw).sum())), 1e-6)
        np.maximum.at(most, at[np.array(bucket)], weight)
        np.maximum.at(most_share, at[np.array(bucket)], np.array(weight) / length[k])
    frame = spark.createDataFrame(rows, "bucket array<int>, weight array<float>").repartition(8)
    vectors = factors(frame, len(rows), at, len(used))
    latent = np.stack([np.array(w, np.float32) @ vectors[at[np.array(b)]] for b, w in rows])
    latent /= np.maximum((latent * latent).sum(axis=1, keepdims=True), 1e-6)
    ranges = np.array(ranges)
    size = ranges[:, 1] - ranges[:, 0]
    window = np.array([min(w for w in settings.windows if w >= min(s, longest)) for s in size])
    words = np.unique(np.concatenate([w for _, w in items]))
    maybe = np.zeros(1 << 20, bool)
    maybe[(words >> np.uint64(44)).astype(np.int64)] = True
    limit = -math.log(settings.common)
    part = np.array([math.sqrt(sum(x * x for b, x in zip(*row) if idf[b] <= limit)) for row in rows])
    shared = {w: float(part[window == w].max()) for w in set(window.tolist())}
    return Index(idf, words, maybe, limit, shared, at, most, most_share, vectors, items, np.array(of), ranges, window, length, latent)


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence; a's positions are the bits of one integer."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for x in b:
        if hit := where.get(x, 0) & state:
            state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def _candidates(index: Index, settings: Settings, hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """``text, first word, passage, cosine`` of the windows near a passage."""
    bucket = bucket_of(hashes)
    w = index.idf[bucket]
    inside = np.flatnonzero(index.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
    there = np.minimum(np.searchsorted(index.words, hashes[inside]), len(index.words) - 1)
    inside = inside[index.words[there] == hashes[inside]]
    row = np.full(len(hashes), -1, np.int32)
    row[inside] = index.at[bucket[inside]]

    def sums(chosen: np.ndarray, values: np.ndarray) -> np.ndarray:
        x = np.zeros(len(hashes) + 1)
        x[chosen + 1] = values
        return np.cumsum(x)

    square = w.astype(np.float64) ** 2
    energy = sums(np.arange(len(hashes)), square)
    is_common = w[inside] <= index.limit
    parts = [(chosen, sums(chosen, square[chosen]), sums(chosen, w[chosen] * index.most[row[chosen]])) for chosen in (inside[~is_common], inside[is_common])]
    reach = sums(inside, w[inside] * index.most_share[row[inside]])
    first = np.cumsum(counts) - counts
    for size in settings.windows:
        own = np.flatnonzero(index.passage_window == size)
        if not len(own):
            continue
        step = size // 4
        number = np.where(counts > 0, np.maximum(-(-(counts - size) // step), 0) + 1, 0)
        text = np.repeat(np.arange(len(counts)), number)
        start = first[text] + step * (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number))
        end = np.minimum(start + size, (first + counts)[text])
        total = energy[end] - energy[start]
        bound = sum(np.minimum(most * np.sqrt(np.maximum(a[end] - a[start], 0)), b[end] - b[start]) for most, (_, a, b) in zip((1.0, index.shared[size]), parts))
        may = (bound * 1.0001 + 1e-6 >= settings.cosine * np.sqrt(np.maximum(total, 0))) | ((reach[end] - reach[start]) * 1.0001 + 1e-6 >= settings.covered)
        near = np.flatnonzero(may & (total > 0))
        for i in near.tolist():
            a, b = start[i], end[i]
            some = np.flatnonzero(row[a:b] >= 0) + a
            q = w[some] @ index.vectors[row[some]]
            dot = index.latent[own] @ q
            cosine = dot / math.sqrt(total[i])
            for p in np.flatnonzero((cosine >= settings.cosine) | (dot >= settings.covered * index.passage_length[own])).tolist():
                yield int(text[i]), int(a - first[text[i]]), int(own[p]), float(cosine[p])


def matches(index: Index, settings: Settings, column: pa.Array) -> list[list[dict]]:
    """For each text of a batch the items that contaminate it."""
    hashes, counts = words_of(column)
    first = np.cumsum(counts) - counts
    found: list[dict[int, dict]] = [{} for _ in range(len(counts))]
    tried: set[tuple[int, int, int]] = set()
    for text, start, passage, cosine in _candidates(index, settings, hashes, counts):
        k = int(index.passage_item[passage])
        item_id, words = index.items[k]
        slack = len(words) // 4 + 8
        low = max(0, start - int(index.passage_range[passage, 0]) - slack)
        high = min(int(counts[text]), start + int(index.passage_window[passage]) + len(words) - int(index.passage_range[passage, 0]) + slack)
        if (text, k, low) in tried:
            continue
        tried.add((text, k, low))
        region = hashes[first[text] + low : first[text] + high].tolist()
        item = words.tolist()
        share = common(item, region) / len(item)
        if share < settings.paraphrase or share <= found[text].get(item_id, {}).get("common", 0.0):
            continue
        answer = item[-max(1, len(item) // 4) :]
        has = common(answer, region) >= settings.answer * len(answer)
        if share >= settings.exact or has:
            found[text][item_id] = {"item_id": item_id, "cosine": cosine, "common": share, "answer": has, "first_word": low, "words": high - low}
    return [[f[k] for k in sorted(f)] for f in found]


MATCH = "item_id long, cosine double, common double, answer boolean, first_word int, words int"
_ARROW_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("common", pa.float64()), ("answer", pa.bool_()), ("first_word", pa.int32()), ("words", pa.int32())]))


def _items(benchmark: DataFrame, part: int, parts: int) -> list[tuple[int, np.ndarray]]:
    """Item ids and words of one block (bounded by BLOCK_ITEMS and BLOCK_CHARS on average), in the order of ids."""
    own = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).toArrow()
    hashes, counts = words_of(own.column("text").combine_chunks())
    bounds = np.concatenate([[0], np.cumsum(counts)])
    items = [(i, hashes[a:b]) for i, a, b in zip(own.column("item_id").to_pylist(), bounds, bounds[1:]) if b > a]
    return sorted(items, key=lambda x: (x[0], len(x[1])))


def annotate(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """``docs`` with ``matches``: the items (item_id, text) of ``benchmark`` that contaminate each text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    idf = np.maximum(inverse_frequencies(docs, text), np.float32(settings.floor))
    benchmark = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    benchmark = cut(benchmark, "benchmark")
    size = benchmark.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    parts = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["chars"] // BLOCK_CHARS))
    kept = [c for c in docs.columns if c.lower() != "matches"]
    out = docs.select(*kept, F.array().cast(f"array<struct<{MATCH.replace(' ', ':').replace(',:', ',')}>>").alias("matches"))
    for part in range(parts):
        if items := _items(benchmark, part, parts):
            out = _search(out, spark.sparkContext.broadcast(build(spark, items, idf, settings)), settings, text)
    return out


def _search(docs: DataFrame, index, settings: Settings, text: str) -> DataFrame:
    at, last = docs.columns.index(text), len(docs.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, at):
                made = [old + new for old, new in zip(part.column(last).to_pylist(), matches(index.value, settings, part.column(at)))]
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(made, _ARROW_MATCH)], part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id`` and the match's columns for every contaminated document and item."""
    found = annotate(docs.select("doc_id", "text"), benchmark, settings).select("doc_id", F.explode("matches").alias("m"))
    return found.select("doc_id", "m.*")


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones."""
    return annotate(docs, benchmark, settings, text).where(F.size("matches") == 0).select(*docs.columns)
