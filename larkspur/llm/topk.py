"""Exact top-k search by inner product: a ball tree per shard, searched by branch and bound.

Vectors become integers, floor(scale * x), so scores are exact. Candidates go to the nearest of at most PIVOTS vectors
(drawn by a hash of the id, so their number and size do not grow with the table), and the candidates of a pivot to as
many shards as their number asks for, by hash. In a shard, nodes are visited in the order of the upper bound
q.c + |q| r of the inner product with anything in the ball (centre c, radius r), until no node can beat the current
k-th score. That score is shared between shards: each query first searches one pilot shard, of the pivot that it has
the highest product with, and then goes only to the shards of those pivots whose whole ball (the pivot and its
farthest candidate) can beat the k-th score found there; it is taken along. The queries of a shard are dealt to
blocks, if they are many; a cell is one shard with one block, and bounds the memory of a task. Equal scores go to the
smaller id, and a node that can only tie is skipped when all its ids are larger.

Defined cases: rows whose vector is null or holds null or non-finite components, and rows without an id, take no
part; vectors of another length than the query's are no candidates of it; exact repeats of a row count once, rows of one id
with different vectors are a candidate each (and may both be found), and a query never finds its own id; fewer than k candidates are all returned; empty tables give an empty table; other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut

#: Rows of a shard, and queries of a block, at most on average; a cell holds both. Pivots at most and at least, and rows of a leaf.
SHARD_ROWS, BLOCK_QUERIES, PIVOTS, LEAST_PIVOTS, LEAF = 1 << 15, 1 << 11, 1024, 8, 128


def quantised(df: DataFrame, vec_id: str, vector: str, scale: int = 256) -> DataFrame:
    """``vec_id, v`` with v = floor(scale * x) for the rows that take part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & fine)
    return rows.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"),
    )


class BallTree:
    """Nodes as arrays: centre, radius, smallest id, and either two children or a range of rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order].astype(np.float64)
        self.centres, self.radii, self.least, self.children, self.ranges = [], [], [], [], []
        self._build(np.arange(len(ids)))
        self.ids, self.rows = self.ids[self.order], self.rows[self.order]
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)

    def _build(self, top: np.ndarray) -> None:
        placed, stack = [], [(top, -1)]
        done = 0
        while stack:
            part, parent = stack.pop()
            node, x = len(self.radii), self.rows[part]
            if parent >= 0:
                self.children[parent].append(node)
            centre = x.mean(axis=0)
            away = np.sqrt(((x - centre) ** 2).sum(axis=1))
            self.centres.append(centre)
            self.radii.append(float(away.max()) * (1 + 1e-9) + 1e-9)
            self.least.append(int(self.ids[part].min()))
            self.children.append([])
            self.ranges.append((0, 0))
            if len(part) <= LEAF:
                self.ranges[node] = (done, done + len(part))
                placed.append(part)
                done += len(part)
                continue
            far = x[int(away.argmax())]
            other = x[int(((x - far) ** 2).sum(axis=1).argmax())]
            along = np.argsort(x @ (other - far), kind="stable")  # equal rows stay in the order of their ids
            half = len(part) // 2
            stack += [(np.sort(part[along[half:]]), node), (np.sort(part[along[:half]]), node)]
        self.order = np.concatenate(placed)

    def search(self, queries: np.ndarray, own: np.ndarray, floors: list[tuple[float, int] | None], k: int) -> list[list[tuple[int, int]]]:
        """For each query its best (score, id), best first; with a floor, only what beats that score and id."""
        q = queries.astype(np.float64)
        bounds = q @ self.centres.T + np.sqrt((q**2).sum(axis=1))[:, None] * self.radii[None, :]
        bounds = np.floor(bounds + 1e-9 * np.abs(bounds) + 1e-6)
        return [self._one(q[i], int(own[i]), bounds[i], floors[i], k) for i in range(len(q))]

    def _one(self, q: np.ndarray, own: int, bounds: np.ndarray, floor: tuple[float, int] | None, k: int) -> list[tuple[int, int]]:
        best: list[tuple[int, int]] = []  # (-score, id)
        last = (-floor[0], floor[1]) if floor else (np.inf, 0)
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if bound > last[0]:
                break
            if bound == last[0] and self.least[node] >= last[1]:
                continue
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-bounds[child], child))
                continue
            a, b = self.ranges[node]
            scores = -(self.rows[a:b] @ q)
            for i in np.flatnonzero(scores <= last[0]).tolist():
                found = (int(scores[i]), int(self.ids[a + i]))
                if found < last and found[1] != own:
                    best.append(found)
                    if len(best) >= k:
                        best.sort()
                        del best[k:]
                        last = min(last, best[-1])
        return [(-s, i) for s, i in sorted(best)[:k]]


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1) if table.num_rows else flat.reshape(0, 0)


def _cells(candidates: DataFrame, queries: DataFrame, key: list[str], k: int) -> DataFrame:
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            rows = np.unique(np.column_stack([left.column("vec_id").to_numpy(), _matrix(left, "v")]), axis=0)
            tree = BallTree(rows[:, 0], rows[:, 1:])
            own = right.column("query_id").to_numpy()
            floors = [None if s is None else (s, i) for s, i in zip(right.column("floor").to_pylist(), right.column("floor_id").to_pylist())]
            for query, best in zip(own.tolist(), tree.search(_matrix(right, "q"), own, floors, k)):
                found += [(query, vec, score) for score, vec in best]
        columns = list(zip(*found)) if found else [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})

    return candidates.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(cell, "query_id long, vec_id long, score long")


def _pmod(column: str, parts: Column | int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(parts) if isinstance(parts, int) else parts).cast("int")


def _pivots(candidates: DataFrame) -> dict[int, np.ndarray]:
    """Pivots by their length: one for each SHARD_ROWS candidates on average, PIVOTS at most."""
    wanted = min(PIVOTS, max(LEAST_PIVOTS, -(-candidates.count() // SHARD_ROWS)))
    drawn = candidates.orderBy(F.xxhash64(F.lit(4), "vec_id"), "vec_id").limit(wanted).select("v").toArrow().column("v").to_pylist()
    out: dict[int, list] = {}
    for v in drawn:
        out.setdefault(len(v), []).append(v)
    return {dim: np.unique(np.array(rows, np.float64).reshape(len(rows), dim), axis=0) for dim, rows in out.items()}


def _by_length(part: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each length of a batch's vectors, their rows, and the vectors as a matrix."""
    vectors = part.column(column)
    sizes = np.array([len(v) for v in vectors.to_pylist()], np.int64)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)


def _of(pivots: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """The pivots of a length; the origin where none was drawn."""
    return pivots.get(dim, np.zeros((1, dim)))


def _dealt(candidates: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``vec_id, v, dim, pivot, away``: each candidate with its nearest pivot, and its distance."""
    shared = candidates.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in _by_length(batch, 1):
                centres = _of(shared.value, dim)
                pivot = ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)
                away = np.sqrt(((x - centres[pivot]) ** 2).sum(axis=1))
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.full(len(at), dim, np.int32)), pa.array(pivot.astype(np.int32)), pa.array(away)], ["vec_id", "v", "dim", "pivot", "away"])

    return candidates.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<long>, dim int, pivot int, away double")


def _asked(queries: DataFrame, pivots: dict[int, np.ndarray], radii: dict[tuple[int, int], float], pilot: bool) -> DataFrame:
    """``query_id, q, dim, floor, floor_id, pivot``: each query with the pivot of its pilot, or with all whose ball can beat its floor."""
    shared = queries.sparkSession.sparkContext.broadcast((pivots, radii))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres_of, radius_of = shared.value
        for batch in batches:
            for dim, at, q in _by_length(batch, 1):
                own = np.array(sorted(p for d, p in radius_of if d == dim), np.int64)
                if not len(own):
                    continue
                product = q @ _of(centres_of, dim)[own].T
                if pilot:
                    row, pivot = np.arange(len(at)), own[product.argmax(axis=1)]
                else:
                    radius = np.array([radius_of[dim, p] for p in own.tolist()])
                    bound = product + np.sqrt((q**2).sum(axis=1))[:, None] * (radius * (1 + 1e-9) + 1e-9)
                    bound = np.floor(bound + 1e-9 * np.abs(bound) + 1e-6)
                    floor = batch.column(2).cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)[at]
                    row, which = np.nonzero(bound >= floor[:, None])
                    pivot = own[which]
                rows = pa.array(at[row])
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(rows) for i in (0, 1)], pa.array(np.full(len(row), dim, np.int32)), *[batch.column(i).take(rows) for i in (2, 3)], pa.array(pivot.astype(np.int32))], ["query_id", "q", "dim", "floor", "floor_id", "pivot"])

    return queries.select("query_id", "q", "floor", "floor_id").mapInArrow(run, "query_id long, q array<long>, dim int, floor long, floor_id long, pivot int")


def _searched(shards: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score`` of every query in the shard (dim, pivot, part) that it asks, in blocks of queries."""
    where = ["dim", "pivot", "part"]
    blocks = asked.groupBy(*where).agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks"))
    queries = asked.join(blocks, where).withColumn("block", _pmod("query_id", F.col("blocks"), 2)).drop("blocks")
    copies = shards.join(blocks, where).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return _cells(copies, queries, [*where, "block"], k)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k candidates of highest inner product of each query, both as :func:`quantised`."""
    pivots = _pivots(candidates)
    dealt = cut(_dealt(candidates, pivots), "candidates")
    balls = dealt.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("parts"), F.max("away").alias("radius"))
    balls = cut(balls, "balls")
    radii = {(r["dim"], r["pivot"]): r["radius"] for r in balls.collect()}  # PIVOTS rows for each length at most
    parts = balls.select("dim", "pivot", "parts")
    shards = dealt.join(parts, ["dim", "pivot"]).select("vec_id", "v", "dim", "pivot", _pmod("vec_id", F.col("parts"), 3).alias("part"))

    nothing = [F.lit(None).cast("long").alias("floor"), F.lit(None).cast("long").alias("floor_id")]
    queries = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct()
    first = _asked(queries.select("*", *nothing), pivots, radii, True).join(parts, ["dim", "pivot"])
    first = cut(first.withColumn("part", _pmod("query_id", F.col("parts"), 1)).drop("parts"), "pilots")
    found = cut(_searched(shards, first, k), "found")
    kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i"))).alias("last"))
    kth = kth.where(F.col("n") >= k).select("query_id", (-F.col("last.s")).alias("floor"), F.col("last.i").alias("floor_id"))
    armed = _asked(queries.join(kth, "query_id", "left"), pivots, radii, False).join(parts, ["dim", "pivot"])
    armed = armed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    armed = cut(armed.join(first.select("query_id", "dim", "pivot", "part"), ["query_id", "dim", "pivot", "part"], "left_anti"), "asked")
    rest = _searched(shards, armed, k)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.union(rest).select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= k)
