"""The search against all scores by brute force, ties, odd rows and tiny shards."""

import duckdb
import numpy as np
import pytest

from larkspur.llm import topk
from larkspur.llm.queries import OP4_SQL, op4_topk

SF = "/root/testdata/sf0.01"


def brute(rows, k, every):
    out = []
    for qi, q in {(i, tuple(v)) for i, v in rows if i % every == 0}:
        scored = sorted({(-sum(a * b for a, b in zip(q, v)), i, tuple(v)) for i, v in rows if i != qi and len(v) == len(q)})
        out += [(qi, r + 1, i, -s) for r, (s, i, _) in enumerate(scored[:k])]
    return sorted(out)


def test_query_against_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS FROM '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, op4_topk(spark, SF).collect())) == sorted(duckdb.sql(OP4_SQL).fetchall())


@pytest.mark.parametrize("leaf", [4, 128])
def test_ties_and_repeats(spark, leaf, monkeypatch):
    monkeypatch.setattr(topk, "LEAF", leaf)
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-3, 4, 4).tolist()) for i in range(300)] + [(i, [1, 1, 1, 1]) for i in range(300, 500)] + [(7, [9, 9])] + [(10, [1, 1, 1, 1])] * 3
    df = spark.createDataFrame(rows, "vec_id long, v array<bigint>")
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 10 = 0"), 5).collect()))
    want = brute(rows, 5, 10)
    assert [g for g in got if g[0] != 10] == [w for w in want if w[0] != 10]
    tree = topk.BallTree(np.arange(500), np.array([v for _, v in rows[:500]]))
    assert sorted(tree.ids.tolist()) == list(range(500))


def test_small_shards_blocks_and_far_clusters(spark, monkeypatch):
    """Hot pivots in several shards, hot shards in several blocks; queries go only where they can still win."""
    for name, value in {"SHARD_ROWS": 16, "BLOCK_QUERIES": 4, "PIVOTS": 12, "LEAF": 4}.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    centres = rng.integers(-900, 900, (4, 3))
    rows = [(i, (centres[0 if i % 3 == 0 else i % 4] + rng.integers(-9, 9, 3)).tolist()) for i in range(400)] + [(400 + i, centres[1].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, v array<bigint>")
    asked = []
    searched = topk._searched
    monkeypatch.setattr(topk, "_searched", lambda shards, queries, k: asked.append((shards, queries)) or searched(shards, queries, k))
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 10 = 0"), 5).collect()))
    assert got == brute(rows, 5, 10)
    shards = asked[0][0].select("dim", "pivot", "part").distinct().count()
    pairs, queries = asked[1][1].count(), sum(i % 10 == 0 for i, _ in rows)
    assert shards > 20 and pairs < queries * shards / 2


def test_odd_rows(spark):
    rows = [(0, [0.5, 0.1]), (1, [0.5, 0.1]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, []), (50, [-0.001, 1.0]), (100, [1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    fine = topk.quantised(df, "vec_id", "embedding")
    assert sorted(r.vec_id for r in fine.collect()) == [0, 1, 6, 50, 100]
    out = sorted(map(tuple, topk.top_k(fine, fine.where("vec_id % 50 = 0")).collect()))
    assert out == [(0, 1, 1, 128 * 128 + 25 * 25), (0, 2, 50, -128 + 25 * 256), (50, 1, 0, -128 + 25 * 256), (50, 2, 1, -128 + 25 * 256)]
    assert topk.top_k(fine.limit(0), fine.limit(0)).count() == 0
