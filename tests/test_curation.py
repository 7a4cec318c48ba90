"""Merge chains, unmerges and shipped files."""

import random

from pyspark.sql import functions as F

from larkspur.operators import curation as C
from larkspur.written import cut

TABLE = "key long, name string, aliases array<string>, status string, merged_into long"


def people(spark, n=30):
    return spark.createDataFrame([(k, f"n{k}", [f"a{k}", f"shared{k % 3}"], "approved", None) for k in range(n)], TABLE)


def rows(df):
    return sorted((r.key, r.name, tuple(sorted(r.aliases or [])), r.status, r.merged_into) for r in df.collect())


def test_roots_of_chains_and_cycles(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 100), (300, 300), (400, 401), (None, 1), (5000, None)]
    got = {r.key: (r.root, r.steps) for r in C.roots(spark.createDataFrame(links, "key long, into long")).collect()}
    assert got == {**{k: (40, 40 - k) for k in range(40)}, 100: (None, None), 101: (None, None), 102: (None, None), 200: (None, None), 300: (None, None), 400: (401, 1)}
    assert C.roots(spark.createDataFrame([], "key long, into long")).count() == 0


def test_verdicts(spark):
    table = people(spark, 12).withColumn("status", F.when(F.col("key") == 11, "merged").otherwise(F.col("status")))
    wanted = [(0, 1), (1, 2), (3, 3), (4, 11), (11, 5), (5, 99), (98, 5), (6, 7), (6, 8), (8, 9), (9, 10), (10, 8), (7, 8)]
    got = {(r.loser, r.winner): r.verdict for r in C.judged(table, spark.createDataFrame(wanted, "loser long, winner long")).collect()}
    assert got == {(0, 1): "ok", (1, 2): "ok", (3, 3): "self", (4, 11): "gone", (11, 5): "merged", (5, 99): "unknown", (98, 5): "unknown", (6, 7): "twice", (6, 8): "twice", (8, 9): "cycle", (9, 10): "cycle", (10, 8): "cycle", (7, 8): "cycle"}


def one_by_one(start, merges):
    """The same by hand, from the losers up."""
    state = {r[0]: [r[1], set(r[2]), r[3], r[4]] for r in start}
    into = dict(merges)
    depth = lambda k: 1 + depth(into[k]) if k in into else 0
    for k in sorted(into, key=depth, reverse=True):
        w = into[k]
        state[w][1] |= ({state[k][0]} | state[k][1]) - {state[w][0]}
        state[k][2:] = ["merged", w]
    return sorted((k, n, tuple(sorted(a)), s, m) for k, (n, a, s, m) in state.items())


def test_chains_merge_and_come_back(spark):
    start = people(spark)
    chain = [(k, k + 1) for k in range(10)] + [(20, 10), (21, 20), (22, 20), (25, 26)]
    after, record = C.merged(start, spark.createDataFrame(chain, "loser long, winner long"), 1)
    assert rows(after) == one_by_one(rows(start), chain)
    back, left = C.unmerged(after, record, spark.createDataFrame([(k,) for k, _ in chain], "key long"))
    assert rows(back) == rows(start) and left.count() == 0
    # one alone comes back; what another loser brought as well stays
    one, left = C.unmerged(after, record, spark.createDataFrame([(21,), (999,)], "key long"))
    want = one_by_one(rows(start), [m for m in chain if m[0] != 21])
    got = {r[0]: r for r in rows(one)}
    assert got[21] == rows(start)[21] and got[20] == next(r for r in want if r[0] == 20) and left.count() == len(chain) - 1


def test_merges_on_merges(spark):
    rng = random.Random(2)
    state, plain, records = people(spark), rows(people(spark)), []
    for seq in range(3):
        alive = [r[0] for r in plain if r[3] != "merged"]
        rng.shuffle(alive)
        merges = [(alive[2 * i], alive[2 * i + 1]) for i in range(4)]
        state, record = C.merged(state, spark.createDataFrame(merges, "loser long, winner long"), seq)
        state, record = cut(state, "t"), cut(record, "t")
        plain, records = one_by_one(plain, merges), [record, *records]
        assert rows(state) == plain
    links = spark.createDataFrame([(k, f"i{k}") for k in range(30)], "key long, item string")
    into = {r[0]: r[4] for r in plain if r[4] is not None}
    end = lambda k: end(into[k]) if k in into else k
    assert {r.item: r.key for r in C.resolved(links, state, "key").collect()} == {f"i{k}": end(k) for k in range(30)}
    for record in records:  # the last first
        state, _ = C.unmerged(state, record, record.select(F.col("loser").alias("key")))
    assert rows(state) == rows(people(spark))


ROW = "key long, name string, tags array<string>, size int"


def test_reconcile(spark):
    last = [(k, f"n{k}", ["t"], k) for k in range(12)]
    new = [(0, "n0", ["t"], 0), (1, "file", ["t"], 1), (2, "n2", ["t"], 2), (3, "file", ["t"], 3), (4, "same", ["t"], 4), (5, "file", ["u"], 5), (8, "n8", ["t"], 8), (9, "file", ["t"], 9), (20, "fresh", [], 1), (21, "both", ["t"], 1), (22, "both", ["t"], 2)]
    here = [(0, "n0", ["t"], 0), (1, "n1", ["t"], 1), (2, "mine", ["t"], 2), (3, "mine", ["t"], 3), (4, "same", ["t"], 4), (5, "n5", ["t"], 99), (6, "n6", ["t"], 6), (7, "mine", ["t"], 7), (21, "both", ["t"], 1), (22, "mine", None, None), (30, "own", None, None)]
    frames = [spark.createDataFrame(x, ROW) for x in (last, new, here)]
    plan = cut(C.reconciled(*frames), "plan")
    got = {r.key: (r.action, sorted(r.changed), sorted(r.conflicts)) for r in plan.collect()}
    none: list = []
    assert got == {
        0: ("same", none, none), 1: ("updated", ["name"], none), 2: ("same", none, none), 3: ("same", none, ["name"]), 4: ("same", none, none), 5: ("updated", ["name", "tags"], none), 6: ("orphan", none, none), 7: ("orphan", none, none),
        8: ("absent", none, none), 9: ("added", none, none), 10: ("absent", none, none), 11: ("absent", none, none), 20: ("added", none, none), 21: ("same", none, none), 22: ("updated", ["size", "tags"], ["name"]), 30: ("same", none, none),
    }
    after = {r.key: (r.name, r.tags, r.size) for r in C.synced(plan).collect()}
    assert after[1] == ("file", ["t"], 1) and after[2][0] == "mine" and after[3][0] == "mine" and after[5] == ("file", ["u"], 99) and after[9][0] == "file" and after[22] == ("mine", ["t"], 2) and 8 not in after and 6 in after
    pruned = {r.key: r.action for r in C.reconciled(*frames, prune=True).collect()}
    assert pruned[6] == "deleted" and pruned[7] == "orphan" and pruned[30] == "same"


def test_undo_of_a_sync(spark):
    rng = random.Random(3)
    make = lambda: spark.createDataFrame([(k, rng.choice("ab"), [rng.choice("xy")], rng.randrange(2)) for k in range(400) if rng.random() < 0.8], ROW)
    frames = [cut(make(), "f") for _ in range(3)]
    plan = cut(C.reconciled(*frames, prune=True), "plan")
    events, table = C.sync_events(plan, 4), C.synced(plan)
    assert {r.action for r in events.collect()} == {"added", "updated", "deleted"}
    plain = lambda df: sorted((r.key, r.name, tuple(r.tags), r.size) for r in df.collect())
    assert plain(C.undone(table, events)) == plain(frames[2])
    edited = table.withColumn("name", F.when(F.col("key") % 2 == 0, "edited").otherwise(F.col("name")))
    assert all(r[1] == "edited" for r in plain(C.undone(edited, events)) if r[0] in {x.key for x in table.collect()} and r[0] % 2 == 0)
