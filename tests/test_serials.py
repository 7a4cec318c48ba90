"""Serials between listings, against the rules applied one by one."""

import random
from itertools import pairwise

from larkspur.operators import serials

EVIDENCE = "model string, prefix string, number long, first int, last int, item long"


def plainly(points, evidence, slack=1, least=5, backward=0.1, years=2):
    out = {}
    for key in {e[:2] for e in evidence}:
        known = sorted(e[2:] for e in evidence if e[:2] == key)
        kept = []
        for k, e in enumerate(known):
            before, after = known[k - 1] if k else None, known[k + 1] if k + 1 < len(known) else None
            if not (before and after and before[1] <= after[2] and not before[1] - slack <= e[1] <= after[2] + slack):
                kept.append(e)
        if len(kept) < least or sum(b[2] < a[1] for a, b in pairwise(kept)) > backward * (len(kept) - 1):
            continue
        for model, prefix, point, low, high in points:
            if (model, prefix) != key:
                continue
            below, above = [e for e in kept if e[0] <= low], [e for e in kept if e[0] >= high]
            if not below or not above:
                continue
            b, a = max(below, key=lambda e: e[:2]), min(above, key=lambda e: (e[0], -e[2]))
            first, last = min(b[1], a[1]), max(b[2], a[2])
            if b[1] <= a[2] and last - first <= years:
                out[model, prefix, point] = (first, last, b[0], a[0])
    return out


def check(spark, points, evidence, cell=100, **rules):
    frames = spark.createDataFrame(points, "model string, prefix string, point long, low long, high long"), spark.createDataFrame(evidence, EVIDENCE)
    got = {(r.model, r.prefix, r.point): (r.first, r.last, r.below, r.above) for r in serials.placed(*frames, ["model", "prefix"], cell=cell, **rules).collect()}
    assert got == plainly(points, evidence, **rules)
    return got


def test_places_against_plain_rules(spark):
    rng = random.Random(4)
    evidence, points = [], []
    for model in "abcd":
        for k in range(60):
            year = 1900 + k // 3 + rng.choice([0, 0, 0, 1, 9 if model == "b" else 0, -30 if rng.random() < 0.1 else 0])
            evidence.append((model, rng.choice(["", "X"]), rng.randrange(k * 20, k * 20 + 40), year, year + rng.choice([0, 0, 1]), len(evidence)))
        for k in range(40):
            low = rng.randrange(1300)
            points.append((model, rng.choice(["", "X"]), len(points), low, low + rng.choice([0, 0, 9, 99])))
    assert len(check(spark, points, evidence)) > 30
    check(spark, points, evidence, cell=7, slack=0, years=5, backward=0.3)


def test_neighbours_that_run_backward_contradict_nobody(spark):
    rows = [("m", "", n, y, y, n) for n, y in ((1, 1950), (2, 1990), (3, 1930))]
    kept = serials.steady(spark.createDataFrame(rows, EVIDENCE), ["model", "prefix"], cell=2)
    assert sorted(r.number for r in kept.collect()) == [1, 2, 3]
    rows[2] = ("m", "", 3, 1952, 1952, 3)
    assert sorted(r.number for r in serials.steady(spark.createDataFrame(rows, EVIDENCE), ["model", "prefix"], cell=2).collect()) == [1, 3]


def test_odd_rows(spark):
    evidence = [("m", "", 10 * k, 1900 + k, 1900 + k, k) for k in range(8)] + [("m", None, 5, 1900, 1900, 90), ("m", "", None, 1900, 1900, 91), ("n", "", 10, 1900, 1900, 92), ("m", "", 30, 1903, 1904, 93)]
    points = [("m", "", 1, 30, 30), ("m", "", 2, 31, 38), ("m", "", 3, 30, 49), ("m", "", 4, 71, 71), ("m", None, 5, 5, 5), ("n", "", 6, 10, 10), ("o", "", 7, 1, 1)]
    got = check(spark, points, [e for e in evidence if None not in e])
    frames = spark.createDataFrame(points, "model string, prefix string, point long, low long, high long"), spark.createDataFrame(evidence, EVIDENCE)
    assert {r.point for r in serials.placed(*frames, ["model", "prefix"], cell=100).collect()} == {p for _, _, p in got} == {1, 2, 3}
    assert serials.placed(frames[0], frames[1].limit(0), ["model", "prefix"]).count() == 0
