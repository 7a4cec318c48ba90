"""Filter interactions against a walk of every document through every order."""

import re
from itertools import permutations

import pandas as pd

from larkspur.llm import filter_audit
from larkspur.llm.queries import op13_filter_audit

SF = "/root/testdata/sf0.001"


def failures(docs):
    """The letters that each row fails."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    out = []
    for i, text, _ in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and first[text] < i}
        out.append({k for k, v in fails.items() if v})
    return out


def walked(docs, labels):
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for (i, _, source), failed in zip(docs, failures(docs)):
        for order in permutations("ABCDE"):
            there = True
            for step, name in enumerate(order, 1):
                row = out.setdefault((source or "", "".join(order), step), [0] * 6)
                removed = there and name in failed
                row[2] += name in failed and not there
                row[3] += failed == {name}
                there = there and not removed
                for k, case in ((0, there), (1, removed), (4, removed and i in good), (5, removed and i in toxic)):
                    row[k] += case
    shapley = {}
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + row[1]
    return sorted((*key, *row, shapley[key[0], key[1][key[2] - 1]]) for key, row in out.items())


def check(frame, docs, labels):
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = sorted(map(tuple, frame.select(columns).collect()))
    assert got == walked(docs, labels)
    assert len(got) == 600 * len({s or "" for *_, s in docs})


def test_query(spark):
    docs = [(r.doc_id, r.text, r.source) for r in pd.read_parquet(f"{SF}/documents.parquet").itertuples()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in pd.read_parquet(f"{SF}/labels.parquet").itertuples()]
    check(op13_filter_audit(spark, SF), docs, labels)


def test_odd_rows(spark):
    long = " ".join(f"word{k}" for k in range(60))
    docs = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "Same # text", ""), (5, "Same # text", "a"), (5, "Same # text", "a"), (4, "Same # text", "b"), (None, "Same # text", "b"), (None, "Same # text", "b"), (None, None, "a")]
    docs += [(6, long, "a"), (7, long, "b"), (8, long.upper(), "b"), (9, "x " * 200_000, "c"), (10, "É" * 100 + "ABCDE", "c"), (11, "É" * 95 + "ABCDE", "c"), (12, "café one two", "a")]
    docs += [(100 + k, "copies & copies", "hot") for k in range(40)] + [(99, "copies & copies", "other")]
    labels = [(1, 1, 1), (4, 1, 0), (5, 0, 1), (5, 1, None), (6, None, None), (7, 1, 0), (99, 1, 1), (100, 1, 1), (139, 0, 1), (None, 1, 1), (500, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, source string, part int, mask int, n int")
    marks = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, good int")
    check(filter_audit.audit(frame, marks), docs, labels)
    check(filter_audit.audit(frame, marks.limit(0)), docs, [])
    assert filter_audit.audit(frame.limit(0), marks).count() == 0


def test_lattice():
    assert len(filter_audit.EDGES) == 80
    assert sum(filter_audit.orders_through(applied) for applied, _ in filter_audit.EDGES) == 600
