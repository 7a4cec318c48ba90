"""Bucketed state and page layout."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from larkspur.operators import layout
from larkspur.operators.state import merge
from larkspur.operators.stored import StateTable, shuffles_of

KNOWN = "item long, title string, price double, previous_price double, sold boolean, active boolean, first_seen timestamp_ntz, last_seen timestamp_ntz, sold_at timestamp_ntz, restocked_at timestamp_ntz, price_changed_at timestamp_ntz"


def test_state_is_met_where_it_lies(spark, tmp_path):
    at = datetime(2024, 1, 1)
    known = spark.createDataFrame([(k, f"t{k}", float(k), None, k % 3 == 0, k % 4 != 0, at, at, None, None, None) for k in range(200)], KNOWN)
    days = [spark.createDataFrame([(k, None if k % 2 else f"n{k}", float(k + d), k % 5 == 0) for k in range(150 * d, 150 * d + 120)], "item long, title string, price double, sold boolean") for d in (0, 1)]
    table = StateTable(spark, "state_test", "item", 4)
    table.write(known.withColumn("change", F.lit("new")))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plain = known
        for k, day in enumerate(days):
            now = datetime(2024, 1, 2 + k)
            plan = table.merged(day, now)
            assert not shuffles_of(plan, {"item", "first_seen"}) and shuffles_of(plan, {"item"})
            assert not shuffles_of(table.lookup(day, ["first_seen"]), {"first_seen"})
            plain = merge(plain, day, "item", now)
            table.apply(day, now)
            assert sorted(map(str, table.read().collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith("state_test_g")]
    assert sorted(names) == ["state_test_g2", "state_test_g3"]
    for n in names:
        spark.sql(f"DROP TABLE {n}")


def by_hand(boxes, gap_x, gap_y):
    """Panels by cutting one region after the other."""
    out = {}

    def parts(region, low, high, gap):
        region = sorted(region, key=lambda b: (b[low], b[high], b[0]))
        groups, reach = [[region[0]]], region[0][high]
        for b in region[1:]:
            if b[low] - reach >= gap:
                groups.append([])
            groups[-1].append(b)
            reach = max(reach, b[high])
        return groups

    def cut(region, path):
        for i, row in enumerate(parts(region, 2, 4, gap_y)):
            columns = parts(row, 1, 3, gap_x)
            for j, column in enumerate(columns):
                own = [*path, i, j] if len(columns) > 1 else [*path, i]
                if len(columns) > 1:
                    cut(column, own)
                else:
                    out.update({b[0]: ".".join(f"{n:04d}" for n in own) for b in column})

    cut(boxes, [])
    return out


def test_panels_against_cutting_by_hand(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for page in range(12):
        own = []
        for k in range(rng.choice([1, 5, 30, 60])):
            x, y = rng.randrange(0, 100, rng.choice([1, 10])), rng.randrange(0, 100, rng.choice([1, 10]))
            own.append((k, x, y, x + rng.choice([0, 3, 8, 30]), y + rng.choice([0, 2, 6])))
        want |= {(page, k): p for k, p in by_hand(own, 3, 2).items()}
        rows += [(page, k, x1 if k % 2 else x0, y0, x0 if k % 2 else x1, y1) for k, x0, y0, x1, y1 in own]
    rows.append((99, 1, None, 0, 0, 0))
    frame = spark.createDataFrame([(p, b, *[None if v is None else float(v) for v in xs]) for p, b, *xs in rows], "page long, box long, x0 double, y0 double, x1 double, y1 double")
    got = {(r.page, r.box): r.panel for r in layout.panels(frame, 3, 2).collect()}
    assert got == {**want, (99, 1): None} and max(p.count(".") for p in want.values()) >= 4
    assert layout.panels(frame.limit(0), 3, 2).count() == 0


def test_boxes_come_under_headings(spark):
    rows = [(1, 1, 0, 0, 10, 2, True), (1, 2, 12, 0, 20, 2, True), (1, 3, 1, 3, 9, 4, False), (1, 4, 8, 5, 19, 6, False), (1, 5, 0, 7, 10, 8, True), (1, 6, 2, 9, 4, 9, False), (1, 7, 30, 0, 31, 1, False)]
    frame = spark.createDataFrame([(p, b, *map(float, xs), h, "p") for p, b, *xs, h in rows], "page long, box long, x0 double, y0 double, x1 double, y1 double, heading boolean, panel string")
    assert {r.box: r.under for r in layout.headed(frame, "heading").collect()} == {3: 1, 4: 2, 6: 5, 7: None}
    assert {r.box: r.line for r in layout.lines(frame).collect()} == {1: 1, 2: 1, 7: 1, 3: 2, 4: 3, 5: 4, 6: 5}


def test_only_boxes_under_a_heading_are_made_for_the_page(spark):
    rows = [(1, 1, 0.0, 0.0, 9.0, 1.0, "a", True), (1, 2, 0.0, 2.0, 9.0, 3.0, "a", False), (1, 3, 20.0, 2.0, 29.0, 3.0, "a", False), (1, 4, 0.0, 2.0, 9.0, 3.0, None, False)]
    frame = spark.createDataFrame(rows, "page long, box long, x0 double, y0 double, x1 double, y1 double, panel string, heading boolean")
    assert [tuple(r) for r in layout.heading_above(frame, "heading").collect()] == [(1, 2, 1)]
    assert sorted(map(tuple, layout.headed(frame, "heading").collect())) == [(1, 2, 1), (1, 3, None)]
