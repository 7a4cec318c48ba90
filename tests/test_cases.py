"""Every listed case of the readers and the classifier."""

import pytest

from larkspur import queries, reading_queries

queries.queries()


@pytest.mark.parametrize("name", sorted(reading_queries.CASES))
def test_listed_cases(spark, name):
    takes, listed, read, prepare, answers = reading_queries.CASES[name]
    n = len(takes.split(","))
    rows = prepare(spark.createDataFrame([(k, *row[:n]) for k, row in enumerate(listed)], f"_k int, {takes}"))
    got = rows.select("_k", *[c.alias(a) for a, c in read(rows).items()]).orderBy("_k").collect()
    assert [tuple(r)[1:] for r in got] == [tuple(row[n:]) for row in listed]
