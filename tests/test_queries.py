"""Every catalog query gives the rows, columns and types of its SQL."""

import duckdb
import pandas as pd
import pytest

from larkspur import queries

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    return None if v is None or v != v else str(pd.Timestamp(v)) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sql, name):
    frame = queries.queries()[name](spark, SF)
    found = sql.execute(queries.oracle_sql()[name])
    columns = {c[0]: str(c[1]) for c in found.description}
    assert {c: TYPES[t] for c, t in frame.dtypes} == columns
    order = sorted(columns)
    at = [c[0] for c in found.description]
    want = sorted((tuple(plain(r[at.index(c)]) for c in order) for r in found.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in order) for r in frame.collect()), key=str)
    assert got == want


def test_queries_without_sql_run(spark):
    for name in set(queries.queries()) - set(queries.oracle_sql()):
        assert queries.queries()[name](spark, SF).count() > 0, name
