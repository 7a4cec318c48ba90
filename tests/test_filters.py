"""One filter description: reading, writing, clauses, pages; facets against repeated filtering."""

import pytest
from pyspark.sql import functions as F

from larkspur.plans import facets
from larkspur.plans.filters import BadQuery, FilterSpec, page, search_terms, search_with_dimension

ROWS = [("i1", "Red Ring 50% off", "a", 10.0, True, False, None), ("i2", "red_ring a_b", "b", None, True, True, None), ("i3", "Blue S&W .303", None, 12.0, False, False, 1), ("i4", "blue ring", "", 10.04, True, False, 0), ("i5", None, "a", 9.9, True, False, 1)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "item string, title string, kind string, price double, active boolean, sold boolean, new int").withColumns({"first_seen": F.lit("2024-01-01").cast("timestamp"), "sold_at": F.lit(None).cast("timestamp"), "delisted_at": F.lit(None).cast("timestamp")})


def items(rows, query, **how):
    return sorted(r.item for r in rows.where(FilterSpec.from_query_string(query).predicate(**how)).collect())


def test_terms():
    assert search_terms('red "blue ring" x of red') == ["blue ring", "red", "of"]
    assert search_terms(" ".join(f"w{i}" for i in range(12))) == [f"w{i}" for i in range(8)]
    assert search_terms("") == search_terms(None) == []


def test_query_strings():
    spec = FilterSpec.from_query_string("?kind=b&kind=a&q=red+ring&not_brand=x&min_price=1.5&page=3&is_new=true&status=sold&hours=24&sort=title")
    assert spec.one_of == {"kind": ("b", "a")} and spec.at_least == {"price": 1.5} and spec.flags == {"new": True}
    text = spec.to_query_string()
    assert text == "hours=24&is_new=true&kind=a&kind=b&min_price=1.5&not_brand=x&q=red+ring&sort=title&status=sold"
    assert FilterSpec.from_query_string(text).to_query_string() == text
    for bad in ("min_price=x", "is_new=maybe", "sort=sideways", "status=lost", "hours=soon"):
        with pytest.raises(BadQuery):
            FilterSpec.from_query_string(bad)


def test_clauses(rows):
    assert items(rows, "q=ring") == ["i1", "i2", "i4"]
    assert items(rows, "q=50%25") == ["i1"] and items(rows, "q=a_b") == ["i2"] and items(rows, "q=s%26w+.303") == ["i3"]
    assert items(rows, "kind=a") == ["i1", "i5"] and items(rows, "kind=a&kind=Unknown") == ["i1", "i3", "i4", "i5"]
    assert items(rows, "not_kind=a") == ["i2", "i3", "i4"] and items(rows, "not_kind=a&not_kind=Unknown") == ["i2"]
    assert items(rows, "min_price=10&max_price=10") == ["i1", "i4"] and items(rows, "max_price=10") == ["i1", "i5"]
    assert items(rows, "status=available&kind=Unknown") == ["i4"] and items(rows, "status=left") == []
    assert items(rows, "") == ["i1", "i2", "i3", "i4", "i5"]
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    assert items(rows, "hours=24", now=now) == items(rows, "") and items(rows, "hours=6", now=now) == []


def test_pages(rows):
    got = [r.item for r in page(rows, FilterSpec.from_query_string("sort=price_desc"), 1, 10).collect()]
    assert got == ["i3", "i4", "i1", "i5", "i2"]
    assert [r.item for r in page(rows, FilterSpec(sort="price_asc"), 2, 2).collect()] == ["i4", "i3"]


def test_facets_equal_one_filter_each(rows):
    spec = FilterSpec.from_query_string("kind=a&kind=Unknown&status=available&max_price=11")
    got = {(r.facet, r.value): r.n for r in facets.exclusive(rows, spec.clauses(), ["kind", "new"]).collect()}
    want = {}
    for facet in ("kind", "new"):
        for r in facets.tally(rows.where(spec.predicate(drop=facet)), facet).collect():
            want[facet, r.value] = r.n
    assert got == want


def test_tally_keeps_chosen_values(spark):
    df = spark.createDataFrame([(v,) for v in ["a"] * 3 + ["b"] * 2 + ["c", None, ""]], "v string")
    assert {tuple(r) for r in facets.tally(df, "v", 1, ["c"]).collect()} == {("a", 3), ("c", 1), ("Unknown", 2)}


def test_histogram_edges(spark):
    one = spark.createDataFrame([(5.0,), (5.0,), (0.0,), (None,)], "price double")
    assert {tuple(r) for r in facets.price_histogram(one).collect()} == {(0, 2)}
    many = spark.createDataFrame([(float(2**k),) for k in range(25)], "price double")
    got = {r.bucket: r.n for r in facets.price_histogram(many).collect()}
    assert sum(got.values()) == 25 and min(got) == 0 and max(got) == 23


def test_names_of_dimensions(spark, rows):
    dims = spark.createDataFrame([("a", "Carbine alias"), ("b", "other")], "kind string, name string")
    got = search_with_dimension(rows, "red carbine", ("title",), dims, "kind", ("name",))
    assert [r.item for r in got.collect()] == ["i1"] and got.columns[0] == "kind"
