"""Recorded pages: what is written comes back, lazily and pruned."""

import json
import os

import pytest
from pyspark.sql import functions as F

from larkspur.sources import recorded


@pytest.fixture
def folder(spark, tmp_path):
    recorded.register(spark)
    pages = spark.range(100).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.concat(F.lit("<p>é\n"), "id").alias("html"))
    path = str(tmp_path / "rec")
    pages.repartitionByRange(5, "page_id").write.format("recorded_pages").mode("append").save(f"file://{path}")
    return path


def read(spark, folder):
    return spark.read.format("recorded_pages").load(folder)


def test_round_trip(spark, folder):
    rows = sorted(map(tuple, read(spark, folder).collect()))
    assert rows == [(k, f"u{k}", f"<p>é\n{k}") for k in range(100)]


@pytest.mark.parametrize("where, files", [("page_id between 21 and 39", 1), ("page_id >= 80", 1), ("page_id in (3, 99)", 2), ("page_id = 50", 1), ("page_id < 20 and page_id > 5", 1), ("page_id > 500", 0), ("url = 'u7'", 5), ("page_id = 7 or url = 'u9'", 5), ("page_id in (1, 2) and page_id >= 2", 1)])
def test_filters_reach_the_files(spark, folder, where, files):
    frame = read(spark, folder).where(where)
    assert sorted(r.page_id for r in frame.collect()) == sorted(r.id for r in spark.range(100).select(F.col("id"), F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url")).where(where).collect())
    assert frame.rdd.getNumPartitions() == files or files == 0


def test_plan_names_the_filter(spark, folder, capsys):
    read(spark, folder).where("page_id >= 80").explain("formatted")
    assert "PushedFilters" in (plan := capsys.readouterr().out) and "page_id" in plan.split("PushedFilters")[1][:200]


def test_failed_writes_leave_nothing(spark, folder):
    bad = spark.range(10).select(F.col("id").alias("page_id"), F.when(F.col("id") == 9, F.raise_error(F.lit("no"))).otherwise("u").alias("url"), F.lit("h").alias("html"))
    before = sorted(os.listdir(folder))
    with pytest.raises(Exception):
        bad.repartition(3).write.format("recorded_pages").mode("append").save(folder)
    assert [n for n in sorted(os.listdir(folder)) if n.startswith("manifest")] == [n for n in before if n.startswith("manifest")] and read(spark, folder).count() == 100


def test_append_overwrite_nulls_and_empty(spark, folder):
    odd = spark.createDataFrame([(None, None, None), (7, "", "x")], "page_id long, url string, html string")
    odd.write.format("recorded_pages").mode("append").save(folder)
    assert read(spark, folder).count() == 102 and read(spark, folder).where("page_id = 7").count() == 2 and read(spark, folder).where("page_id is null").count() == 1
    odd.limit(0).write.format("recorded_pages").mode("append").save(folder)
    odd.write.format("recorded_pages").mode("overwrite").save(folder)
    assert read(spark, folder).count() == 2
    assert all(isinstance(json.load(open(f"{folder}/{n}")), list) for n in os.listdir(folder) if n.startswith("manifest"))
    with pytest.raises(Exception):
        odd.drop("html").write.format("recorded_pages").mode("append").save(folder)
    with pytest.raises(ValueError):
        recorded._local("s3://bucket/x")
