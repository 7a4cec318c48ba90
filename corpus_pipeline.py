"""The corpus pipeline: each stage works on all that the one before it kept, and its decisions take effect."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontamination, repeats, simhash, toxicity
from larkspur.llm.queries import bpe_digests, table, toxicity_model
from larkspur.llm.shared import new_path


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named c0, c1, ..., like none that an operator adds; and the new names by the old ones."""
    own = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*own.values()), own


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; a null or empty text stays; each row of a repeated doc_id is decided on its own text."""
    rows, own = numbered(docs)
    scored = toxicity.score(rows, toxicity_model(spark, sf_dir), own["text"])
    return scored.where("toxicity < 0.5").select(*rows.columns).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (shingles of five words, similarity 0.8).

    A row that repeats stays once; rows of one doc_id with different texts are decided each on its own; a null doc_id stays.
    """
    return simhash.keep_one(docs)


#: Words of a passage that is cut out where it repeats.
PASSAGE_WORDS = 50


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_WORDS words or more that are elsewhere too, A-Z in lower case, are cut out with the white space in and after them.

    A null text stays null; a document of which nothing is left stays with an empty text; each row of a repeated doc_id is decided on its own text.
    """
    rows, own = numbered(docs)
    out = repeats.remove_repeats(rows, PASSAGE_WORDS, own["text"], own["doc_id"], repeats.WORD)
    made = {"text": F.when(F.col(own["text"]).isNotNull(), F.col("kept_text"))}
    if "n_chars" in own:
        made["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(own["n_chars"]))
    return out.select(*[made.get(name, F.col(c)).alias(name) for name, c in own.items()])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item in them go; a null or empty text stays; each row of a repeated doc_id is decided on its own text."""
    rows, own = numbered(docs)
    return decontamination.clean(rows, table(spark, sf_dir, "benchmark"), text=own["text"]).toDF(*docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, and digests of the ids and of what they decode to; a null text is the empty one, and a repeated doc_id has as many rows."""
    return bpe_digests(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near-duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("decontamination", decontamination_stage),
    ("tokens", tokens_stage),
]

#: No stage but the last could be written in SQL; the run is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
