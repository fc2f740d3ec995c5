"""A corpus pipeline in stages, each of which works on the documents that the one before wrote.

Every stage decides row by row, by the row's own text: rows that repeat a ``doc_id`` with another text are
documents of their own.  Columns other than ``doc_id``, ``text``, ``source`` and ``n_chars`` pass through
untouched, whatever their names.  Empty tables of documents, labels or items give what the operators'
docstrings say, and very long texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mergewell.llm import decontaminate, mixing, near_dup, quality, secret_scan
from mergewell.workspace import fresh_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts are scored like any other; without labels all stay."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id stays; rows without words or id all stay."""
    return near_dup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its secrets masked and ``n_chars`` counted again; null texts stay null."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, numbered by ``copy``; a column of that name is replaced."""
    return mixing.sample(docs)


STAGES = [
    ("quality", good_quality),
    ("near_dup", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("secrets", without_secrets),
    ("mix", mixed),
]
#: The stages include a trained model and signatures, so a brute-force version in the tests stands in for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
