"""From raw documents to a training mix: language, near-duplicates, benchmark passages, personal data, sources.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept and returns the columns of
``documents``; the last adds ``copies`` and ``taken``. Stages handle null texts, ids and sources, empty tables
and further columns as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, language, mixing, neardup, pii
from tidemark.llm.common import saved, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts in some language; ``lang`` becomes the identified one. Texts without a letter go."""
    return language.keep_known(docs, language.fit(language.training_rows(docs)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return neardup.keep_one(docs)


def free_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return decontaminate.without_passages(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; all documents stay."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents so that sources come to their target weights."""
    return mixing.mixed_rows(docs)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", free_of_benchmark),
    ("personal_data", redacted),
    ("mixing", mixed),
]

#: Byte contexts, weighted samples and balanced draws have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
