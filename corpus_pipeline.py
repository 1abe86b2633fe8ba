"""A corpus pipeline of five stages over ``documents``.

Documents in no known language go; one document of each near-duplicate group
stays; documents that hold benchmark items go; secrets are redacted; every
document left gets its domain posteriors and the rate at which to draw it so
that the mixture meets its targets. All stages but the last return the columns
of ``documents``. The stages train models and compare signatures, which SQL
can't express, so there is no ORACLE_SQL; tests hold run() against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graingrid.llm import op03_decontaminate, op06_langid, op07_mixing, op09_secrets, op10_simhash
from graingrid.llm.durable import discard, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose text is in one of the languages the table itself is labelled with."""
    return op06_langid.keep_known(docs, op06_langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each near-duplicate group, and all outside of groups."""
    return op10_simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without overlaps with benchmark items."""
    return op03_decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, credentials in their texts redacted."""
    return op09_secrets.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with domain posteriors, rate and copies."""
    return op07_mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("mixing", mixing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written to the shared folder and read by the next; what has been read is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out = written(out)
            discard(docs)
        docs = out
    return docs
