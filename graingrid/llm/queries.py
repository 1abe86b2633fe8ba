"""The corpus operators' queries, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import op01_warc, op02_lm, op03_decontaminate, op04_urls, op05_pq, op06_langid, op07_mixing, op08_suffix, op09_secrets
from . import op10_simhash as simhash


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_warc.query(_read(spark, sf_dir, "pages"))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return op02_lm.score(docs, *op02_lm.train(docs))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return op04_urls.score(pages, op04_urls.weak_labels(pages, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")))


def op5_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_pq.classes(_read(spark, sf_dir, "embeddings"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return op06_langid.identify(docs, op06_langid.train(docs))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = op07_mixing.mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "n_tokens", "p_high", "p_low", "p_toxic", "rate", "copies")


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_suffix.passages(_read(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_secrets.scan(_read(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_lm": op2_lm,
        "op3_decontaminate": op3_decontaminate,
        "op4_urls": op4_urls,
        "op5_pq": op5_pq,
        "op6_langid": op6_langid,
        "op7_mixing": op7_mixing,
        "op8_suffix": op8_suffix,
        "op9_secrets": op9_secrets,
        "op10_simhash": op10_simhash,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": op01_warc.ORACLE_SQL, "op5_pq": op05_pq.ORACLE_SQL, "op8_suffix": op08_suffix.ORACLE_SQL}
