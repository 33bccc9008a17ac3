"""The queries of the corpus operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glosswright.llm import bpe, chat, decontaminate, exact_dedup, license_scan, ngram_join, quality, secrets, toxicity, url_filter
from glosswright.llm._common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(chat.with_probe(table(spark, sf_dir, "conversations")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"), n=3, percent=90)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_chat_format,
        op2_quality,
        op3_secret_scan,
        op4_ngram_jaccard,
        op5_exact_dedup,
        op6_toxicity,
        op7_license_scan,
        op8_decontaminate,
        op9_url_filter,
        op10_byte_bpe,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat.ORACLE_SQL,
        "op4_ngram_jaccard": ngram_join.ORACLE_SQL,
        "op5_exact_dedup": exact_dedup.ORACLE_SQL,
        "op8_decontaminate": decontaminate.ORACLE_SQL,
        "op9_url_filter": url_filter.ORACLE_SQL,
    }
