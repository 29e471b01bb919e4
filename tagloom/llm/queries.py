"""One query an operator, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm.common import read_table


def op1_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.decontam import leaks_report

    return leaks_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.secrets import secrets_report

    return secrets_report(read_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.language import language_report

    return language_report(read_table(spark, sf_dir, "documents"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.mixing import mix

    mixed = mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.quality import quality_report

    return quality_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.chat import chat_report

    return chat_report(read_table(spark, sf_dir, "conversations"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.fingerprint import fingerprint_report

    return fingerprint_report(read_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.toxicity import toxicity_report

    return toxicity_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.hmm import lm_report

    return lm_report(read_table(spark, sf_dir, "documents"))


def op3_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.llm.minhash import dedup_report

    return dedup_report(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_leaks, op2_secrets, op3_dedup, op4_language, op5_mix, op6_quality, op7_chat, op8_fingerprint, op9_toxicity, op10_hmm)}
SQL: dict[str, str] = {}
