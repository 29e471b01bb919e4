"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

Toxic documents go; one document of each near-duplicate class stays, the one with the smallest
id; documents that hold a benchmark text go; secrets are replaced in their texts; and the rest
is mixed to source targets, one row a document with the number of its copies.

Defined cases: the stages tell documents apart by their texts, so rows with a null id, or one id
with several texts, are treated like others; rows that repeat a text are one document from the
second stage on; null texts pass all filters and take no words; long texts are read whole; ties
within a class go to the smallest id; other columns, whatever their names, are carried through;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import read_table, remove_folder, shared_folder
from tagloom.llm.decontam import find_leaks
from tagloom.llm.minhash import first_of_classes, text_node
from tagloom.llm.mixing import mix
from tagloom.llm.secrets import redact_secrets
from tagloom.llm.toxicity import THRESHOLD, score_toxicity, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of a model trained on all labelled rows."""
    model = train_toxicity(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, docs.columns, score_col="__score").filter(F.col("__score") < THRESHOLD).drop("__score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class."""
    return first_of_classes(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark text is found, told apart by their texts."""
    named = docs.withColumn("__node", text_node(F.col("text")))
    leaks = find_leaks(named.select("__node", "text"), read_table(spark, sf_dir, "benchmark"), id_col="__node")
    return named.join(leaks.select("__node").distinct(), "__node", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with secrets replaced by a mark."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, and columns size, target, copies and taken (`mix_` before a name that is taken)."""
    mixed = mix(docs, keep=docs.columns).filter("copies > 0")
    new = [F.col(c).alias(c if c not in docs.columns else f"mix_{c}") for c in ("size", "target", "copies", "taken")]
    return mixed.select(*[F.col(f"kept.`{c}`").alias(c) for c in docs.columns], *new)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]

#: Models, signatures and spans can't be written in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove_folder(spark, last)
        last = path
    return docs
