"""Readers of raw HTML: Parquet tables, folders of files as bytes or text; and the writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with whatever columns it has; only those used are read."""
    return spark.read.parquet(path)


def from_files(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """url, content (BINARY): one row a file; encodings are found when it is parsed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("url"), "content")


def from_text(spark: SparkSession, path: str) -> DataFrame:
    """url, html (STRING): one row a file that is known to be UTF-8."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def write_html(serialized: DataFrame, path: str) -> None:
    """doc_id and html as Parquet."""
    serialized.select("doc_id", "html").write.mode("overwrite").parquet(path)
