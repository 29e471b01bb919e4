"""Parsing of streams: the kernel has no state between rows, so its column works on streams as it is."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagloom.operators.parse import nodes, tokens
from tagloom.operators.serialize import Options, serialize, serialize_html


def read_pages(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files that appear in a folder (page_id, url, html)."""
    return spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stream_nodes(pages: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Appends the nodes of each page to a Parquet folder."""
    return nodes(pages, "page_id", "html").writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_serialized(pages: DataFrame, sink: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Appends doc_id, html and problems of each page to a Parquet folder; a page's markup needs no other row."""
    out = pages.select(F.col("page_id").alias("doc_id"), serialize_html("html", options).alias("out")).select("doc_id", "out.html", "out.problems")
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_filtered(pages: DataFrame, sink: str, checkpoint: str, options: Options = Options(), extra: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> StreamingQuery:
    """Serializes each page by way of its token stream, with filters of the caller's own.

    The filters' windows need whole batches, so each batch is one job; a batch that is run again
    after a failure overwrites its own folder, `batch=number`, and no other.
    """

    def write(batch: DataFrame, number: int) -> None:
        serialize(tokens(nodes(batch, "page_id", "html")), options, extra=extra).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
