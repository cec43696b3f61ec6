"""Facets of pages that arrive as a stream.

The tokenizer and all row-local facets work on streaming tables as they are. Facets that put a page together (texts of
links, counts) need the whole page at once: ``process_batches`` runs them on every micro-batch, as a page is one row and
so never divided between batches. Late and repeated deliveries are dropped by a watermark on the fetch time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.operators import facets
from leafmill.operators.tokenizer import TEXT, tokenize


def read_pages(spark: SparkSession, folder: str, schema: str = "page_id bigint, site_id bigint, url string, html string, fetched_at timestamp, loaded_at timestamp") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def once(pages: DataFrame, delay: str = "30 days") -> DataFrame:
    """Every fetch of a page once, deliveries later than ``delay`` behind the newest fetch left out of the memory."""
    return pages.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["page_id", "fetched_at"])


def element_counts(pages: DataFrame) -> DataFrame:
    """How many elements of each tag, updated as pages arrive."""
    return tokenize(pages).where(F.col("kind") != TEXT).where("kind = 0").groupBy("tag").agg(F.count("*").alias("n"))


def process_batches(pages: DataFrame, facet: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Write ``facet(tokens)`` of every micro-batch below ``out``, one folder a batch, so that a repeated batch overwrites."""

    def write(batch: DataFrame, number: int) -> None:
        facet(tokenize(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def link_stream(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return process_batches(pages, facets.links, out, checkpoint)
