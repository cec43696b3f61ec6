"""The dirty text fields as one table of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.core import table

#: field: (table, key, text column)
FIELDS = {"Link.text": ("page_links", "link_id", "text"), "Image.alt": ("page_images", "image_id", "alt"), "Meta.title": ("page_meta", "meta_id", "title"), "Meta.description": ("page_meta", "meta_id", "description")}


def records(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """``(field, rec_id, page_id, text)`` of the fields named, every stored row."""
    out = None
    for name in fields:
        source, key, column = FIELDS[name]
        part = table(spark, sf_dir, source).select(F.lit(name).alias("field"), F.col(key).alias("rec_id"), "page_id", F.col(column).alias("text"))
        out = part if out is None else out.unionByName(part)
    return out
