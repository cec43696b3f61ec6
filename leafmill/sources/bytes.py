"""Pages delivered as bytes: which encoding they are in, and their text.

The order is byte order mark, then the encoding given (an option, else the one of the content type), then the one that
the first 1024 bytes name in a meta element, then UTF-8; a label that is not known counts as none.
"""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def bom_encoding(body: Column) -> Column:
    return F.when(F.substring(body, 1, 3) == F.lit(b"\xef\xbb\xbf"), "utf-8").when(F.substring(body, 1, 2) == F.lit(b"\xfe\xff"), "utf-16be").when(F.substring(body, 1, 2) == F.lit(b"\xff\xfe"), "utf-16le")


def header_charset(content_type: Column) -> Column:
    return F.nullif(F.regexp_extract(content_type, "(?i)charset\\s*=\\s*[\"']?([^\"';\\s]+)", 1), F.lit(""))


def meta_charset(body: Column) -> Column:
    """The encoding that a meta element at the start names; two-byte ones are taken for UTF-8."""
    start = F.regexp_replace(F.decode(F.substring(body, 1, 1024), "ISO-8859-1"), "(?s)<!--.*?-->", "")
    label = F.lower(F.regexp_extract(start, "(?i)<meta[^>]*?charset\\s*=\\s*[\"']?\\s*([^\"'>\\s/;]+)", 1))
    return F.when(label == "", None).when(label.startswith("utf-16"), "utf-8").when(label == "x-user-defined", "windows-1252").otherwise(label)


def known_label(label: str | None) -> str | None:
    """The codec that browsers use for a label."""
    if not label:
        return None
    name = label.strip().lower()
    if name in ("iso-8859-1", "latin1", "latin-1", "ascii", "us-ascii", "l1", "cp819", "iso8859-1", "iso_8859-1", "windows-1252", "cp1252", "x-cp1252"):
        return "cp1252"
    name = {"utf8": "utf-8", "unicode-1-1-utf-8": "utf-8", "utf-16": "utf-16le", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "gb2312": "gbk", "ks_c_5601-1987": "cp949", "iso-8859-9": "cp1254"}.get(name, name)
    try:
        return codecs.lookup(name).name
    except LookupError:
        return None


#: What the bytes from 0x80 to 0x9F mean; the five that mean nothing stay as they are.
CP1252 = {b: bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)}


def decode_one(body: bytes | None, declared: str | None, bom: str | None, meta: str | None) -> str:
    """The text of a page; wrong bytes become replacement characters, a byte order mark is dropped."""
    raw = bytes(body or b"")
    codec = known_label(bom) or known_label(declared) or known_label(meta) or "utf-8"
    text = raw.decode("latin-1").translate(CP1252) if codec == "cp1252" else raw.decode(codec, "replace")
    return text.removeprefix("\ufeff")


def decode_pages(pages: DataFrame, encoding: str | None = None) -> DataFrame:
    """``(page_id, url, html)`` of ``pages(page_id, url, body, content_type)``; ``encoding`` replaces the content type's."""

    @F.pandas_udf(StringType())
    def text(body: pd.Series, declared: pd.Series, bom: pd.Series, meta: pd.Series) -> pd.Series:
        return pd.Series([decode_one(*row) for row in zip(body, declared, bom, meta, strict=True)], dtype=object)

    declared = F.lit(encoding) if encoding else header_charset(F.col("content_type"))
    return pages.select("page_id", "url", text("body", declared.cast("string"), bom_encoding(F.col("body")), meta_charset(F.col("body"))).alias("html"))


def join_chunks(chunks: DataFrame) -> DataFrame:
    """Whole bodies of ``chunks(page_id, url, chunk_seq, chunk)``, whatever their sizes and order of arrival.

    A chunk delivered twice counts once.
    """
    once = chunks.dropDuplicates(["page_id", "chunk_seq"])
    parts = F.array_sort(F.collect_list(F.struct("chunk_seq", F.hex("chunk").alias("h"))))
    whole = once.groupBy("page_id").agg(F.first("url").alias("url"), F.unhex(F.array_join(F.transform(parts, lambda p: p["h"]), "")).alias("body"))
    return whole.withColumn("content_type", F.lit(None).cast("string"))
