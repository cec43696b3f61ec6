"""The pN_ queries of the training-data problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.core import FEW_ROWS, materialize, table

from leafmill.llm import fields, heavy, leakage, mojibake, packing, residue, skeleton, subjects


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy.heavy_values(heavy.web_values(spark, sf_dir)).select("field", "item_value")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy.heavy_values(heavy.web_values(spark, sf_dir)).select("field", "item_value", "item_count", "field_total")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = fields.records(spark, sf_dir, "Link.text", "Image.alt", "Meta.title")
    mixed = materialize(skeleton.ambiguous(records).dropDuplicates(["field", "rec_id", "text"]), "p2-mixed")
    garbled = mojibake.detect(mixed, mojibake.fit(mojibake.distinct_texts(records))).select("field", "rec_id")
    return skeleton.lookalike_pairs(mixed.join(garbled, ["field", "rec_id"], "left_anti"))


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form that stands for more than one stored text of a field, with how many texts and records it stands for."""
    formed = skeleton.with_skeleton(fields.records(spark, sf_dir, "Link.text", "Image.alt", "Meta.title"))
    texts = formed.groupBy("field", "skeleton", "text").agg(F.count("*").alias("n"))
    return texts.groupBy("field", "skeleton").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n_rows")).where("n_texts > 1")


def _mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = fields.records(spark, sf_dir, "Link.text", "Meta.title", "Meta.description")
    return materialize(residue.mine(records, residue.site_names(table(spark, sf_dir, "sites"))), "p3-mined")


def _residue(mined: DataFrame) -> DataFrame:
    grown = materialize(residue.grow(mined), "p3-grown")
    return residue.residue(mined, residue.judge(grown, residue.templates(grown)))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residue(_mined(spark, sf_dir)).select("field", "rec_id")


def p3_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.templates(materialize(residue.grow(_mined(spark, sf_dir)), "p3-grown"))


def p3_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that are left when residue is excluded, by field."""
    mined = _mined(spark, sf_dir)
    kept = mined.join(_residue(mined), ["field", "rec_id"], "left_anti")
    return kept.select("field", "rec_id").distinct().groupBy("field").agg(F.count("*").alias("n_records"))


def _garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled(fields.records(spark, sf_dir, "Link.text", "Image.alt", "Meta.title"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir).select("field", "rec_id").distinct()


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir).select("field", "rec_id", "text", "restored")


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every notebook, or piece of one, in a container of each capacity."""
    lengths = materialize(packing.with_tokens(table(spark, sf_dir, "documents")), "p6-lengths", FEW_ROWS)
    sizes = table(spark, sf_dir, "pack_sizes").orderBy("pack_id").collect()  # a handful by definition
    return packing.pack(lengths, [(r.pack_id, r.capacity) for r in sizes])


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each capacity the number of containers and the share of their room that is used."""
    packed = p6_pack(spark, sf_dir).groupBy("pack_id").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    sizes = table(spark, sf_dir, "pack_sizes").select("pack_id", "capacity")
    return packed.join(sizes, "pack_id").select("pack_id", "capacity", "n_containers", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("filled"))


def p6_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each capacity whether every notebook is placed, no container is too full, every text that fits is whole, and how
    many containers there are is within two in a hundred of the least."""
    packed = materialize(p6_pack(spark, sf_dir), "p6-packed")
    sizes = table(spark, sf_dir, "pack_sizes").select("pack_id", "capacity")
    full = packed.groupBy("pack_id", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("pack_id").agg(F.max("n").alias("fullest"), F.count_if(F.col("n") > 0).alias("containers"), F.sum("n").alias("tokens"))
    texts = packed.groupBy("pack_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n")).join(F.broadcast(sizes), "pack_id")
    whole = texts.groupBy("pack_id").agg(F.count("*").alias("n_documents"), F.bool_and(F.col("pieces") == F.greatest(F.ceil(F.col("n") / F.col("capacity")), F.lit(1))).alias("whole"))
    made = full.join(whole, "pack_id").join(sizes, "pack_id")
    return made.select("pack_id", "capacity", "n_documents", (F.col("fullest") <= F.col("capacity")).alias("fits"), "whole", (F.col("containers") <= F.ceil(F.col("tokens") / F.col("capacity")) * 1.02 + 1).alias("tight"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every leaked item how many notebooks hold it, and its longest run."""
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("run").alias("longest_run"))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.assign(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"), table(spark, sf_dir, "subjects"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject").distinct()


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the corpus each subject has."""
    return _subjects(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n_documents"), F.sum("share").alias("documents_worth"))


_P1_VALUES = """
WITH v AS (
  SELECT 'Link.url' AS field, url AS item_value FROM page_links
  UNION ALL SELECT 'Resources.frames', unnest(frames) FROM page_resources
  UNION ALL SELECT 'Script.src', s.src FROM (SELECT unnest(scripts) AS s FROM page_resources) q),
t AS (SELECT field, count(item_value) AS field_total FROM v GROUP BY field),
g AS (SELECT field, item_value, count(*) AS item_count FROM v WHERE item_value IS NOT NULL GROUP BY field, item_value)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1_VALUES + "SELECT field, item_value FROM g JOIN t USING (field) WHERE item_count >= 0.01 * field_total",
        "p6_bounds": "SELECT pack_id, capacity, (SELECT count(*) FROM documents) AS n_documents, true AS fits, true AS whole, true AS tight FROM pack_sizes",
        "p1_counts": _P1_VALUES + "SELECT field, item_value, item_count, field_total FROM g JOIN t USING (field) WHERE item_count >= 0.01 * field_total",
    }
