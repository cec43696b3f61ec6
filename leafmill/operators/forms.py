"""Forms, their fields with labels, and their buttons: interval joins of fields and labels within a page.

Cases: forms in forms are ignored; a field without any label has none; fields outside forms belong to none; the first 50
forms of a page and 100 fields of a form are kept, buttons without limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import clean_text, js_trim
from leafmill.functions.urls import absolute_url
from leafmill.operators.facets import HIDDEN_TEXT, LIMITS, attr, blank, first_rows, joined_text, with_base, with_hidden, within
from leafmill.operators.tokenizer import ENTER, EXIT, TEXT, elements

BUTTONS = ("submit", "button", "reset", "image")


def forms(tokens: DataFrame, rule=None) -> DataFrame:
    rows = with_base(with_hidden(tokens, rule))
    here = elements(rows).where((F.col("tag") == "form") & ~within("form"))
    method = F.lower(js_trim(F.coalesce(attr("method"), F.lit(""))))
    made = here.select("page_id", "seq", "node", F.when(blank(attr("action")), F.col("url")).otherwise(absolute_url(attr("action"), F.col("base"))).alias("action"), F.when(method.isin("post", "dialog"), method).otherwise("get").alias("method"), F.nullif(attr("id"), F.lit("")).alias("id"), F.nullif(attr("name"), F.lit("")).alias("name"), "hidden")
    return first_rows(made, LIMITS["forms"], "page_id")


def _kind() -> Column:
    written = F.lower(js_trim(F.coalesce(attr("type"), F.lit(""))))
    return F.when(F.col("tag") != "input", F.col("tag")).when(written == "", "text").otherwise(written)


def _inside_forms(tokens: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with the number of the form that they stand in."""
    numbers = forms(tokens).select("page_id", F.col("node").alias("above"), F.col("place").alias("form"))
    return rows.withColumn("above", F.explode("inside")).join(numbers, ["page_id", "above"]).drop("above")


def fields(tokens: DataFrame) -> DataFrame:
    """Fields of each form in page order with their labels."""
    rows = elements(tokens).withColumn("type", _kind()).where(F.col("tag").isin("select", "textarea") | (F.col("tag") == "input") & ~F.col("type").isin(*BUTTONS))
    made = _inside_forms(tokens, rows)
    kept = first_rows(made, LIMITS["fields"], "page_id", "form")
    label = labels(tokens, kept)
    return kept.join(label, ["page_id", "node"], "left").select("page_id", "form", "place", "tag", "type", F.nullif(attr("name"), F.lit("")).alias("name"), F.nullif(attr("id"), F.lit("")).alias("id"), F.nullif(attr("autocomplete"), F.lit("")).alias("autocomplete"), F.nullif(clean_text(attr("placeholder")), F.lit("")).alias("placeholder"), attr("required").isNotNull().alias("required"), "label")


def label_texts(tokens: DataFrame) -> DataFrame:
    """``(page_id, label, target, opened, closed, text)`` of every label, without what selects and text areas hold."""
    here = elements(tokens).where(F.col("tag") == "label").select("page_id", F.col("node").alias("label"), attr("for").alias("target"), F.col("seq").alias("opened"))
    ends = tokens.where((F.col("kind") == EXIT) & (F.col("tag") == "label")).select("page_id", F.col("node").alias("label"), F.col("seq").alias("closed"))
    words = tokens.where((F.col("kind") == TEXT) & ~within(*HIDDEN_TEXT, "select", "textarea", "option")).select("page_id", "seq", "text", F.explode("inside").alias("label"))
    texts = joined_text(words.join(here.select("page_id", "label"), ["page_id", "label"], "left_semi"), "page_id", "label")
    return here.join(ends, ["page_id", "label"]).join(texts, ["page_id", "label"], "left").select("page_id", "label", "target", "opened", "closed", clean_text(F.coalesce("text", F.lit(""))).alias("text"))


def labels(tokens: DataFrame, fields_: DataFrame) -> DataFrame:
    """The label of each field: aria-label; else the last label for its id closed before it; else the first to close with
    text of the innermost label around it and later labels for its id."""
    known = label_texts(tokens)
    base = fields_.select("page_id", "node", "seq", attr("id").alias("id"), F.nullif(clean_text(attr("aria-label")), F.lit("")).alias("aria"), "inside")
    by_id = base.join(known, (base.page_id == known.page_id) & (base.id == known.target) & (base.id != "")).select(base.page_id, "node", "seq", "closed", "text")
    earlier = by_id.where("closed < seq AND text <> ''").groupBy("page_id", "node").agg(F.max_by("text", "closed").alias("earlier"))
    later = by_id.where("closed > seq").select("page_id", "node", "closed", "text")
    around = base.select("page_id", "node", F.explode("inside").alias("label")).join(known, ["page_id", "label"])
    inner = around.groupBy("page_id", "node").agg(F.max_by(F.struct("closed", "text"), "opened").alias("w")).select("page_id", "node", "w.closed", "w.text")
    rest = later.unionByName(inner).where("text <> ''").groupBy("page_id", "node").agg(F.min_by("text", "closed").alias("rest"))
    return base.join(earlier, ["page_id", "node"], "left").join(rest, ["page_id", "node"], "left").select("page_id", "node", F.coalesce("aria", "earlier", "rest").alias("label"))


def buttons(tokens: DataFrame) -> DataFrame:
    rows = elements(tokens).withColumn("type", _kind()).where((F.col("tag") == "button") | (F.col("tag") == "input") & F.col("type").isin(*BUTTONS))
    words = tokens.where((F.col("kind") == TEXT) & within("button") & ~within(*HIDDEN_TEXT)).select("page_id", "seq", "text", F.explode("inside").alias("node"))
    texts = joined_text(words, "page_id", "node").withColumnRenamed("text", "words")
    made = _inside_forms(tokens, rows).join(texts, ["page_id", "node"], "left")
    own = F.when(F.col("tag") == "button", F.coalesce(F.nullif(clean_text(F.coalesce("words", F.lit(""))), F.lit("")), clean_text(attr("value")))).otherwise(clean_text(F.coalesce(attr("value"), attr("alt"))))
    named = made.select("page_id", "form", "seq", F.substring(own, 1, 200).alias("button")).where("button <> ''")
    return named.withColumn("place", F.row_number().over(Window.partitionBy("page_id", "form").orderBy("seq")))
