"""All facets of a page in one record: the facets asked for, joined by page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.core import materialize
from leafmill.operators import css, facets, forms, jsonld
from leafmill.operators.markdown import markdown as to_markdown
from leafmill.operators.tokenizer import tokenize


def _listed(rows: DataFrame, order: str, name: str) -> DataFrame:
    """The rows of each page as one array in order, without the columns that only order or join."""
    kept = [c for c in rows.columns if c not in ("page_id", "node")]
    fields = [c for c in kept if c != order]
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("v"))), lambda a, b: F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0))
    return rows.groupBy("page_id").agg(F.transform(packed, lambda p: p["v"]).alias(name))


FACETS = {
    "links": lambda t: _listed(facets.links(t), "place", "links"),
    "images": lambda t: _listed(facets.images(t), "seq", "images"),
    "scripts": lambda t: _listed(facets.scripts(t).drop("place"), "seq", "scripts"),
    "frames": lambda t: _listed(facets.frames(t).drop("place"), "seq", "frames"),
    "link_elements": lambda t: _listed(facets.link_elements(t).drop("place"), "seq", "link_elements"),
    "media": lambda t: _listed(facets.media(t).drop("place"), "seq", "media"),
    "meta": lambda t: facets.meta(t).select("page_id", F.struct("title", "description", "language", "canonical", "robots", "viewport", "generator", "image").alias("meta")),
    "properties": lambda t: facets.properties(t).groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "content"))).alias("properties")),
    "headings": lambda t: _listed(facets.headings(t), "place", "headings"),
    "heading_counts": lambda t: facets.heading_counts(t).select("page_id", F.array(*facets.HEADINGS).alias("heading_counts")),
    "text": lambda t: facets.visible_text(t).select("page_id", F.struct("length", "content").alias("text")),
    "ids": lambda t: _listed(facets.ids(t).drop("place"), "seq", "ids"),
    "inline_code": lambda t: facets.inline_code(t).select("page_id", F.struct("event_handlers", "javascript_urls", "style_elements", "style_attributes").alias("inline_code")),
    "inline_scripts": lambda t: _listed(facets.inline_scripts(t), "place", "inline_scripts"),
    "style_blocks": lambda t: _listed(facets.style_blocks(t), "place", "style_blocks"),
    "stylesheets": lambda t: _listed(facets.stylesheets(t), "seq", "stylesheets"),
    "forms": lambda t: _listed(forms.forms(t).drop("seq"), "place", "forms"),
    "fields": lambda t: _listed(forms.fields(t).withColumn("at", F.col("form") * 1000 + F.col("place")).drop("place"), "at", "fields"),
    "buttons": lambda t: _listed(forms.buttons(t).drop("place"), "seq", "buttons"),
    "structured_data": lambda t: jsonld.structured_data(t).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "item", F.struct("place", "item")))), lambda x: x["item"]).alias("items"), F.array_sort(F.collect_list(F.when(F.col("kind") == "invalid", F.struct(F.col("place").alias("index"), "error")))).alias("invalid")).select("page_id", F.struct("items", "invalid").alias("structured_data")),
    "hydration": lambda t: jsonld.hydration(t).select("page_id", F.struct("framework", "payload_bytes").alias("hydration")),
    "head_issues": lambda t: _listed(facets.head_issues(t), "element", "head_issues"),
    "form_actions": lambda t: _listed(facets.form_actions(t), "seq", "form_actions"),
    "islands": lambda t: _listed(jsonld.islands(t).drop("place"), "seq", "islands"),
    "style_attributes": lambda t: _listed(facets.style_attributes(t).drop("place"), "seq", "style_attributes"),
    "style_map": lambda t: _styles(t),
    "head": lambda t: _listed(facets.head_elements(t), "place", "head"),
}


def _styles(tokens: DataFrame) -> DataFrame:
    """The style map of what a page itself holds: its style blocks and style attributes."""
    none = tokens.sparkSession.createDataFrame([], "sheet_id bigint, css string, origin string")
    made = css.style_map(css.style_sources(none, facets.style_blocks(tokens), facets.style_attributes(tokens)))
    return made.select(F.col("sheet_id").alias("page_id"), F.struct("colors", "font_faces", "fonts", "imports", "variables").alias("style_map"))


def _with(rule, positions: bool, select: dict[str, str] | None, class_prefixes: list[str] | None) -> dict:
    """The facets that take parameters."""

    def placed(t: DataFrame, at: DataFrame) -> DataFrame:
        return at.select("page_id", "node", "position")

    out = {
        "links": lambda t, at: _listed(facets.links(t, rule=rule), "place", "links"),
        "images": lambda t, at: _listed(facets.images(t, placed(t, at) if positions else None, rule), "seq", "images"),
        "headings": lambda t, at: _listed(facets.headings(t, rule), "place", "headings"),
        "forms": lambda t, at: _listed(forms.forms(t, rule).drop("seq"), "place", "forms"),
    }
    if positions:
        out["islands"] = lambda t, at: _listed(jsonld.islands(t).drop("place").join(placed(t, at), ["page_id", "node"], "left"), "seq", "islands")
    if select:
        out["select"] = lambda t, at: _listed(facets.select(t, select, rule), "place", "select")
    if class_prefixes:
        out["class_counts"] = lambda t, at: facets.class_counts(t, class_prefixes).groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("prefix", "n"))).alias("class_counts"))
    return out


def parse_pages(pages: DataFrame, *wanted: str, context: str | None = None, hidden_rule=None, positions: bool = False, select: dict[str, str] | None = None, class_prefixes: list[str] | None = None, markdown: dict | None = None) -> DataFrame:
    """``(page_id, url, <facets>)``: a column for each facet named, null where a page has nothing for it.

    ``context`` limits links, images, headings, texts, forms, selections and class counts, as it does for each of them;
    ``hidden_rule`` decides what is hidden, see ``facets.with_hidden``; ``positions`` adds where images and islands stand,
    estimated over the whole page; ``select`` (selectors by name) and ``class_prefixes`` add facets of their own, and
    ``markdown`` (parameters of the conversion) adds the page as Markdown.
    """
    known = FACETS | _with(hidden_rule, positions, select, class_prefixes)
    wanted = (*wanted, *(n for n in ("select", "class_counts") if n in known and n not in wanted))
    unknown = set(wanted) - set(known)
    if unknown:
        raise ValueError(f"unknown facets: {sorted(unknown)}")
    tokens = materialize(tokenize(pages), "events")  # every facet reads them
    inside = facets.in_context(tokens, context)
    limited = {"links", "images", "headings", "heading_counts", "text", "forms", "fields", "buttons", "select", "class_counts"}
    where = facets.positions(tokens) if positions else None
    out = pages.select("page_id", "url")
    for name in wanted:
        given = inside if name in limited else tokens
        made = known[name](given) if known[name] is FACETS.get(name) else known[name](given, where)
        out = out.join(made, "page_id", "left")
    return out if markdown is None else out.join(to_markdown(pages, **markdown), "page_id", "left")
