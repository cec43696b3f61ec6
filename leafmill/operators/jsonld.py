"""JSON-LD blocks of pages, their nodes and the broken blocks; islands and payloads of hydrating frameworks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import JS_WS
from leafmill.operators.facets import LIMITS, attr, first_rows, raw_texts, with_base
from leafmill.operators.tokenizer import elements

_WRAP = re.compile(r"\A\s*(?:<!--|/\*\s*<!\[CDATA\[\s*\*/|//\s*<!\[CDATA\[|<!\[CDATA\[)?(.*?)(?:-->|/\*\s*\]\]>\s*\*/|//\s*\]\]>|\]\]>)?\s*\Z", re.S)


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def read_blocks(blocks: list[str]) -> tuple[list[dict], list[tuple[int, str]]]:
    """Nodes of all blocks, lists and graphs opened, and (index, error) of the broken ones; empty blocks are skipped."""
    items: list[dict] = []
    invalid: list[tuple[int, str]] = []
    for index, block in enumerate(blocks):
        text = _WRAP.match(block)[1].strip()
        if not text:
            continue
        try:
            root = json.loads(text, parse_constant=_refuse)
        except (ValueError, RecursionError) as error:
            invalid.append((index, str(error)))
            continue
        todo = [(root, None)]
        while todo:
            value, context = todo.pop(0)
            if isinstance(value, list):
                todo[:0] = [(v, context) for v in value]
            elif isinstance(value, dict):
                graph = value.get("@graph")
                if isinstance(graph, list):
                    own = value.get("@context", context)
                    todo[:0] = [(v, own) for v in graph if isinstance(v, (dict, list))]
                else:
                    items.append(value if context is None or "@context" in value else {"@context": context, **value})
    return items, invalid


_OUT = "page_id bigint, kind string, place int, item string, error string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for page, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            items, invalid = read_blocks([b["text"] for b in blocks])
            rows += [(page, "item", k, json.dumps(x, ensure_ascii=False, separators=(",", ":")), None) for k, x in enumerate(items)]
            rows += [(page, "invalid", k, None, e) for k, e in invalid]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], ["page_id", "kind", "place", "item", "error"])


def structured_data(tokens: DataFrame) -> DataFrame:
    """``(page_id, kind, place, item, error)``: nodes as JSON text in order, and broken blocks by their index."""
    blocks = raw_texts(tokens, "script").where(attr("type").rlike(f"(?i)^[{JS_WS}]*application/ld\\+json[{JS_WS}]*(?:;|$)"))
    kept = first_rows(blocks, LIMITS["jsonld"], "page_id")
    per = kept.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.substring("text", 1, 512 * 1024).alias("text")))).alias("blocks"))
    return per.mapInArrow(_read, _OUT)


def islands(tokens: DataFrame) -> DataFrame:
    """Islands with the name of their component's file and the size of their properties as escaped in the source."""
    rows = elements(with_base(tokens)).where(F.col("tag") == "astro-island")
    props = F.coalesce(attr("props"), F.lit(""))
    escaped = F.length(props) + sum(k * (F.length(props) - F.length(F.replace(props, F.lit(c)))) for c, k in (('"', 5), ("&", 4), ("'", 4), ("<", 3), (">", 3)))
    name = F.element_at(F.split(F.regexp_replace(F.coalesce(attr("component-url"), F.lit("")), "[?#].*$", ""), "/"), -1)
    made = rows.select("page_id", "seq", "node", attr("uid").alias("uid"), attr("client").alias("client"), name.alias("component"), escaped.cast("int").alias("props_bytes"), attr("ssr").isNull().alias("server_rendered"))
    return first_rows(made, LIMITS["islands"], "page_id")


# Ids and first statements by which frameworks mark their payloads.
FRAMEWORK_IDS = {"__NEXT_DATA__": "next-pages", "__NUXT_DATA__": "nuxt", "ng-state": "angular"}
FRAMEWORK_STARTS = ((r"self\.__next_f\b", "next-app"), (r"window\.__NUXT__\s*=", "nuxt"), (r"__sveltekit_\w+\s*=\s*\{", "sveltekit"), (r"window\.__(?:remixContext|reactRouterContext)\s*=", "remix"))


def script_frameworks(tokens: DataFrame) -> DataFrame:
    """``(page_id, framework, payload)``: characters of the payload scripts of each framework on a page."""
    rows = raw_texts(tokens, "script").where(attr("src").isNull())
    by_id = F.create_map(*(F.lit(v) for kv in FRAMEWORK_IDS.items() for v in kv))[attr("id")]
    start = F.substring("text", 1, 1000)
    by_start = F.coalesce(*(F.when(start.rlike(p), F.lit(n)) for p, n in FRAMEWORK_STARTS))
    return rows.select("page_id", F.coalesce(by_id, by_start).alias("framework"), F.length("text").alias("n")).where("framework IS NOT NULL").groupBy("page_id", "framework").agg(F.sum("n").alias("payload"))


def hydration(tokens: DataFrame) -> DataFrame:
    """The framework that hydrates each page and the size of its data; pages that nothing hydrates have no row."""
    order = ("next-pages", "next-app", "nuxt", "sveltekit", "remix", "angular")
    astro = islands(tokens).groupBy("page_id").agg(F.sum("props_bytes").alias("payload")).select("page_id", F.lit("astro").alias("framework"), "payload", F.lit(0).alias("rank"))
    rank = F.coalesce(*(F.when(F.col("framework") == n, F.lit(k + 1)) for k, n in enumerate(order)))
    scripts = script_frameworks(tokens).where("payload > 0 OR framework <> 'remix'").select("page_id", "framework", "payload", rank.alias("rank"))
    angular = elements(tokens).where(attr("ng-version").isNotNull()).select("page_id").distinct().select("page_id", F.lit("angular").alias("framework"), F.lit(0).cast("bigint").alias("payload"), F.lit(7).alias("rank"))
    every = astro.unionByName(scripts).unionByName(angular)
    return every.groupBy("page_id").agg(F.min_by(F.struct("framework", "payload"), "rank").alias("h")).select("page_id", "h.framework", F.col("h.payload").alias("payload_bytes"))
