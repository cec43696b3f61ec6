"""The scalar functions and the table functions under their names in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from leafmill.functions import colors, urls

_SECOND = ", ".join(f"'{s}'" for s in urls.SECOND_LEVEL)
_RESOURCES = "|".join(urls.RESOURCES)
#: Name, parameters, type and body; the bodies become part of the plans that use them.
BODIES = (
    ("site_of", "host STRING", "STRING", f"array_join(slice(split(regexp_replace(lower(host), '^www[.]', ''), '[.]'), greatest(size(split(regexp_replace(lower(host), '^www[.]', ''), '[.]')) - CASE WHEN size(split(regexp_replace(lower(host), '^www[.]', ''), '[.]')) >= 3 AND element_at(split(regexp_replace(lower(host), '^www[.]', ''), '[.]'), -2) IN ({_SECOND}) THEN 2 ELSE 1 END, 1), 3), '.')"),
    ("special_protocol", "url STRING", "STRING", "CASE WHEN lower(regexp_extract(trim(url), '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1)) NOT IN ('', 'http:', 'https:') THEN lower(regexp_extract(trim(url), '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1)) END"),
    ("is_resource", "url STRING", "BOOLEAN", f"regexp_like(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '(?i)[.]({_RESOURCES})$')"),
    ("host_of", "url STRING", "STRING", "lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1))"),
    ("link_kind", "href STRING, resolved STRING, page STRING", "STRING", "CASE WHEN special_protocol(href) IS NOT NULL THEN 'special' WHEN regexp_like(trim(href), '^/?#') AND split_part(resolved, '#', 1) = regexp_replace(split_part(page, '#', 1), '^(https?://[^/?#]+)(?=[?#]|$)', '$1/') THEN 'anchor' WHEN site_of(host_of(resolved)) = site_of(host_of(page)) THEN 'internal' ELSE 'external' END"),
    ("hidden_from_readers", "tag STRING, attrs MAP<STRING, STRING>", "BOOLEAN", "(coalesce(attrs['aria-hidden'] = 'true', false) OR map_contains_key(attrs, 'inert')) AND tag <> 'main' AND coalesce(attrs['role'] <> 'main', true)"),
    ("hides_content", "tag STRING, attrs MAP<STRING, STRING>", "BOOLEAN", "tag = 'template' OR (tag = 'dialog' AND NOT map_contains_key(attrs, 'open')) OR map_contains_key(attrs, 'hidden') OR hidden_from_readers(tag, attrs) OR coalesce(regexp_like(attrs['style'], '(?i)display\\\\s*:\\\\s*none|visibility\\\\s*:\\\\s*hidden'), false)"),
    ("to_hex", "rgb STRUCT<r: DOUBLE, g: DOUBLE, b: DOUBLE, alpha: DOUBLE>", "STRING", "'#' || lpad(lower(hex(CAST(floor(rgb.r + 0.5) AS INT))), 2, '0') || lpad(lower(hex(CAST(floor(rgb.g + 0.5) AS INT))), 2, '0') || lpad(lower(hex(CAST(floor(rgb.b + 0.5) AS INT))), 2, '0')"),
    ("_linear", "c DOUBLE", "DOUBLE", "CASE WHEN c / 255 <= 0.04045 THEN c / 255 / 12.92 ELSE pow((c / 255 + 0.055) / 1.055, 2.4) END"),
    ("_bent", "v DOUBLE", "DOUBLE", "CASE WHEN v > 0.008856 THEN cbrt(v) ELSE 7.787 * v + 16 / 116 END"),
    ("_lab_x", "c STRUCT<r: DOUBLE, g: DOUBLE, b: DOUBLE, alpha: DOUBLE>", "DOUBLE", "_bent((_linear(c.r) * 0.4124 + _linear(c.g) * 0.3576 + _linear(c.b) * 0.1805) / 0.95047)"),
    ("_lab_y", "c STRUCT<r: DOUBLE, g: DOUBLE, b: DOUBLE, alpha: DOUBLE>", "DOUBLE", "_bent(_linear(c.r) * 0.2126 + _linear(c.g) * 0.7152 + _linear(c.b) * 0.0722)"),
    ("_lab_z", "c STRUCT<r: DOUBLE, g: DOUBLE, b: DOUBLE, alpha: DOUBLE>", "DOUBLE", "_bent((_linear(c.r) * 0.0193 + _linear(c.g) * 0.1192 + _linear(c.b) * 0.9505) / 1.08883)"),
    ("color_distance", "a STRUCT<r: DOUBLE, g: DOUBLE, b: DOUBLE, alpha: DOUBLE>, c STRUCT<r: DOUBLE, g: DOUBLE, b: DOUBLE, alpha: DOUBLE>", "DOUBLE", "sqrt(pow(116 * (_lab_y(a) - _lab_y(c)), 2) + pow(500 * (_lab_x(a) - _lab_x(c) - _lab_y(a) + _lab_y(c)), 2) + pow(200 * (_lab_y(a) - _lab_y(c) - _lab_z(a) + _lab_z(c)), 2))"),
)


@udtf(returnType="property string, value string, selector string, at_rules array<string>, block int, origin string")
class ReadDeclarations:
    """The declarations of one style sheet."""

    def eval(self, css: str, origin: str):
        from leafmill.operators.css import read

        for name, value, selector, rules, block in read(css or "")[0]:
            yield name, value, selector, rules, block, origin


@udtf(returnType="kind string, place int, name string, value string, detail string")
class ReadStyles:
    """The style map of one style sheet as rows: variables, colours, fonts, font faces and imports."""

    def eval(self, css: str, origin: str):
        from leafmill.operators.css import Sheet, read

        found, urls = read(css or "")
        sheet = Sheet([{"seq": k, "property": p, "value": v, "selector": s, "at_rules": a, "block": b, "origin": origin} for k, (p, v, s, a, b) in enumerate(found)])
        rows = {
            "variable": [(r[1], r[6], r[7]) for r in sheet.variable_rows()], "color": [(r[5], r[2], r[7]) for r in sheet.color_rows()], "font": [(r[1], r[2], r[3]) for r in sheet.font_rows()],
            "font_face": [(r[2], r[3], r[4]) for r in sheet.face_rows()], "import": [(u, None, None) for u in urls],
        }
        for kind, each in rows.items():
            for k, row in enumerate(each):
                yield kind, k, *row


@udtf(returnType="kind string, place int, item string, error string")
class ReadStructuredData:
    """The nodes of JSON-LD blocks, and the broken blocks by their index."""

    def eval(self, blocks: list):
        import json

        from leafmill.operators.jsonld import read_blocks

        items, invalid = read_blocks([b or "" for b in blocks or ()])
        for k, item in enumerate(items):
            yield "item", k, json.dumps(item, ensure_ascii=False, separators=(",", ":")), None
        for k, error in invalid:
            yield "invalid", k, None, error


TABLES = {"read_declarations": ReadDeclarations, "read_styles": ReadStyles, "read_structured_data": ReadStructuredData}


def register(spark: SparkSession) -> list[str]:
    """Register all; returns their names."""
    for name, parameters, kind, body in BODIES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udf.register("absolute_url", urls._absolute)
    spark.udf.register("parse_color", colors.parse_color)
    spark.udf.register("colors_in", colors.colors_in)
    for name, function in TABLES.items():
        spark.udtf.register(name, function)
    return [b[0] for b in BODIES if b[0][0] != "_"] + ["absolute_url", "parse_color", "colors_in", *TABLES]
