"""All queries of the core, by name, and the SQL each is compared with.

Facets that the stored pages have are read from them; the others are read from pages rendered out of the fact tables, so
that SQL can say from the tables alone what has to come out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.core import materialize, once, spread, table
from leafmill.functions import colors, register, text, urls
from leafmill.operators import clean, css, facets, forms, jsonld, markdown, nested, record, selectors
from leafmill.operators.tokenizer import elements, tokenize
from leafmill.sources import bytes as raw

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- inputs


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages, a page delivered twice once."""
    stored = table(spark, sf_dir, "pages")
    return spread(once(stored, F.col("page_id")).select("page_id", "url", "html"), stored)


def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(pages(spark, sf_dir))


def kept_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written once, for queries that join them with themselves and would tokenise several times otherwise."""
    return materialize(page_tokens(spark, sf_dir), "events")


def esc(c: Column | str) -> Column:
    out = F.col(c) if isinstance(c, str) else c
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def opt(name: str, value: Column) -> Column:
    """An attribute, left out where its value is null."""
    return F.coalesce(F.concat(F.lit(f' {name}="'), esc(value), F.lit('"')), F.lit(""))


def rendered(rows: DataFrame, order: str, html: Column, head: bool = False, url: Column | None = None) -> DataFrame:
    """Pages out of rows ``(page_id, order, ...)``: the html of the rows of a page in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), html.alias("h"))))
    body = F.array_join(F.transform(parts, lambda p: p["h"]), "")
    start, end = ("<html><head>", "</head><body></body></html>") if head else ("<html><body>", "</body></html>")
    parts_of = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = rows.repartition(parts_of, "page_id").groupBy("page_id").agg(F.concat(F.lit(start), body, F.lit(end)).alias("html"))
    return made.select("page_id", (url if url is not None else F.lit("https://firma.example/a/")).alias("url"), "html")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_dedupe(spark, sf_dir)


# ---- pieces of SQL

_JS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '[\x{{00AD}}\x{{200B}}]', '', 'g'), '[{_JS}]+', ' ', 'g'))"


def _decode(x: str) -> str:
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{plain}')"
    return x


_P = "p AS (SELECT DISTINCT ON (page_id) page_id, url, html FROM pages)"
_A = rf"""WITH {_P},
a AS (SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*<', 1)) AS h, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)<', 1)) AS t,
  unnest(range(len(regexp_extract_all(html, '<a href="[^"]*">[^<]*<')))) AS k FROM p),
l AS (SELECT page_id, page_url, {_decode("h")} AS url, {_clean(_decode("t"))} AS text, k FROM a)
"""
_HOST = lambda u: f"lower(regexp_extract({u}, '^https?://([^/?#:]*)', 1))"
_LEVELS = "('co','com','org','net','gov','gv','ac','edu','or')"


def _site(host: str) -> str:
    labels = f"string_split(regexp_replace(lower({host}), '^www\\.', ''), '.')"
    return f"(CASE WHEN len({labels}) >= 3 AND {labels}[-2] IN {_LEVELS} THEN array_to_string({labels}[-3:], '.') ELSE array_to_string({labels}[-2:], '.') END)"


def _kind(u: str, page: str) -> str:
    return f"(CASE WHEN regexp_matches({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') AND NOT regexp_matches({u}, '^(?i:https?):') THEN 'special' WHEN {_site(_HOST(u))} = {_site(_HOST(page))} THEN 'internal' ELSE 'external' END)"


_EXT = "|".join(urls.RESOURCES)

# ---- sources


@query(rf"WITH {_P} SELECT page_id, len(regexp_extract_all(html, '<[a-zA-Z]')) AS n_elements FROM p")
def scan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(page_tokens(spark, sf_dir)).groupBy("page_id").agg(F.count("*").alias("n_elements"))


@query(rf"WITH {_P} SELECT page_id, regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1) AS encoding FROM p")
def meta_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", raw.meta_charset(F.encode("html", "utf-8")).alias("encoding"))


@query(rf"WITH {_P} SELECT page_id, md5(html) AS digest FROM p")
def decode_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as UTF-16 bytes with a mark decode to the stored text, whatever the meta element says."""
    given = pages(spark, sf_dir).select("page_id", "url", F.concat(F.unhex(F.lit("FFFE")), F.encode("html", "UTF-16LE")).alias("body"), F.lit("text/html; charset=iso-8859-1").alias("content_type"))
    return raw.decode_pages(given).select("page_id", F.md5("html").alias("digest"))


@query(rf"WITH {_P} SELECT page_id, md5(html) AS digest FROM p")
def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut into chunks of 64 bytes, characters divided, come together again."""
    body = pages(spark, sf_dir).select("page_id", "url", F.encode("html", "utf-8").alias("body"))
    cut = body.select("page_id", "url", "body", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("body") - 1) / 64).cast("int"))).alias("chunk_seq"))
    chunks = cut.select("page_id", "url", "chunk_seq", F.substring("body", F.col("chunk_seq") * 64 + 1, F.lit(64)).alias("chunk"))
    return raw.decode_pages(raw.join_chunks(chunks)).select("page_id", F.md5("html").alias("digest"))


@query("SELECT * FROM (VALUES (1, 'utf-8'), (2, 'utf-16be'), (3, 'utf-16le'), (4, NULL)) t(k, encoding)")
def bom_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, bytearray(b"\xef\xbb\xbfa")), (2, bytearray(b"\xfe\xff\x00a")), (3, bytearray(b"\xff\xfea\x00")), (4, bytearray(b"abc"))], "k int, body binary")
    return rows.select("k", raw.bom_encoding(F.col("body")).alias("encoding"))


@query("SELECT * FROM (VALUES (1, 'utf-8'), (2, 'ISO-8859-1'), (3, NULL), (4, NULL)) t(k, charset)")
def header_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, 'text/html; charset="utf-8"'), (2, "text/html;charset = ISO-8859-1; x=1"), (3, "text/html"), (4, None)], "k int, content_type string")
    return rows.select("k", raw.header_charset(F.col("content_type")).alias("charset"))


# ---- links and addresses


@query(_A + f"SELECT page_id, url, arg_min(text, k) AS text, count(*)::INT AS link_count, {_kind('url', 'any_value(page_url)')} AS kind FROM l WHERE url <> '' GROUP BY page_id, url")
def links_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.links(page_tokens(spark, sf_dir)).select("page_id", "url", "text", "link_count", "kind")


@query(_A + f", d AS (SELECT page_id, url, {_kind('url', 'any_value(page_url)')} AS kind FROM l WHERE url <> '' GROUP BY page_id, url) SELECT kind, count(*) AS n FROM d GROUP BY kind")
def links_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.links(page_tokens(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


@query(_A + f", d AS (SELECT page_id, url, {_kind('url', 'any_value(page_url)')} AS kind FROM l WHERE url <> '' GROUP BY page_id, url) SELECT page_id, url FROM d WHERE kind = 'external' AND NOT regexp_matches(regexp_replace(url, '[?#].*$', ''), '(?i)\\.(?:{_EXT})$')")
def link_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.links(page_tokens(spark, sf_dir), ["external"], resources=False).select("page_id", "url")


@query(_A + ", d AS (SELECT page_id, url, count(*) AS n, min(k) AS first FROM l WHERE url <> '' GROUP BY page_id, url) SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, first)::INT AS place FROM d")
def link_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.links(page_tokens(spark, sf_dir)).select("page_id", "url", "place")


def _stored_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_links").select("link_id", "url").dropDuplicates(["link_id"])


_L = "l AS (SELECT DISTINCT ON (link_id) link_id, url, text FROM page_links)"


@query(rf"WITH {_L} SELECT link_id, {_site(_HOST('url'))} AS site FROM l WHERE url LIKE 'http%'")
def site_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_links(spark, sf_dir).where("url LIKE 'http%'").select("link_id", urls.site_of(urls.host_of(F.col("url"))).alias("site"))


@query(rf"WITH {_L} SELECT link_id, CASE WHEN regexp_matches(url, '^(?i:https?):') THEN NULL ELSE lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1)) END AS protocol FROM l WHERE url IS NOT NULL")
def special_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_links(spark, sf_dir).where("url IS NOT NULL").select("link_id", urls.special_protocol(F.col("url")).alias("protocol"))


@query(rf"WITH {_L} SELECT link_id, regexp_matches(regexp_replace(url, '[?#].*$', ''), '(?i)\.(?:{_EXT})$') AS resource FROM l WHERE url IS NOT NULL")
def is_resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_links(spark, sf_dir).where("url IS NOT NULL").select("link_id", urls.is_resource(F.col("url")).alias("resource"))


@query("SELECT DISTINCT ON (link_id) link_id, kind FROM page_links WHERE url IS NOT NULL AND kind IN ('internal', 'external', 'special')")
def link_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of every stored link, found from its address and its page's."""
    page = pages(spark, sf_dir).select("page_id", F.col("url").alias("page_url"))
    stored = table(spark, sf_dir, "page_links").select("link_id", "page_id", "url", "kind").dropDuplicates(["link_id"]).where("url IS NOT NULL AND kind IN ('internal', 'external', 'special')")
    return stored.join(page, "page_id").select("link_id", urls.link_kind(F.col("url"), F.col("url"), F.col("page_url")).alias("kind"))


@query("SELECT p_partkey, 'https://firma.example/teile/' || p_partkey || '/' || replace(url_encode(p_name), '%2F', '/') || '?q=1' AS url FROM part")
def absolute_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative addresses with dot segments and unsafe characters, resolved against a page."""
    href = F.concat(F.lit("../teile/./"), F.col("p_partkey").cast("string"), F.lit("/"), F.col("p_name"), F.lit("?q=1"))
    return table(spark, sf_dir, "part").select("p_partkey", urls.absolute_url(href, F.lit("HTTPS://Firma.example:443/a/b")).alias("url"))


@query("SELECT DISTINCT page_id, 'https://firma.example/basis/s' || page_id AS after, 'https://firma.example/s' || page_id AS before FROM pages")
def base_href(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses before the base element use the page's, those after it the base's."""
    rows = pages(spark, sf_dir).select("page_id", F.concat(F.lit('<link rel="before" href="s'), "page_id", F.lit('"><base href="/basis/"><link rel="after" href="s'), "page_id", F.lit('">')).alias("h"), F.lit(0).alias("o"))
    found = facets.link_elements(tokenize(rendered(rows, "o", F.col("h"), head=True, url=F.lit("https://firma.example/"))))
    return found.groupBy("page_id").agg(F.max(F.when(F.col("rel") == "after", F.col("href"))).alias("after"), F.max(F.when(F.col("rel") == "before", F.col("href"))).alias("before"))


# ---- texts and metadata


@query(rf"WITH {_P} SELECT page_id, {_clean(_decode(chr(34).join(['regexp_extract(html, ' + chr(39) + '(?s)<title>(.*?)</title>' + chr(39) + ', 1)'])))} AS title FROM p WHERE html LIKE '%<title>%'")
def meta_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.titles(page_tokens(spark, sf_dir))


_DESC = "regexp_extract(html, '<meta name=\"description\" content=\"([^\"]*)\"', 1)"


@query(rf"WITH {_P} SELECT page_id, nullif({_clean(_decode(_DESC))}, '') AS description, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS language FROM p")
def meta_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.meta(page_tokens(spark, sf_dir)).select("page_id", "description", F.coalesce("language", F.lit("")).alias("language"))


_M = "m AS (SELECT DISTINCT ON (meta_id) * EXCLUDE (page_id), meta_id AS page_id FROM page_meta)"


def _meta_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each fetch with the stored metadata in its head."""
    rows = table(spark, sf_dir, "page_meta").dropDuplicates(["meta_id"]).withColumn("page_id", F.col("meta_id")).withColumn("o", F.lit(0))
    tag = lambda n, c: F.coalesce(F.concat(F.lit(f'<meta name="{n}" content="'), esc(c), F.lit('">')), F.lit(""))
    html = F.concat(tag("robots", "robots"), tag("viewport", "viewport"), tag("generator", "generator"), tag("og:image", "image"), F.coalesce(F.concat(F.lit('<link rel="x Canonical" href="'), esc("canonical"), F.lit('">')), F.lit("")))
    return rendered(rows, "o", html, head=True)


@query(rf"WITH {_M} SELECT page_id, nullif({_clean('robots')}, '') AS robots, nullif({_clean('viewport')}, '') AS viewport, nullif({_clean('generator')}, '') AS generator, image, canonical FROM m")
def meta_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.meta(tokenize(_meta_pages(spark, sf_dir))).select("page_id", "robots", "viewport", "generator", "image", "canonical")


@query(rf"WITH {_M}, e AS (SELECT page_id, unnest(map_entries(properties)) AS e FROM m) SELECT page_id, lower(e.key) AS name, e.value AS content FROM e WHERE e.value IS NOT NULL")
def meta_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "page_meta").dropDuplicates(["meta_id"]).select(F.col("meta_id").alias("page_id"), F.explode("properties").alias("k", "v")).where("v IS NOT NULL")
    tag = F.concat(F.lit('<meta property="'), F.upper(esc("k")), F.lit('" content="'), esc("v"), F.lit('"><meta property="'), esc("k"), F.lit('" content="again">'))
    return facets.properties(tokenize(rendered(rows, "k", tag, head=True))).select("page_id", "name", "content")


_H1 = "regexp_extract(html, '<h1>([^<]*)</h1>', 1)"


@query(rf"WITH {_P}, h AS (SELECT page_id, {_clean(_decode(_H1))} AS text FROM p) SELECT page_id, 1::INT AS level, text FROM h WHERE text <> ''")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.headings(page_tokens(spark, sf_dir)).select("page_id", "level", "text")


@query(rf"WITH {_P} SELECT page_id, len(regexp_extract_all(html, '<h1[ >]'))::INT AS h1, len(regexp_extract_all(html, '<h2[ >]'))::INT AS h2 FROM p")
def heading_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.heading_counts(page_tokens(spark, sf_dir)).select("page_id", "h1", "h2")


_VISIBLE = (
    "trim(regexp_replace(" + _decode(r"regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*?</head>', '', 'g'), '</?(?:nav|ul|li|div|article|h1|p|footer|br|body|html)\b[^>]*>', ' ', 'g'), '<[a-zA-Z/][^>]*>', '', 'g')") + r", '[\t\n\f\r ]+', ' ', 'g'))"
)


@query(rf"WITH {_P}, t AS (SELECT page_id, {_VISIBLE} AS content FROM p) SELECT page_id, content, length(content)::BIGINT AS length FROM t")
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.visible_text(page_tokens(spark, sf_dir)).select("page_id", "content", F.col("length").cast("bigint").alias("length"))


@query(rf"WITH {_P}, t AS (SELECT page_id, {_VISIBLE} AS content FROM p) SELECT page_id, regexp_replace(left(content, 80), ' $', '') AS content FROM t")
def text_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.visible_text(page_tokens(spark, sf_dir), 80).select("page_id", "content")


@query(rf"WITH {_L} SELECT link_id, {_clean('text')} AS text FROM l WHERE text IS NOT NULL")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_links").select("link_id", "text").dropDuplicates(["link_id"]).where("text IS NOT NULL").select("link_id", text.clean_text(F.col("text")).alias("text"))


@query(r"SELECT doc_id, length(text) >= 16 AND (regexp_matches(text, '(?i)(8BIM|Exif|Photoshop 3\.0|Adobe XMP Core|xmpmeta|rdf:RDF|xpacket)') OR len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) > 20 OR len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) / length(text) > 0.05) AS binary FROM documents")
def looks_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.looks_binary(F.col("text")).alias("binary"))


@query(rf"WITH {_P} SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href=\"http'))::INT AS n, 'http' AS prefix FROM p UNION ALL SELECT page_id, 0, 'xyz-' FROM p")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the stored pages rendered with classes by scheme, counted by class prefix."""
    made = pages(spark, sf_dir).select("page_id", "url", F.regexp_replace("html", '<a href="http', '<a class="x http-link http2" href="http').alias("html"))
    return facets.class_counts(tokenize(made), ["http", "xyz-"])


@query("WITH l AS (SELECT DISTINCT ON (link_id) * FROM page_links) SELECT page_id, 'l' || link_id AS id FROM l UNION ALL SELECT DISTINCT page_id, 'twice' FROM l")
def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "page_links").select("link_id", "page_id").dropDuplicates(["link_id"])
    html = F.concat(F.lit('<p id="l'), "link_id", F.lit('"></p><a name="twice" id=""></a><div name="no"></div>'))
    return facets.ids(tokenize(rendered(rows, "link_id", html))).select("page_id", "id")


@query("WITH l AS (SELECT DISTINCT ON (link_id) * FROM page_links) SELECT page_id, 'm' || link_id AS id FROM l WHERE link_id % 3 = 0")
def dangling_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragment links of which every third leads nowhere."""
    rows = table(spark, sf_dir, "page_links").select("link_id", "page_id").dropDuplicates(["link_id"])
    target = F.concat(F.when(F.col("link_id") % 3 == 0, "m").otherwise("l"), F.col("link_id").cast("string"))
    html = F.concat(F.lit('<p id="l'), F.col("link_id").cast("string"), F.lit('"></p><a href="#'), target, F.lit('">x</a>'))
    return facets.dangling_fragments(tokenize(rendered(rows, "link_id", html))).select("page_id", "id")


# ---- images and resources


@query("""WITH i AS (SELECT DISTINCT ON (image_id) * FROM page_images), f AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY image_id) AS k FROM i WHERE url IS NOT NULL)
SELECT page_id, url, width, height, loading, srcset FROM f WHERE k = 1""")
def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "page_images").dropDuplicates(["image_id"])
    html = F.concat(F.lit("<img"), opt("src", F.col("url")), opt("alt", F.col("alt")), opt("width", F.col("width")), opt("height", F.col("height")), opt("loading", F.col("loading")), F.when(F.col("srcset"), F.lit(' srcset="/a.jpg 1x, /b.jpg 2x"')).otherwise(""), F.lit(">"))
    return facets.images(tokenize(rendered(rows, "image_id", html))).select("page_id", "url", "width", "height", "loading", "srcset")


@query("SELECT p_partkey, unnest(['/k/' || p_partkey || '-400.jpg', '/k/' || p_partkey || '-800.jpg']) AS url FROM part")
def srcset_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    srcset = F.concat(F.lit("/k/"), key, F.lit("-400.jpg 400w,/k/"), key, F.lit("-800.jpg 800w, data:image/png;base64,xx 2x, /k/"), key, F.lit("-400.jpg 1x"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(facets.srcset_urls(srcset)).alias("url"))


_R = "r AS (SELECT DISTINCT ON (page_id) * FROM page_resources)"


def _resource_pages(spark: SparkSession, sf_dir: str, column: str, html: Callable[[Column], Column], head: bool = False) -> DataFrame:
    rows = table(spark, sf_dir, "page_resources").select("page_id", column).dropDuplicates(["page_id"]).select("page_id", F.posexplode(column).alias("k", "x"))
    return rendered(rows, "k", html(F.col("x")), head)


@query(f"WITH {_R}, s AS (SELECT page_id, unnest(scripts) AS s FROM r) SELECT page_id, s.src AS src, s.type AS type, count(*) AS n FROM s GROUP BY ALL")
def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _resource_pages(spark, sf_dir, "scripts", lambda x: F.concat(F.lit("<script"), opt("src", x["src"]), opt("type", x["type"]), F.lit("></script>")))
    return facets.scripts(tokenize(made)).groupBy("page_id", "src", "type").agg(F.count("*").alias("n"))


@query(f"WITH {_R}, s AS (SELECT page_id, unnest(frames) AS src FROM r) SELECT page_id, src, count(*) AS n FROM s WHERE src <> '' GROUP BY ALL")
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _resource_pages(spark, sf_dir, "frames", lambda x: F.concat(F.lit('<iframe src="'), esc(x), F.lit('"></iframe>')))
    return facets.frames(tokenize(made)).groupBy("page_id", "src").agg(F.count("*").alias("n"))


@query(f"WITH {_R}, s AS (SELECT page_id, unnest(links) AS s FROM r) SELECT page_id, s.href AS href, coalesce(s.rel, '') AS rel, s.type AS type, count(*) AS n FROM s WHERE s.href <> '' GROUP BY ALL")
def link_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _resource_pages(spark, sf_dir, "links", lambda x: F.concat(F.lit("<link"), opt("href", x["href"]), opt("rel", x["rel"]), opt("type", x["type"]), F.lit(">")), head=True)
    return facets.link_elements(tokenize(made)).groupBy("page_id", "href", "rel", "type").agg(F.count("*").alias("n"))


@query(f"WITH {_R}, s AS (SELECT page_id, unnest(links) AS s FROM r) SELECT DISTINCT page_id, s.href AS href FROM s WHERE s.href <> '' AND regexp_matches(lower(s.rel), '(^|\\s)stylesheet(\\s|$)')")
def stylesheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _resource_pages(spark, sf_dir, "links", lambda x: F.concat(F.lit("<link"), opt("href", x["href"]), opt("rel", x["rel"]), F.lit(">")), head=True)
    return facets.stylesheets(tokenize(made)).select("page_id", "href")


@query(f"WITH {_R}, s AS (SELECT page_id, unnest(media) AS src FROM r) SELECT DISTINCT page_id, src FROM s WHERE src <> ''")
def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _resource_pages(spark, sf_dir, "media", lambda x: F.concat(F.lit('<video src="'), esc(x), F.lit('"></video><audio src="'), esc(x), F.lit('"></audio><embed src="data:x">')))
    return facets.media(tokenize(made)).select("page_id", "src")


# ---- selectors


def _selected(spark: SparkSession, sf_dir: str, selector: str) -> DataFrame:
    return selectors.match(elements(kept_tokens(spark, sf_dir)), selector).groupBy("page_id").agg(F.count("*").alias("n"))


@query(rf"WITH {_P} SELECT page_id, len(regexp_extract_all(html, '<p>'))::BIGINT AS n FROM p WHERE html LIKE '%<p>%'")
def sel_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, "P")


@query(rf"WITH {_P}, a AS (SELECT page_id, len(regexp_extract_all(html, '<a href=\"https:'))::BIGINT AS n FROM p) SELECT * FROM a WHERE n > 0")
def sel_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, 'a[href^="https:"]')


@query(rf"WITH {_P}, a AS (SELECT page_id, len(regexp_extract_all(html, '<li>'))::BIGINT AS n FROM p) SELECT page_id, (n + 1) // 2 AS n FROM a WHERE n > 0")
def sel_nth_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, "li:nth-child(2n+1)")


@query(rf"WITH {_P} SELECT page_id, 1::BIGINT AS n FROM p WHERE html LIKE '%<p>%'")
def sel_first_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, "article > p:first-of-type")


@query(rf"WITH {_P}, a AS (SELECT page_id, (len(regexp_extract_all(html, '<a href=\"')) - len(regexp_extract_all(html, '<a href=\"[^\"]*\.pdf\"')))::BIGINT AS n FROM p) SELECT * FROM a WHERE n > 0")
def sel_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, "a:not([href$='.pdf'])")


@query(rf"WITH {_P}, a AS (SELECT page_id, len(regexp_extract_all(html, '<li>'))::BIGINT AS n FROM p) SELECT * FROM a WHERE n > 0")
def sel_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, "nav > ul > li")


@query(rf"WITH {_P}, a AS (SELECT page_id, (len(regexp_extract_all(html, '<a href')) + len(regexp_extract_all(html, '<h1>')))::BIGINT AS n FROM p) SELECT * FROM a WHERE n > 0")
def sel_descendant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, "body nav a, h1")


@query(rf"WITH {_P} SELECT page_id, 1::INT AS level, {_clean(_decode(_H1))} AS text FROM p WHERE {_clean(_decode(_H1))} <> ''")
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.headings(facets.in_context(page_tokens(spark, sf_dir), "article")).select("page_id", "level", "text")


@query(rf"WITH {_P} SELECT page_id, 'head' AS key, 'h1' AS tag, {_clean(_decode(_H1))} AS text FROM p WHERE html LIKE '%<h1>%'")
def select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.select(kept_tokens(spark, sf_dir), {"head": "article h1", "none": ".missing"}).select("page_id", "key", "tag", "text")


# ---- hidden content, positions, head


@query("WITH l AS (SELECT DISTINCT ON (link_id) * FROM page_links WHERE url <> '') SELECT page_id, url, bool_and(coalesce(hidden, false)) AS hidden FROM l GROUP BY page_id, url")
def hidden_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links inside and outside of hidden parts: an address is hidden if all its links are."""
    rows = table(spark, sf_dir, "page_links").where("url <> ''").dropDuplicates(["link_id"])
    link = F.concat(F.lit('<a href="'), esc("url"), F.lit('">x</a>'))
    html = F.when(F.coalesce("hidden", F.lit(False)), F.concat(F.lit('<div><div style="x:y; Display : none">'), link, F.lit("</div></div>"))).otherwise(link)
    return facets.links(tokenize(rendered(rows, "link_id", html))).select("page_id", "url", "hidden")


@query("WITH i AS (SELECT DISTINCT ON (image_id) image_id, page_id FROM page_images), n AS (SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY image_id) - 1) * 10 AS text_before, (row_number() OVER (PARTITION BY page_id ORDER BY image_id) - 1) AS images_before FROM i) SELECT image_id, text_before::BIGINT AS text_before, images_before::BIGINT AS images_before, CASE WHEN images_before = 0 AND text_before < 200 THEN 'first-screen' WHEN text_before >= 1500 AND text_before >= 0.25 * 10 * count(*) OVER (PARTITION BY page_id) THEN 'below' ELSE 'unknown' END AS position FROM n")
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with ten characters of text after each."""
    rows = table(spark, sf_dir, "page_images").select("image_id", "page_id").dropDuplicates(["image_id"])
    tokens = tokenize(rendered(rows, "image_id", F.concat(F.lit('<img id="'), "image_id", F.lit('" src="/x.png"><p> abc defghi </p><nav>no text</nav>'))))
    names = elements(tokens).where("tag = 'img'").select("page_id", "node", F.col("attrs")["id"].cast("bigint").alias("image_id"))
    return facets.positions(tokens).join(names, ["page_id", "node"]).select("image_id", "text_before", "images_before", "position")


@query(rf"""WITH {_P} SELECT page_id, 'meta' AS tag, -20::INT AS weight FROM p WHERE html LIKE '%<meta charset%' UNION ALL SELECT page_id, 'title', 10 FROM p WHERE html LIKE '%<title>%' UNION ALL SELECT page_id, 'meta', 100 FROM p WHERE html LIKE '%<meta name%'""")
def head_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.head_elements(page_tokens(spark, sf_dir)).select("page_id", "tag", F.col("weight").cast("int").alias("weight"))


@query(f"WITH {_R}, s AS (SELECT page_id, unnest(scripts) AS s FROM r) SELECT page_id, count(*) AS n FROM s WHERE s.src IS NOT NULL AND coalesce(lower(s.type), '') <> 'module' GROUP BY page_id")
def head_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _resource_pages(spark, sf_dir, "scripts", lambda x: F.concat(F.lit("<script"), opt("src", x["src"]), opt("type", x["type"]), F.lit("></script>")), head=True)
    return facets.head_issues(tokenize(made)).where("rule = 'render-blocking-script'").groupBy("page_id").agg(F.count("*").alias("n"))


# ---- forms


def _form_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("bigint").alias("page_id"), "c_custkey", "c_name", "c_mktsegment")
    key = F.col("c_custkey").cast("string")
    html = F.concat(F.lit('<form method="POST" action="/k/'), key, F.lit('" id="f'), key, F.lit('"><label for="n'), key, F.lit('">Name <b>'), esc("c_name"), F.lit('</b></label><input id="n'), key, F.lit('" name="name" required><label>Segment <select name="seg"><option>A</option></select></label><input type="hidden" name="h" aria-label="'), esc("c_mktsegment"), F.lit('"><input type=submit value="Send '), key, F.lit('"><button>Go <i>'), key, F.lit("</i></button></form>"))
    return rendered(rows, "c_custkey", html)


def _form_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their events, written once, as fields and labels are joined with forms."""
    return materialize(tokenize(_form_pages(spark, sf_dir)), "events")


_C = "c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer), f AS (SELECT *, c_nationkey::BIGINT AS page_id FROM c WHERE k <= 50)"


@query(f"WITH {_C} SELECT page_id, 'https://firma.example/k/' || c_custkey AS action, 'post' AS method, 'f' || c_custkey AS id FROM f")
def form_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.forms(tokenize(_form_pages(spark, sf_dir))).select("page_id", "action", "method", "id")


@query(f"WITH {_C} SELECT page_id, k::INT AS form, 'text' AS type, 'name' AS name, true AS required, 'Name ' || c_name AS label FROM f UNION ALL SELECT page_id, k, 'select', 'seg', false, 'Segment' FROM f UNION ALL SELECT page_id, k, 'hidden', 'h', false, c_mktsegment FROM f")
def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.fields(_form_tokens(spark, sf_dir)).select("page_id", "form", "type", "name", "required", "label")


@query(f"WITH {_C} SELECT page_id, k::INT AS form, 'Send ' || c_custkey AS button FROM f UNION ALL SELECT page_id, k, 'Go ' || c_custkey FROM f")
def form_buttons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.buttons(_form_tokens(spark, sf_dir)).select("page_id", "form", "button")


@query(f"WITH {_C} SELECT page_id, 'https://firma.example/k/' || c_custkey AS action FROM f")
def form_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facet sees every form and has no limit; its SQL states the first 50 addresses of a page."""
    return facets.first_rows(facets.form_actions(tokenize(_form_pages(spark, sf_dir))), 50, "page_id").select("page_id", "action")


# ---- code and data in pages


def _code_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_size").cast("bigint").alias("page_id"), "p_partkey", "p_name", "p_brand")
    key = F.col("p_partkey").cast("string")
    html = F.concat(F.lit("<script>var n"), key, F.lit("='</p>';</script><script src=x></script><script type=text/plain>no</script><style id=s"), key, F.lit(">.p"), key, F.lit('{color:red}</style><p onclick="a()" style="margin:'), key, F.lit('px" on="x"><a href=" JavaScript:go()">x</a>'))
    return rendered(rows, "p_partkey", html)


_PART = "t AS (SELECT p_size::BIGINT AS page_id, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k FROM part)"


@query(f"WITH {_PART} SELECT page_id, 'var n' || p_partkey || '=''</p>'';' AS text FROM t WHERE k <= 500")
def inline_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.inline_scripts(tokenize(_code_pages(spark, sf_dir))).select("page_id", "text")


@query(f"WITH {_PART} SELECT page_id, count(*)::INT AS event_handlers, count(*)::INT AS javascript_urls, count(*)::INT AS style_elements, count(*)::INT AS style_attributes FROM t GROUP BY page_id")
def inline_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.inline_code(tokenize(_code_pages(spark, sf_dir)))


@query(f"WITH {_PART} SELECT page_id, '.p' || p_partkey || '{{color:red}}' AS css, 's' || p_partkey AS id FROM t WHERE k <= 200")
def style_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.style_blocks(tokenize(_code_pages(spark, sf_dir))).select("page_id", "css", "id")


@query(f"WITH {_PART} SELECT page_id, 'margin:' || p_partkey || 'px' AS css, 'p' AS element FROM t WHERE k <= 2000")
def style_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.style_attributes(tokenize(_code_pages(spark, sf_dir))).select("page_id", "css", "element")


SQL["style_blocks"] = SQL["style_blocks"].replace("{{", "{").replace("}}", "}")


def _data_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 1000).alias("page_id"), "o_orderkey", "o_orderstatus", (F.row_number().over(facets.Window.partitionBy(F.col("o_orderkey") % 1000).orderBy("o_orderkey"))).alias("k"))
    body = F.when(F.col("k") % 3 == 0, F.lit('{"broken":,}')).otherwise(F.concat(F.lit('{"@context":"c","@graph":[{"@type":"Order","n":'), F.col("o_orderkey").cast("string"), F.lit('},[{"@type":"X"}],5]}')))
    return rendered(rows, "o_orderkey", F.concat(F.lit('<script type="Application/LD+JSON; charset=utf-8"><!-- '), body, F.lit(" --></script>")))


_O = "o AS (SELECT o_orderkey % 1000 AS page_id, o_orderkey, row_number() OVER (PARTITION BY o_orderkey % 1000 ORDER BY o_orderkey) AS k FROM orders)"


@query(f"""WITH {_O} SELECT page_id, '{{"@context":"c","@type":"Order","n":' || o_orderkey || '}}' AS item FROM o WHERE k <= 50 AND k % 3 <> 0 UNION ALL SELECT page_id, '{{"@context":"c","@type":"X"}}' FROM o WHERE k <= 50 AND k % 3 <> 0""")
def jsonld_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonld.structured_data(tokenize(_data_pages(spark, sf_dir))).where("kind = 'item'").select("page_id", "item")


@query(f"WITH {_O} SELECT page_id, (k - 1)::INT AS place FROM o WHERE k <= 50 AND k % 3 = 0")
def jsonld_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonld.structured_data(tokenize(_data_pages(spark, sf_dir))).where("kind = 'invalid'").select("page_id", "place")


_ESCAPED = """length(replace(replace(replace(replace(replace(x, '&', '&amp;'), '"', '&quot;'), '''', '&#39;'), '<', '&lt;'), '>', '&gt;'))"""
_X = "e AS (SELECT event_id AS page_id, props || '<a b=''c''>&\"' AS x FROM events)"


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with all characters that are escaped."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("page_id"), F.concat("props", F.lit("<a b='c'>&\"")).alias("props"), F.lit(0).alias("o"))


@query(f"WITH {_X} SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'astro' WHEN 1 THEN 'next-pages' WHEN 2 THEN 'nuxt' ELSE 'angular' END AS framework, CASE page_id % 4 WHEN 0 THEN {_ESCAPED} WHEN 3 THEN 0 ELSE length(x) + CASE WHEN page_id % 4 = 2 THEN length('window.__NUXT__=') ELSE 0 END END::BIGINT AS payload_bytes FROM e")
def hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _payloads(spark, sf_dir)
    k = F.col("page_id") % 4
    html = (
        F.when(k == 0, F.concat(F.lit('<astro-island component-url="/_astro/A.js?x" props="'), esc("props"), F.lit('" ssr></astro-island>'))).when(k == 1, F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), "props", F.lit("</script>")))
        .when(k == 2, F.concat(F.lit("<script>window.__NUXT__="), "props", F.lit("</script>"))).otherwise(F.lit('<app-root ng-version="17"></app-root>'))
    )
    return jsonld.hydration(tokenize(rendered(rows, "o", html)))


# ---- style sheets and colours


def _sheets(spark: SparkSession, sf_dir: str, one: bool = False) -> DataFrame:
    """A sheet for each brand, or one for all: a variable and a rule for each part."""
    rows = table(spark, sf_dir, "part").select((F.lit(1).cast("bigint") if one else F.xxhash64("p_brand")).alias("sheet_id"), "p_partkey", "p_size")
    key, size = F.col("p_partkey").cast("string"), F.lpad(F.hex(F.col("p_size")), 2, "0")
    rule = F.concat(F.lit(":root{--c"), key, F.lit(":#0000"), size, F.lit("}/* x{} */@media (min-width:1px){.p"), key, F.lit("{color:var(--c"), key, F.lit(", red)!important;font:12px/1.5 \"F"), key, F.lit('", serif}}'))
    parts = F.array_sort(F.collect_list(F.struct("p_partkey", rule.alias("h"))))
    made = rows.groupBy("sheet_id").agg(F.array_join(F.transform(parts, lambda p: p["h"]), "").alias("css"))
    return made.select("sheet_id", F.lit(0).alias("seq"), "css", F.lit("sheet").alias("origin"), F.lit(None).cast("string").alias("element"))


@query("""SELECT ':root' AS selector, '--c' || p_partkey AS property, '#0000' || lpad(printf('%X', p_size), 2, '0') AS value, 0 AS n_rules FROM part UNION ALL SELECT '.p' || p_partkey, 'color', 'var(--c' || p_partkey || ', red)', 1 FROM part UNION ALL SELECT '.p' || p_partkey, 'font', '12px/1.5 "F' || p_partkey || '", serif', 1 FROM part""")
def css_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return css.declarations(_sheets(spark, sf_dir)).select("selector", "property", "value", F.size("at_rules").alias("n_rules"))


@query("SELECT '--c' || p_partkey AS name, 1::BIGINT AS definitions, 1::BIGINT AS uses, '#0000' || lpad(printf('%x', p_size), 2, '0') AS color FROM part")
def css_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return css.variables(css.declarations(_sheets(spark, sf_dir))).select("name", "definitions", "uses", "color")


@query(SQL["css_variables"])
def css_one_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet with a variable and a rule for every part."""
    return css.variables(css.declarations(_sheets(spark, sf_dir, one=True))).select("name", "definitions", "uses", "color")


@query("SELECT '#0000' || lpad(printf('%x', p_size), 2, '0') AS color, '--c' || p_partkey AS variable, 1::INT AS rank FROM part")
def color_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return css.color_uses(css.declarations(_sheets(spark, sf_dir))).select("color", "variable", F.col("rank").cast("int").alias("rank"))


@query("""SELECT 'F' || p_partkey AS family, '"F' || p_partkey || '", serif' AS stack FROM part""")
def fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return css.fonts(css.declarations(_sheets(spark, sf_dir))).select("family", "stack")


@query("SELECT p_partkey, '#' || lpad(printf('%x', p_size), 2, '0') || lpad(printf('%x', p_partkey % 256), 2, '0') || '07' AS color FROM part")
def parse_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit("rgb("), F.col("p_size").cast("string"), F.lit(" "), (F.col("p_partkey") % 256).cast("string"), F.lit(" 7 / 50%)"))
    return table(spark, sf_dir, "part").select("p_partkey", colors.to_hex(colors.parse_color(value)).alias("color"))


@query("SELECT p_partkey, unnest(['#0000' || lpad(printf('%x', p_size), 2, '0'), 'RED', 'rgb(1,2,3)']) AS token FROM part")
def colors_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit("1px solid #0000"), F.lpad(F.lower(F.hex("p_size")), 2, "0"), F.lit(" RED url(x) transparent rgb(1,2,3) inherit"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(colors.colors_in(value)).alias("token"))


# ---- cleaning and Markdown


def _cleaned(spark: SparkSession, sf_dir: str, **what) -> DataFrame:
    return clean.clean_pages(pages(spark, sf_dir), **what).select("page_id", F.md5("html").alias("digest"))


@query(rf"WITH {_P} SELECT page_id, md5(html) AS digest FROM p")
def clean_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir)


@query(rf"WITH {_P} SELECT page_id, md5(regexp_replace(html, '<meta[^>]*>', '', 'g')) AS digest FROM p")
def clean_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, meta=True)


@query(rf"WITH {_P} SELECT page_id, md5(replace(html, chr(173), '')) AS digest FROM p")
def clean_hyphenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, hyphenation=True)


def _dirty_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages with things put in before the article that cleaning takes out."""
    more = '<script>var a="<b>";</script><style>b{}</style><!-- c --><div class="klaro"><p>x</p></div><div aria-hidden="true">y</div><picture><img src="z"></picture><x:y>n</x:y>'
    return pages(spark, sf_dir).select("page_id", "url", F.replace("html", F.lit("<article>"), F.lit(more + "<article>")).alias("html"))


@query(rf"WITH {_P} SELECT page_id, md5(html) AS digest FROM p")
def clean_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = clean.clean_pages(_dirty_pages(spark, sf_dir), scripts=True, styles=True, comments=True, consent=True, aria_hidden=True, images=True)
    return made.select("page_id", F.md5("html").alias("digest"))


@query(rf"WITH {_P} SELECT page_id, md5(regexp_replace(html, '<a href=\"[^\"]+\">([^<]*)</a>', '\1', 'g')) AS digest FROM p")
def clean_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, links=())


@query(rf"WITH {_P}, h AS (SELECT page_id, {_clean(_decode(_H1))} AS h FROM p) SELECT page_id, '# ' || h AS heading FROM h WHERE h <> ''")
def markdown_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = markdown.markdown(pages(spark, sf_dir))
    return made.select("page_id", text.clean_text(F.regexp_extract("markdown", "(?m)^(# .*)$", 1)).alias("heading")).where("heading <> ''")


# ---- records, functions in SQL and the rest


@query(rf"WITH {_P} SELECT page_id, url, len(list_distinct(list_filter(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1), lambda x: x <> ''))) AS n_links, nullif({_clean(_decode(_H1))}, '') AS heading, 1::INT AS h1 FROM p WHERE html LIKE '%<h1>%'")
def result_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facets asked for in one row for each page."""
    made = record.parse_pages(pages(spark, sf_dir), "links", "meta", "headings", "heading_counts", "text", "structured_data", "forms", "fields", "hydration")
    return made.select("page_id", "url", F.coalesce(F.size("links"), F.lit(0)).cast("bigint").alias("n_links"), F.try_element_at("headings", F.lit(1))["text"].alias("heading"), F.element_at("heading_counts", 1).alias("h1"))


@query(rf"WITH {_P}, t AS (SELECT page_id, {_VISIBLE} AS content FROM p) SELECT page_id, length(content) < 200 AS app_shell FROM t")
def app_shell_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.visible_text(page_tokens(spark, sf_dir)).select("page_id", (F.col("length") < 200).alias("app_shell"))


@query(rf"WITH {_L} SELECT {_site(_HOST('url'))} AS site, count(*) AS n, count_if(regexp_matches(regexp_replace(url, '[?#].*$', ''), '(?i)\.(?:{_EXT})$')) AS n_resources FROM l WHERE url LIKE 'http%' GROUP BY 1")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered functions inside SQL."""
    register.register(spark)
    return spark.sql("SELECT site_of(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS site, count(*) AS n, count_if(is_resource(url)) AS n_resources FROM {links} WHERE url LIKE 'http%' AND special_protocol(url) IS NULL GROUP BY 1", links=_stored_links(spark, sf_dir))


@query("SELECT p_partkey, p_partkey % 5 = 0 OR p_partkey % 5 = 1 OR p_partkey % 5 = 2 AS hides FROM part")
def hides_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select((F.col("p_size")).cast("bigint").alias("page_id"), "p_partkey")
    k = F.col("p_partkey") % 5
    mark = F.when(k == 0, ' hidden').when(k == 1, ' aria-hidden="true"').when(k == 2, ' style="a:b;visibility:hidden"').when(k == 3, ' aria-hidden="true" role="main"').otherwise("")
    nodes = elements(tokenize(rendered(rows, "p_partkey", F.concat(F.lit('<div id="'), "p_partkey", F.lit('"'), mark, F.lit("></div>"))))).where("tag = 'div'")
    return nodes.select(F.col("attrs")["id"].cast("bigint").alias("p_partkey"), facets.hides_content(F.col("tag"), F.col("attrs")).alias("hides"))


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for each part with variables that lead to another and an import."""
    key = F.col("p_partkey").cast("string")
    text_ = F.concat(F.lit("@import url(x"), key, F.lit(".css);.q{--a:1}@media print{:root{--a:2}}:root{--a:var(--b);--b:var(--c, "), key, F.lit("px);--l:var(--l)}p{width:calc(var(--a) + var(--l, 3px))}@font-face{font-family:'F"), key, F.lit("';src:url(a);src:url(b)}@font-face{src:url(c)}"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sheet_id"), F.lit(0).alias("seq"), text_.alias("css"), F.lit("s").alias("origin"), F.lit(None).cast("string").alias("element"))


@query("SELECT p_partkey AS sheet_id, unnest(['--a', '--b', '--l']) AS name, unnest(['var(--b)', 'var(--c, ' || p_partkey || 'px)', 'var(--l)']) AS value FROM part")
def root_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return css.root_values(css.declarations(_chains(spark, sf_dir)))


@query("SELECT p_partkey AS sheet_id, 'calc(' || p_partkey || 'px + )' AS resolved FROM part")
def resolve_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    decls = css.declarations(_chains(spark, sf_dir))
    return css.resolve(decls.where("property = 'width'"), css.root_values(decls)).select("sheet_id", "resolved")


@query("SELECT p_partkey AS sheet_id, 'x' || p_partkey || '.css' AS import FROM part")
def css_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return css.imports(_chains(spark, sf_dir)).select("sheet_id", "import")


@query("SELECT p_partkey AS sheet_id, 'F' || p_partkey AS family, 'url(b)' AS src FROM part")
def font_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return css.font_faces(css.declarations(_chains(spark, sf_dir))).select("sheet_id", "family", "src")


_LIN = lambda c: f"(CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END)"
_BEND = lambda v: f"(CASE WHEN {v} > 0.008856 THEN cbrt({v}) ELSE 7.787 * {v} + 16.0 / 116 END)"


@query(f"""WITH c AS (SELECT p_partkey, {_LIN("p_size")} AS r, {_LIN("(p_partkey % 256)")} AS g, {_LIN("7")} AS b FROM part),
x AS (SELECT p_partkey, {_BEND("((r * 0.4124 + g * 0.3576 + b * 0.1805) / 0.95047)")} AS x, {_BEND("(r * 0.2126 + g * 0.7152 + b * 0.0722)")} AS y, {_BEND("((r * 0.0193 + g * 0.1192 + b * 0.9505) / 1.08883)")} AS z FROM c)
SELECT p_partkey, round(sqrt(pow(116 * y - 16, 2) + pow(500 * (x - y), 2) + pow(200 * (y - z), 2)), 3) AS distance FROM x""")
def color_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of colours to black, whose place in Lab is zero."""
    color = F.concat(F.lit("rgb("), F.concat_ws(",", "p_size", F.col("p_partkey") % 256, F.lit(7)), F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(colors.color_distance(colors.parse_color(color), colors.parse_color(F.lit("black"))), 3).alias("distance"))


@query(f"WITH {_X} SELECT page_id, 'A' AS component, (page_id % 2 = 0) AS server_rendered, {_ESCAPED}::INT AS props_bytes FROM e")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _payloads(spark, sf_dir)
    html = F.concat(F.lit('<astro-island client="load" component-url="/_astro/A?x" props="'), esc("props"), F.when(F.col("page_id") % 2 == 1, '" ssr').otherwise('"'), F.lit("></astro-island>"))
    return jsonld.islands(tokenize(rendered(rows, "o", html))).select("page_id", "component", "server_rendered", "props_bytes")


@query(rf"WITH {_P} SELECT page_id, md5(html) AS digest FROM p")
def clean_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and ids put into the stored pages go away again."""
    made = pages(spark, sf_dir).select("page_id", "url", F.replace(F.replace("html", F.lit("<article>"), F.lit('<article class="x y" id=z>')), F.lit("<ul>"), F.lit("<ul CLASS='k'>")).alias("html"))
    return clean.clean_pages(made, classes=True, ids=True).select("page_id", F.md5("html").alias("digest"))


@query(rf"WITH {_P} SELECT page_id, md5(regexp_extract(html, '(?s)(<article>.*</article>)', 1)) AS digest FROM p WHERE html LIKE '%</article>%'")
def clean_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = clean.clean_pages(pages(spark, sf_dir).where("html LIKE '%</article>%'"), context="article")
    return made.select("page_id", F.md5(F.regexp_extract("html", "(?s)(<article>.*</article>)", 1)).alias("digest"))


def queries() -> dict[str, Query]:
    from leafmill.plans import cases  # noqa: F401  (adds its queries)

    return QUERIES | nested.QUERIES


def oracle_sql() -> dict[str, str]:
    from leafmill.plans import cases  # noqa: F401

    return SQL | nested.SQL
