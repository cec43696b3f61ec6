"""Queries over pages rendered from the tables so that cases come up which the stored pages do not have, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.core import FEW_ROWS, materialize, once, session_dir, table
from leafmill.functions import register, urls
from leafmill.operators import clean, css, facets, jsonld, markdown, selectors
from leafmill.operators.tokenizer import elements, tokenize
from leafmill.plans.catalog import _P, SQL, Query, esc, opt, pages, query, rendered
from leafmill.streaming import decoding
from leafmill.streaming import pages as arrivals

PAGE = "https://firma.example/a/"


def _each_page(spark: SparkSession, sf_dir: str, *html, head: bool = False, url: str = PAGE) -> DataFrame:
    """A page for every stored page with the same or similar html; ``#`` in a piece stands for the page's number.

    Only numbers are grouped: a page is one row, so its html need not be put together as in ``rendered``.
    """
    start, end = ("<html><head>", "</head><body></body></html>") if head else ("<html><body>", "</body></html>")
    whole = F.lit(f"{start}{''.join(html)}{end}")
    if "#" in "".join(html):
        whole = F.replace(whole, F.lit("#"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return pages(spark, sf_dir).select("page_id").repartition(parts, "page_id").distinct().select("page_id", F.lit(url).alias("url"), whole.alias("html"))


# ---- links, images, metadata


@query("SELECT DISTINCT page_id, unnest(['https://www.firma.example/x' || page_id, 'https://cdn.netz.example/k/a.html', 'https://cdn.netz.example/k/' || chr(35) || 'oben', 'mailto:post@firma.example']) AS url, unnest(['internal', 'external', 'external', 'special']) AS kind FROM pages")
def link_kind_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds are judged from the page, whatever a base element says."""
    rows = pages(spark, sf_dir).select("page_id", F.lit(0).alias("o"))
    html = F.concat(F.lit('<base href="https://cdn.netz.example/k/"><a href="https://www.firma.example/x'), "page_id", F.lit('">own</a><a href="a.html">other</a><a href="#oben">up</a><a href="MAILTO:Post@Firma.example">post</a>'))
    return facets.links(tokenize(rendered(rows, "o", html, head=True, url=F.lit(PAGE)))).select("page_id", "url", "kind")


@query("SELECT DISTINCT page_id, 'https://firma.example/a/s' || page_id AS url FROM pages")
def base_after_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base element after content changes nothing."""
    return facets.links(tokenize(_each_page(spark, sf_dir, '<p>x</p><base href="/basis/"><a href="s#">x</a>'))).select("page_id", "url")


@query("SELECT p_partkey, p_partkey % 2 = 1 AS resource FROM part")
def resource_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host that ends like a download is none."""
    key = F.col("p_partkey").cast("string")
    url = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("https://t"), key, F.lit(".zip"))).otherwise(F.concat(F.lit("https://t.zip/"), key, F.lit(".TAR?x=1.html#a")))
    return table(spark, sf_dir, "part").select("p_partkey", urls.is_resource(url).alias("resource"))


@query("SELECT p_partkey, unnest(['https://firma.example/a/' || p_partkey || '-1.jpg', 'https://firma.example/a/' || p_partkey || '-2.jpg', 'https://firma.example/' || p_partkey || '-3.jpg']) AS url FROM part")
def srcset_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without spaces after commas, with data addresses and repeats between them."""
    key = F.col("p_partkey").cast("string")
    srcset = F.concat(key, F.lit("-1.jpg 1x,"), key, F.lit("-2.jpg 2x,data:image/png;base64,a,b 3x, /"), key, F.lit("-3.jpg,./"), key, F.lit("-1.jpg 4x"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("page_id"), F.lit(0).alias("o"), F.concat(F.lit('<img src="data:x" data-src="b.jpg" srcset="'), srcset, F.lit('">')).alias("h"))
    return facets.images(tokenize(rendered(rows, "o", F.col("h"), url=F.lit(PAGE)))).select(F.col("page_id").alias("p_partkey"), F.explode("sources").alias("url"))


@query("WITH m AS (SELECT DISTINCT ON (meta_id) meta_id AS page_id, title FROM page_meta) SELECT page_id, ' x' || title || ' ' AS description, 'g  h' AS generator, ' a, b ' AS robots, ' last ' AS viewport, ' x' || title || ' ' AS property FROM m WHERE title IS NOT NULL")
def meta_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents stay as written; blank ones and elements without content do not count."""
    content = F.concat(F.lit(" x"), esc("title"), F.lit(" "))
    rows = once(table(spark, sf_dir, "page_meta"), F.col("meta_id")).where("title IS NOT NULL").select(F.col("meta_id").alias("page_id"), F.lit(0).alias("o"), content.alias("c"))
    html = F.concat(F.lit('<meta name="description" content="  "><meta NAME="Description" content="'), "c", F.lit('"><meta name="description" content="second"><meta property="Generator" content="g  h"><meta name="robots" content=" a"><meta name="robots" content="b "><meta name="viewport" content="first"><meta name="viewport" content=" last "><meta property="og:x"><meta property="OG:X" content="'), "c", F.lit('"><meta property="og:x" content="no">'))
    tokens = tokenize(rendered(rows, "o", html, head=True))
    property_ = facets.properties(tokens).where("name = 'og:x'").select("page_id", F.col("content").alias("property"))
    return facets.meta(tokens).join(property_, "page_id").select("page_id", "description", "generator", "robots", "viewport", "property")


@query("WITH i AS (SELECT DISTINCT ON (image_id) * FROM page_images) SELECT page_id, url, bool_and(coalesce(hidden, false)) AS hidden FROM i WHERE url <> '' AND url NOT LIKE 'data:%' GROUP BY page_id, url")
def hidden_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image address is hidden if all its images are."""
    rows = once(table(spark, sf_dir, "page_images"), F.col("image_id"))
    image = F.concat(F.lit("<img"), opt("src", F.col("url")), F.lit(">"))
    html = F.when(F.coalesce("hidden", F.lit(False)), F.concat(F.lit("<dialog>"), image, F.lit("</dialog>"))).otherwise(image)
    return facets.images(tokenize(rendered(rows, "image_id", html))).select("page_id", "url", "hidden")


@query("WITH l AS (SELECT DISTINCT ON (link_id) * FROM page_links WHERE url LIKE 'https://%') SELECT page_id, url, bool_and(link_id % 3 = 0) AS hidden FROM l GROUP BY page_id, url")
def hidden_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of one's own hides what has a class and shows what markup hides."""
    rows = once(table(spark, sf_dir, "page_links"), F.col("link_id")).where("url LIKE 'https://%'")
    mark = F.when(F.col("link_id") % 3 == 0, ' class="weg"').when(F.col("link_id") % 3 == 1, " hidden").otherwise("")
    html = F.concat(F.lit("<div"), mark, F.lit('><p><a href="'), esc("url"), F.lit('">x</a></p></div>'))
    return facets.links(tokenize(rendered(rows, "link_id", html)), rule=lambda tag, attrs, by_markup: F.coalesce(attrs["class"] == "weg", F.lit(False))).select("page_id", "url", "hidden")


@query("SELECT DISTINCT page_id, unnest(['https://firma.example/a/one.png', 'https://firma.example/a/two.png']) AS url, unnest(['first-screen', 'hidden']) AS position FROM pages")
def image_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image stands where its first occurrence stands."""
    tokens = tokenize(_each_page(spark, sf_dir, '<img src="one.png"><div hidden><img src="two.png"></div><p>', "word " * 400, '</p><img src="two.png"><img src="one.png">'))
    return facets.images(tokens, facets.positions(tokens)).select("page_id", "url", "position")


# ---- selectors


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each size of part with a box for each part."""
    rows = table(spark, sf_dir, "part").select(F.col("p_size").cast("bigint").alias("page_id"), "p_partkey")
    key = F.col("p_partkey").cast("string")
    html = F.concat(F.lit('<div id="b'), key, F.lit('" class="box k'), F.pmod("p_partkey", F.lit(5)).cast("string"), F.lit('" lang="de-AT" data-x="Alpha beta"><i class="box"></i></div>'))
    return elements(tokenize(rendered(rows, "p_partkey", html)))


_BOXES = {
    "sel_id_class": ("div#b7.box, .k3.box:not(i), i.k1", "p_partkey = 7 OR p_partkey % 5 = 3"),
    "sel_attr_words": ('[data-x~="beta"][lang|=de]', "true"),
    "sel_attr_part": ("[id*='b1'][data-x^='ALPHA' i]", "p_partkey::VARCHAR LIKE '1%'"),
    "sel_attr_has": ("div[data-x]:not([id$='0'])", "p_partkey % 10 <> 0"),
    "sel_child_class": ("div.k2 > i.box", "p_partkey % 5 = 2"),
}


def _box_query(name: str, selector: str, test: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return selectors.match(_boxes(spark, sf_dir), selector).groupBy("page_id").agg(F.count("*").alias("n"))

    run.__name__ = name
    return query(f"SELECT p_size::BIGINT AS page_id, count(*) AS n FROM part WHERE {test} GROUP BY p_size")(run)


for _name, (_selector, _test) in _BOXES.items():
    _box_query(_name, _selector, _test)


# ---- head


_HEAD = (
    '<script src="a.js"></script><script src="b.js" async></script><link rel="stylesheet" href="c.css"><meta charset="utf-8">'
    + "".join(f'<link rel="preload" as="image" href="{k}.png">' for k in range(7))
    + '<link rel="preload" as="font" href="f.woff2"><link rel="preconnect" href="https://fonts.gstatic.com"><style>' + "p{}" * 20_000 + '</style><link rel="canonical" href="/c">'
    '<meta property="og:image" content="/o.png"><meta name="viewport" content="width=device-width, user-scalable=no"><meta name="keywords" content=" "><meta name="twitter:url" content="x">'
)
_RULES = "'render-blocking-script', 'charset-not-early', 'too-many-preloads', 'preload-font-crossorigin', 'preconnect-missing-crossorigin', 'inline-style-size', 'non-absolute-canonical', 'og-image-missing-dimensions', 'viewport-user-scalable', 'empty-meta-content', 'deprecated-twitter-meta'"


def _head_case(spark: SparkSession, sf_dir: str, config: dict | None = None) -> DataFrame:
    """A page is 60 KB here and its issues are a few words, so few pages are read at once and the issues are written."""
    tokens = tokenize(_each_page(spark, sf_dir, _HEAD, head=True), **facets.HEAD_EVENTS)
    return materialize(facets.head_issues(tokens, config).select("page_id", "rule"), "head-rules", FEW_ROWS)


@query(f"SELECT DISTINCT page_id, unnest([{_RULES}]) AS rule FROM pages")
def head_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule about the head once."""
    return _head_case(spark, sf_dir)


@query("SELECT DISTINCT page_id, unnest(['too-many-preloads', 'non-absolute-canonical']) AS rule FROM pages")
def head_rules_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules turned off or with other limits."""
    keep = {"too-many-preloads": {"max": 2}}
    off = {r.strip(" '"): "off" for r in _RULES.split(",")} | keep
    del off["non-absolute-canonical"]
    return _head_case(spark, sf_dir, off)


# ---- style sheets


def _sheet(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A sheet for each part; ``#k`` stands for its key, ``#s`` for its size."""
    body = F.replace(F.replace(F.lit(text), F.lit("#k"), F.col("p_partkey").cast("string")), F.lit("#s"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("sheet_id"), F.lit(0).alias("seq"), body.alias("css"), F.lit("s").alias("origin"), F.lit(None).cast("string").alias("element"))


@query("SELECT p_partkey AS sheet_id, unnest(['--a', '--b', '--c', '--d']) AS name, p_partkey::VARCHAR AS value FROM part")
def css_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is at the root, and what is under a condition."""
    sheet = _sheet(spark, sf_dir, ".x{--a:1}*{--a:#k}@media print{:root{--b:1}}:root[dir]{--b:#k}@layer z{html{--c:1}}p, html:where(.y){--c:#k}.x{--d:#k}.html{--d:2}")
    return css.root_values(css.declarations(sheet))


@query("SELECT p_partkey AS sheet_id, unnest(['#' || lpad(printf('%x', p_size), 2, '0') || '0203', '#ff0000', '#090909', '#0000ff', '#ffffff']) AS color, unnest([0.5, 1, 0.25, 1, 1])::DOUBLE AS alpha, unnest(['--k', '--no', NULL, '--l', NULL]) AS variable, unnest(['background', 'color', 'border-top-color', 'fill', 'fill']) AS property FROM part")
def css_color_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels and alphas from variables, fallbacks, and properties that paint nothing."""
    sheet = _sheet(spark, sf_dir, ":root{--k:#s,2,3;--l:blue;--o:.5}p{background:rgba(var(--k), var(--o));color:var(--no, red);border-top-color:rgb(9 9 9 / var(--p, .25));fill:var(--l) white;stop-color:lime;-webkit-border:1px lime}@keyframes q{from{color:lime}}")
    return css.color_uses(css.declarations(sheet)).select("sheet_id", "color", "alpha", "variable", "property")


@query("SELECT p_partkey AS sheet_id, unnest(['sans-serif', 'F' || p_partkey, 'serif']) AS family, unnest(['sans-serif', '\"F' || p_partkey || '\", serif', 'serif']) AS stack, unnest([NULL, '--f', NULL]) AS variable FROM part")
def css_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic families count, keywords and key frames do not."""
    sheet = _sheet(spark, sf_dir, ':root{--f:"F#k", serif}a{font-family:sans-serif}b{font-family:var(--f)}c{font:italic 12px/1.5 serif}d{font:inherit;font-family:Unset}@keyframes x{from{font-family:K}}')
    return css.fonts(css.declarations(sheet)).select("sheet_id", "family", "stack", "variable")


@query("SELECT p_partkey AS sheet_id, unnest(['--a', '--b']) AS name, unnest([1, 0])::BIGINT AS uses, unnest([2, 1])::BIGINT AS definitions, unnest(['.x', ':root']) AS last_selector FROM part")
def css_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variable in the fallback of another is no use; definitions are listed."""
    sheet = _sheet(spark, sf_dir, ":root{--a:#k;--b:2}.x{--a:var(--b)}p{width:var(--a, var(--b))}")
    return css.variables(css.declarations(sheet)).select("sheet_id", "name", "uses", "definitions", F.element_at("defined", -1)["selector"].alias("last_selector"))


@query("SELECT DISTINCT page_id AS sheet_id, 3::INT AS n_colors, 'p' || chr(35) || 'q.r' AS element, '--b' || page_id AS variable, '#00ff00' AS variable_color, 'x.css' AS import, 'Blatt' AS font, 'Satz' AS face FROM pages")
def style_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets, style blocks and style attributes of a page as one map."""
    number = F.col("page_id").cast("string")
    rows = pages(spark, sf_dir).select("page_id", F.lit(0).alias("o"))
    html = F.concat(F.lit("<style id=s>@import 'x.css';p{font-family:Blatt, serif;color:var(--b"), number, F.lit(')}</style><p id=q class="r t" style="color:red"></p>'))
    tokens = tokenize(rendered(rows, "o", html))
    sheets = rows.select(F.col("page_id").alias("sheet_id"), F.concat(F.lit(":root{--b"), number, F.lit(":lime}i{color:#010203}@font-face{src:url(a);font-family:'Satz'}")).alias("css"), F.lit("/s.css").alias("origin"))
    made = css.style_map(css.style_sources(sheets, facets.style_blocks(tokens), facets.style_attributes(tokens)))
    variable = F.element_at("variables", 1)
    return made.select("sheet_id", F.size("colors").alias("n_colors"), F.element_at("colors", -1)["selector"].alias("element"), variable["name"].alias("variable"), variable["color"].alias("variable_color"), F.element_at("imports", 1).alias("import"), F.element_at("fonts", 1)["family"].alias("font"), F.element_at("font_faces", 1)["family"].alias("face"))


# ---- cleaning and Markdown


@query("SELECT DISTINCT page_id, '<html><body><p>a<a href=\"mailto&#58;x@y.example\">M</a>X<b>c</b>f.pdf</p></body></html>' AS html FROM pages")
def clean_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in addresses need their semicolon; links that are not kept become their text."""
    made = _each_page(spark, sf_dir, '<p>a<a href="mailto&|58;x@y.example">M</a><a href="/x?a=1&copy=2">X</a><b>c</b><a href="/f.pdf">f.pdf</a></p>').withColumn("html", F.replace("html", F.lit("&|58;"), F.lit("&#58;")))
    return clean.clean_pages(made, links=("special",)).select("page_id", "html")


@query("SELECT DISTINCT page_id, '<html><body><a href=\"/x?a=1&copy=2\">X</a>f<a href=\"https://f.zip\">z</a></body></html>' AS html FROM pages")
def clean_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to downloads become their text."""
    return clean.clean_pages(_each_page(spark, sf_dir, '<a href="/x?a=1&copy=2">X</a><a href="/f.pdf?x">f</a><a href="https://f.zip">z</a>'), resources=False).select("page_id", "html")


@query("SELECT DISTINCT page_id, '<!-- out --><main class=\"m\"><p>t<!-- in --></p></main>' AS html FROM pages")
def clean_context_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context by combinators; comments are no texts."""
    return clean.clean_pages(_each_page(spark, sf_dir, 'a<!-- out --><div><main class="m"><p>t<!-- in --></p></main>b</div><main>c</main>'), context="div > main.m:first-child").select("page_id", "html")


@query("SELECT DISTINCT page_id, '<html><head><title>t</title></head><body></body></html>' AS html FROM pages")
def clean_link_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _each_page(spark, sf_dir, '<link rel="a" href="b"><title>t</title><LINK rel=c>', head=True)
    return clean.clean_pages(made, link_tags=True).select("page_id", "html")


@query("""SELECT n_nationkey::BIGINT AS page_id, '# ' || n_name || chr(10) || chr(10) || 'See **' || n_name || '** and [more](https://firma.example/a/n' || n_nationkey || ').' || chr(10) || chr(10) || '- one' || chr(10) || '- two' || chr(10) || chr(10) || '> quoted' || chr(10) || chr(10) || '```' || chr(10) || 'a  b' || chr(10) || '```' || chr(10) || chr(10) || 'Use `x`.' AS markdown FROM nation""")
def markdown_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, emphasis, links, lists, quotes and code; what a selector excludes is left out."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("page_id"), F.lit(0).alias("o"), esc("n_name").alias("n"))
    html = F.concat(F.lit("<h1>"), "n", F.lit("</h1><p>See <b>"), "n", F.lit('</b> and <a href="n'), "page_id", F.lit('">more</a>.</p><div class="ad big"><p>buy</p></div><ul><li>one</li><li>two</li></ul><blockquote>quoted</blockquote><pre>a  b</pre><aside><p>also <i>out</i></p></aside><p>Use <code>x</code>.</p>'))
    return markdown.markdown(rendered(rows, "o", html, url=F.lit(PAGE)), exclude=("div.ad", "body > aside"))


# ---- functions and tables in SQL


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'internal' WHEN 1 THEN 'anchor' WHEN 2 THEN 'special' ELSE 'external' END AS kind, '#' || lpad(printf('%x', p_size), 2, '0') || '0a00' AS hex, 0.0::DOUBLE AS distance, p_partkey % 2 = 0 AS hides, p_partkey % 4 = 0 AS unread FROM part")
def sql_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered functions of links, colours and hidden elements inside SQL."""
    register.register(spark)
    return spark.sql(
        """SELECT p_partkey, link_kind(href, absolute_url(href, page), page) AS kind, to_hex(c) AS hex, round(color_distance(c, c), 6) AS distance, hides_content('div', a) AS hides, hidden_from_readers('div', a) AS unread
        FROM (SELECT p_partkey, 'https://firma.example/a/' AS page, CASE p_partkey % 4 WHEN 0 THEN 'b' WHEN 1 THEN '#b' WHEN 2 THEN 'tel:1' ELSE 'https://other.example/' END AS href, parse_color(concat('rgb(', p_size, ',10,0)')) AS c,
        CASE p_partkey % 4 WHEN 0 THEN map('aria-hidden', 'true') WHEN 2 THEN map('style', 'x:y;display : none') ELSE map('role', 'x') END AS a FROM {part}) q""",
        part=table(spark, sf_dir, "part"),
    )


@query("SELECT p_partkey, unnest(['color', 'margin']) AS property, unnest(['red', p_size || 'px']) AS value, unnest(['.p' || p_partkey, '.q']) AS selector FROM part")
def sql_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style sheets read by a table function."""
    register.register(spark)
    return spark.sql("SELECT p_partkey, d.property, d.value, d.selector FROM (SELECT p_partkey, concat('.p', p_partkey, '{{color:red !important}}@media x{{.q{{margin:', p_size, 'px}}}}') AS css FROM {part}) p, LATERAL read_declarations(p.css, 's') d", part=table(spark, sf_dir, "part"))


@query("SELECT p_partkey, unnest(['variable', 'color', 'color', 'font', 'import']) AS kind, unnest(['--a', '#ff0000', '#0000ff', 'K', 'i' || p_partkey || '.css']) AS name FROM part")
def sql_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    register.register(spark)
    return spark.sql("SELECT p_partkey, s.kind, s.name FROM (SELECT p_partkey, concat('@import \\'i', p_partkey, '.css\\';:root{{--a:red}}p{{color:var(--a);fill:blue;font-family:K}}') AS css FROM {part}) p, LATERAL read_styles(p.css, 's') s", part=table(spark, sf_dir, "part"))


@query("""SELECT p_partkey, unnest(['item', 'item', 'invalid']) AS kind, unnest(['{"@context":"c","n":' || p_partkey || '}', '{"m":1}', NULL]) AS item FROM part""")
def sql_structured_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    register.register(spark)
    return spark.sql("""SELECT p_partkey, d.kind, d.item FROM (SELECT p_partkey, array(concat('{{"@context":"c","@graph":[{{"n":', p_partkey, '}}]}}'), '[{{"m":1}}]', '{{', ' ') AS blocks FROM {part}) p, LATERAL read_structured_data(p.blocks) d""", part=table(spark, sf_dir, "part"))


# ---- frameworks


@query("SELECT event_id AS page_id, CASE event_id % 4 WHEN 0 THEN 'next-app' WHEN 1 THEN 'sveltekit' WHEN 2 THEN 'remix' ELSE 'nuxt' END AS framework FROM events")
def script_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("page_id"), F.lit(0).alias("o"))
    html = F.concat(F.lit("<script>"), F.when(k == 0, "(self.__next_f=self.__next_f||[]).push([0])").when(k == 1, "{__sveltekit_1a2b = {base: ''}}").when(k == 2, "window.__remixContext = {}").otherwise("window.__NUXT__={}"), F.lit("</script>"))
    return jsonld.script_frameworks(tokenize(rendered(rows, "o", html))).select("page_id", "framework")


# ---- streams


def _streamed(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``make`` does to the stored pages as a stream, run until all are read."""
    folder = f"{session_dir(spark)}/stream-{uuid4().hex[:12]}"
    source = arrivals.once(arrivals.read_pages(spark, f"{sf_dir}/pages.parque[t]"))  # a pattern, as the table may be one file
    made = make(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    made.awaitTermination()
    return spark.read.schema(make(source).schema).parquet(f"{folder}/out")


@query(rf"WITH {_P} SELECT page_id, md5(html) AS digest FROM p")
def stream_decoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a stream of chunks of 100 bytes, characters divided, decoded with state."""

    def cut(source: DataFrame) -> DataFrame:
        body = source.select("page_id", F.encode("html", "utf-8").alias("body"))
        last = F.floor((F.octet_length("body") - 1) / 100).cast("int")
        each = body.select("page_id", "body", last.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_seq"))
        return decoding.decode_stream(each.select("page_id", "chunk_seq", F.substring("body", F.col("chunk_seq") * 100 + 1, F.lit(100)).alias("chunk"), F.lit("text/html").alias("content_type"), (F.col("chunk_seq") == F.col("n")).alias("last")))

    return decoding.joined(_streamed(spark, sf_dir, cut)).select("page_id", F.md5("html").alias("digest"))


@query(rf"WITH {_P} SELECT page_id, len(regexp_extract_all(html, '<[a-zA-Z]')) AS n_elements FROM p")
def scan_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a stream, read as they arrive."""
    found = _streamed(spark, sf_dir, lambda source: elements(tokenize(source)).select("page_id", "node"))
    return found.groupBy("page_id").agg(F.count("*").alias("n_elements"))


@query(SQL["links_dedupe"])
def parse_async(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of pages that arrive as a stream."""
    folder = f"{session_dir(spark)}/stream-{uuid4().hex[:12]}"
    source = arrivals.once(arrivals.read_pages(spark, f"{sf_dir}/pages.parque[t]"))  # a pattern, as the table may be one file
    arrivals.link_stream(source, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("page_id", "url", "text", "link_count", "kind")
