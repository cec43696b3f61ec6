"""Facets of pages: one narrow table each, keyed by page, from the event table of ``tokenizer``.

Where an element stands is in its row, so these are projections, grouped aggregations within a page and, for texts that
belong to the element opened last, one window over the events of a page. Facets with a documented limit keep the first
rows in page order up to it; counts are never limited.

Cases: a page without the elements of a facet has no rows in it; nulls among attributes mean the attribute is missing,
an empty text that it has no value; equal pages with different ids stay apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import JS_WS, clean_text, js_trim, utf16_length
from leafmill.functions.urls import absolute_url, absolute_urls, is_resource, link_kind
from leafmill.operators import selectors
from leafmill.operators.tokenizer import ENTER, EXIT, TEXT, elements

# Elements whose text a visitor does not read, and those that are code.
HIDDEN_TEXT = "head noscript script style svg template title".split()
CODE = "noscript script style".split()
# Elements that start a new line.
BLOCKS = "address article aside blockquote br button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr img input label legend li main nav ol option p pre section select summary table td textarea th tr ul".split()
# Script types that browsers run.
EXECUTABLE = ["", "module", "application/ecmascript", "application/javascript", "application/x-ecmascript", "application/x-javascript", "text/ecmascript", "text/javascript", "text/javascript1.0", "text/javascript1.1", "text/javascript1.2", "text/javascript1.3", "text/javascript1.4", "text/javascript1.5", "text/jscript", "text/livescript", "text/x-ecmascript", "text/x-javascript"]
HEADINGS = [f"h{k}" for k in range(1, 7)]
LIMITS = {"headings": 200, "resources": 500, "ids": 5000, "sources": 20, "properties": 50, "selected": 200, "forms": 50, "fields": 100, "styles": 200, "style_attributes": 2000, "islands": 200, "jsonld": 50, "text": 100_000}


def _page():
    return Window.partitionBy("page_id")


def _in_order():
    return Window.partitionBy("page_id").orderBy("seq")


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def within(*tags: str) -> Column:
    """Whether the row stands inside one of the tags."""
    return F.arrays_overlap("path", F.array(*(F.lit(t) for t in tags)))


def blank(c: Column) -> Column:
    return F.coalesce(js_trim(c), F.lit("")) == ""


def first_rows(df: DataFrame, most: int, *by: str) -> DataFrame:
    """The first ``most`` rows of each group in page order."""
    w = Window.partitionBy(*by).orderBy("seq")
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def with_base(tokens: DataFrame) -> DataFrame:
    """``base`` for every event: what its address is seen from, the page's URL where no base element came before."""
    return tokens.withColumn("base", F.coalesce("base", "url"))


def hides_content(tag: Column, attrs: Column) -> Column:
    """Whether the markup itself hides an element's content."""
    return (tag == "template") | ((tag == "dialog") & attrs["open"].isNull()) | attrs["hidden"].isNotNull() | hidden_from_readers(tag, attrs) | F.coalesce(attrs["style"].rlike("(?i)display\\s*:\\s*none|visibility\\s*:\\s*hidden"), F.lit(False))


def hidden_from_readers(tag: Column, attrs: Column) -> Column:
    marked = F.coalesce(attrs["aria-hidden"] == "true", F.lit(False)) | attrs["inert"].isNotNull()
    return marked & (tag != "main") & F.coalesce(attrs["role"] != "main", F.lit(True))


def _so_far():
    return _in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def standing_in(test: Column, own: bool = True) -> Column:
    """Whether a row stands in (``own``: or is) an element that ``test`` accepts: such elements were entered before it and
    the one that ends last has not ended. Linear in the events of a page."""
    last = F.max(F.when((F.col("kind") == ENTER) & test, F.col("close"))).over(_so_far() if own else _in_order().rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(last >= F.col("seq") if own else last > F.col("seq"), F.lit(False))


def marked_inside(tokens: DataFrame, test: Column, name: str, own: bool = True) -> DataFrame:
    """``tokens`` with a column telling whether they stand in (``own``: or are) an element that ``test`` accepts."""
    return tokens.withColumn(name, standing_in(test, own))


def with_hidden(tokens: DataFrame, rule=None) -> DataFrame:
    """``hidden`` for every event; ``rule(tag, attrs, by_markup) -> Column`` may decide otherwise than the markup."""
    if rule is None:
        return tokens  # the tokenizer knows
    return marked_inside(tokens, rule(F.col("tag"), F.col("attrs"), hides_content(F.col("tag"), F.col("attrs"))), "hidden")


def in_context(tokens: DataFrame, context: str | None) -> DataFrame:
    """Events inside the elements that ``context`` matches; pages where it matches nothing stay whole."""
    if context is None:
        return tokens
    chains = [selectors.steps(s) for s in selectors.split_list(context)]
    if all(len(c) == 1 for c in chains):
        test = reduce(lambda a, b: a | b, (selectors.compound(c[0][1]) for c in chains))
        marked = tokens.withColumn("_hit", (F.col("kind") == ENTER) & test)
    else:
        hits = selectors.match(elements(tokens), context).select("page_id", "node", F.lit(True).alias("_hit"))
        marked = tokens.join(hits, ["page_id", "node"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)) & (F.col("kind") == ENTER))
    marked = marked.withColumn("_in", standing_in(F.col("_hit"))).withColumn("_any", F.max("_hit").over(_page()))
    return marked.where(~F.col("_any") | F.col("_in")).drop("_hit", "_in", "_any")


def joined_text(rows: DataFrame, *by: str) -> DataFrame:
    """Texts of each group in page order, as one."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return rows.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def opened_with_text(tokens: DataFrame, tags: list[str], accept: Column, owner: str, told: Column) -> DataFrame:
    """``(page_id, node, opened, done, words)``: what ``told`` says of each accepted element, the event at which it ends and
    the texts that belong to it, in one aggregation of narrow rows. Text goes to the element opened last, until the first
    such element ends (``owner``)."""
    mine = F.col("tag").isin(tags)
    node = F.when(mine & (F.col("kind") != TEXT), F.col("node")).when((F.col("kind") == TEXT) & ~within(*CODE), F.col(owner))
    word = F.when(F.col("kind") == TEXT, F.struct("seq", "text"))
    rows = tokens.select("page_id", node.alias("node"), F.when(mine & (F.col("kind") == ENTER) & accept, told).alias("opened"), F.when(F.col("kind") == EXIT, F.col("seq")).alias("done"), word.alias("word")).where("node IS NOT NULL")
    made = rows.groupBy("page_id", "node").agg(F.first("opened", True).alias("opened"), F.max("done").alias("done"), F.array_sort(F.collect_list("word")).alias("words"))
    return made.where("opened IS NOT NULL").withColumn("words", F.array_join(F.transform("words", lambda w: w["text"]), ""))


def links(tokens: DataFrame, kinds: list[str] | None = None, resources: bool = True, rule=None) -> DataFrame:
    """Links of a page by address: text and attributes of the first, how often, hidden if all are; most frequent first.

    ``kinds`` and ``resources`` filter before places are given; ``rule`` decides what is hidden, see ``with_hidden``.
    """
    told = F.struct("url", "base", "hidden", attr("href").alias("written"), attr("rel").alias("rel"), attr("target").alias("target"), attr("aria-label").alias("label"))
    found = opened_with_text(with_base(with_hidden(tokens, rule)), ["a"], F.coalesce(attr("href") != "", F.lit(False)), "link", told)
    made = found.select("page_id", "done", clean_text(F.col("words")).alias("text"), "opened.*").withColumn("href", absolute_url(F.col("written"), F.col("base")))
    kept = made.where(~F.col("href").contains("/cdn-cgi/l/email-protection")).select("*", link_kind(F.col("written"), F.col("href"), F.col("url")).alias("kind"), is_resource(F.col("href")).alias("resource"))
    first = F.min_by(F.struct("text", "kind", "resource", "rel", "target", "label"), "done")
    out = kept.groupBy("page_id", F.col("href").alias("address")).agg(first.alias("f"), F.count("*").cast("int").alias("link_count"), F.bool_and("hidden").alias("hidden"), F.min("done").alias("first_end"))
    out = out.select("page_id", F.col("address").alias("url"), "f.text", "f.kind", "f.resource", "link_count", "f.rel", "f.target", "f.label", "hidden", "first_end")
    if kinds:
        out = out.where(F.col("kind").isin(kinds))
    if not resources:
        out = out.where(~F.col("resource"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("link_count"), "first_end"))).drop("first_end")


def srcset_candidates(srcset: Column) -> Column:
    """The addresses of a srcset as written: what stands at the beginning and after each comma that divides candidates. A
    data address holds commas of its own and ends with its word."""
    space = f"[{JS_WS}]"
    words = F.regexp_extract_all(srcset, F.lit(f"(?:^|,){space}*(data:[^{JS_WS}]*?(?=,?(?:{space}|$))|[^,{JS_WS}]+)"), 1)
    return F.filter(words, lambda w: ~w.startswith("data:"))


def srcset_urls(srcset: Column, base: Column | None = None) -> Column:
    """Addresses of a srcset (seen from ``base`` if given), data addresses left out, each once, at most twenty."""
    found = srcset_candidates(srcset)
    return F.slice(F.array_distinct(found if base is None else absolute_urls(found, base)), 1, LIMITS["sources"])


def usable(c: Column) -> Column:
    """An address that is there and holds no data, else null."""
    return F.when((c != "") & ~c.startswith("data:"), c)


def images(tokens: DataFrame, positions: DataFrame | None = None, rule=None) -> DataFrame:
    """Images by address: what the first occurrence says, hidden if all are; null alt is missing, empty alt decorative.

    ``positions(page_id, node, position)`` adds where the first occurrence stands.
    """
    rows = with_base(with_hidden(tokens, rule))
    made = elements(rows).where(F.col("tag") == "img").withColumn("written", F.coalesce(*(usable(attr(n)) for n in ("src", "data-src", "data-lazy-src")))).where("written IS NOT NULL")
    told = made.select("page_id", "seq", "node", "base", "hidden", absolute_url(F.col("written"), F.col("base")).alias("url"), attr("alt").alias("alt"), attr("width").alias("width"), attr("height").alias("height"), attr("loading").alias("loading"), attr("srcset").alias("srcset"))
    first = F.min_by(F.struct("node", "alt", "width", "height", "loading", "srcset", "base"), "seq").alias("f")
    found = told.groupBy("page_id", "url").agg(F.min("seq").alias("seq"), first, F.bool_and("hidden").alias("hidden"))
    sources = F.when(F.col("f.srcset") != "", srcset_urls(F.col("f.srcset"), F.col("f.base")))
    out = found.select("page_id", "seq", "f.node", "url", clean_text(F.col("f.alt")).alias("alt"), "f.width", "f.height", "f.loading", F.col("f.srcset").isNotNull().alias("srcset"), sources.alias("sources"), "hidden")
    return out if positions is None else out.join(positions.select("page_id", "node", "position"), ["page_id", "node"], "left")


def scripts(tokens: DataFrame) -> DataFrame:
    rows = elements(with_base(tokens)).where(F.col("tag") == "script")
    made = rows.select("page_id", "seq", absolute_url(attr("src"), F.col("base")).alias("src"), attr("type").alias("type"), F.map_keys("attrs").alias("attributes"), within("head").alias("head"))
    return first_rows(made, LIMITS["resources"], "page_id")


def frames(tokens: DataFrame) -> DataFrame:
    rows = elements(with_base(tokens)).where((F.col("tag") == "iframe") & ~blank(attr("src")))
    return first_rows(rows.select("page_id", "seq", absolute_url(attr("src"), F.col("base")).alias("src")), LIMITS["resources"], "page_id")


def link_elements(tokens: DataFrame) -> DataFrame:
    rows = elements(with_base(tokens)).where((F.col("tag") == "link") & ~blank(attr("href")))
    return first_rows(rows.select("page_id", "seq", absolute_url(attr("href"), F.col("base")).alias("href"), F.coalesce(attr("rel"), F.lit("")).alias("rel"), attr("type").alias("type")), LIMITS["resources"], "page_id")


def media(tokens: DataFrame) -> DataFrame:
    """Addresses of audio, video, embedded objects and picture sources, each once."""
    rows = elements(with_base(tokens)).where(F.col("tag").isin("audio", "embed", "object", "source", "track", "video"))
    own = F.when(F.col("tag") == "object", attr("data")).otherwise(attr("src"))
    sources = F.when(attr("srcset") != "", srcset_candidates(attr("srcset")))
    written = F.concat(F.array(usable(own)), F.coalesce(sources, F.array().cast("array<string>")))
    each = rows.select("page_id", "base", "seq", F.posexplode(written).alias("k", "written")).where("written IS NOT NULL")
    made = each.select("page_id", F.struct("seq", "k").alias("at"), absolute_url(F.col("written"), F.col("base")).alias("src"))
    found = made.groupBy("page_id", "src").agg(F.min("at").alias("seq"))
    return first_rows(found, LIMITS["resources"], "page_id")


def titles(tokens: DataFrame) -> DataFrame:
    """The first title that is not an svg's."""
    rows = tokens.where((F.col("kind") == ENTER) & (F.col("tag") == "title") & ~within("svg")).groupBy("page_id").agg(F.min("node").alias("node"))
    texts = joined_text(tokens.where((F.col("kind") == TEXT) & (F.col("tag") == "title")), "page_id", "node")
    return rows.join(texts, ["page_id", "node"], "left").select("page_id", clean_text(F.coalesce("text", F.lit(""))).alias("title"))


def meta(tokens: DataFrame) -> DataFrame:
    """Language, description, generator, image, robots, viewport, canonical address and properties of each page."""
    rows = elements(with_base(tokens))
    tags = rows.where(F.col("tag") == "meta").withColumn("name", F.lower(F.coalesce(attr("name"), attr("property")))).withColumn("content", attr("content"))
    filled = ~blank(F.col("content"))

    def named(name: str) -> Column:
        return (F.col("name") == name) & filled

    def seq(test: Column) -> Column:
        return F.when(test, F.col("seq"))

    robots = F.array_sort(F.collect_list(F.when(named("robots"), F.struct("seq", "content"))))
    by_page = tags.groupBy("page_id").agg(
        F.min_by(F.when(named("description"), F.col("content")), seq(named("description"))).alias("description"),
        F.min_by(F.when(named("generator"), F.col("content")), seq(named("generator"))).alias("generator"),
        F.min_by(F.when(named("og:image"), F.struct("content", "base")), seq(named("og:image"))).alias("image"),
        F.nullif(F.array_join(F.transform(robots, lambda r: r["content"]), ", "), F.lit("")).alias("robots"),
        F.max_by(F.when(named("viewport"), F.col("content")), seq(named("viewport"))).alias("viewport"),
    )
    canonical = (F.col("tag") == "link") & F.array_contains(F.split(F.lower(F.coalesce(attr("rel"), F.lit(""))), f"[{JS_WS}]+"), "canonical")
    others = rows.groupBy("page_id").agg(
        F.max_by(F.struct(attr("lang").alias("v")), seq(F.col("tag") == "html")).alias("language"),
        F.max_by(F.struct(F.nullif(attr("href"), F.lit("")).alias("v"), "base"), seq(canonical)).alias("canonical"),
    )
    joined = others.join(by_page, "page_id", "left").join(titles(tokens), "page_id", "left")
    return joined.select("page_id", "title", "description", F.col("language.v").alias("language"), absolute_url(F.col("canonical.v"), F.col("canonical.base")).alias("canonical"), "robots", "viewport", "generator", absolute_url(F.col("image.content"), F.col("image.base")).alias("image"))


def properties(tokens: DataFrame) -> DataFrame:
    """Meta properties by lower-cased name, the first of each that has a content (which may be empty), at most fifty."""
    rows = elements(tokens).where((F.col("tag") == "meta") & (attr("property") != "") & attr("content").isNotNull())
    made = rows.select("page_id", "seq", F.lower(attr("property")).alias("name"), attr("content").alias("content"))
    found = made.groupBy("page_id", "name").agg(F.min_by("content", "seq").alias("content"), F.min("seq").alias("seq"))
    return first_rows(found, LIMITS["properties"], "page_id")


def headings(tokens: DataFrame, rule=None) -> DataFrame:
    told = F.struct(F.substring("tag", 2, 1).cast("int").alias("level"), "hidden")
    found = opened_with_text(with_hidden(tokens, rule), HEADINGS, F.lit(True), "heading", told)
    made = found.select("page_id", F.col("done").alias("seq"), clean_text(F.col("words")).alias("text"), "opened.*").where("text <> ''")
    return first_rows(made, LIMITS["headings"], "page_id").select("page_id", "place", "level", "text", "hidden")


def heading_counts(tokens: DataFrame) -> DataFrame:
    rows = elements(tokens)
    return rows.groupBy("page_id").agg(*(F.count_if(F.col("tag") == h).cast("int").alias(h) for h in HEADINGS))


def class_counts(tokens: DataFrame, prefixes: list[str]) -> DataFrame:
    """Elements with a class that begins with a prefix; every page has a row for every prefix."""
    classes = F.split(F.coalesce(attr("class"), F.lit("")), f"[{JS_WS}]+")
    begins = [F.exists(classes, (lambda p: lambda c: c.startswith(p))(p)) for p in prefixes]
    per = elements(tokens).groupBy("page_id").agg(*(F.count_if(b).cast("int").alias(f"c{k}") for k, b in enumerate(begins)))
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("prefix"), F.col(f"c{k}").alias("n")) for k, p in enumerate(prefixes))))
    return per.select("page_id", each.alias("e")).select("page_id", "e.prefix", "e.n")


def ids(tokens: DataFrame) -> DataFrame:
    """Targets of fragments: ids and names of anchors, each once in page order."""
    each = elements(tokens).select("page_id", "seq", F.explode(F.array(attr("id"), F.when(F.col("tag") == "a", attr("name")))).alias("id")).where("id <> ''")
    return first_rows(each.groupBy("page_id", "id").agg(F.min("seq").alias("seq")), LIMITS["ids"], "page_id")


def dangling_fragments(tokens: DataFrame) -> DataFrame:
    """Anchors that lead to no target of their page."""
    wanted = links(tokens, ["anchor"]).select("page_id", "url", F.regexp_extract("url", "#(.*)$", 1).alias("id")).where("id <> ''")
    return wanted.join(ids(tokens).select("page_id", "id"), ["page_id", "id"], "left_anti")


def visible_text(tokens: DataFrame, most: int = LIMITS["text"]) -> DataFrame:
    """Text that visitors read, elements that start a line dividing words; length of all, content up to ``most``."""
    seen = tokens.where(~within(*HIDDEN_TEXT) & ~((F.col("kind") == TEXT) & F.col("tag").isin(HIDDEN_TEXT)))
    part = F.when(F.col("kind") == TEXT, F.col("text")).when(F.col("tag").isin(BLOCKS), F.lit(" "))
    whole = joined_text(seen.select("page_id", "seq", part.alias("text")).where("text IS NOT NULL"), "page_id")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "[\\t\\n\\f\\r ]+", " "), f"^[{JS_WS}]+", ""), " $", "")
    return whole.select("page_id", text.alias("t")).select("page_id", utf16_length(F.col("t")).alias("length"), F.regexp_replace(F.substring("t", 1, most), " $", "").alias("content"))


def collected_text(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """``(page_id, node, text)``: all text inside the elements of ``found(page_id, node)``."""
    words = tokens.where((F.col("kind") == TEXT) & ~within(*HIDDEN_TEXT)).select("page_id", "seq", "text", F.explode("inside").alias("node"))
    texts = joined_text(words.join(found.select("page_id", "node"), ["page_id", "node"], "left_semi"), "page_id", "node")
    return found.select("page_id", "node").join(texts, ["page_id", "node"], "left").select("page_id", "node", clean_text(F.coalesce("text", F.lit(""))).alias("text"))


def select(tokens: DataFrame, wanted: dict[str, str], rule=None) -> DataFrame:
    """Elements by named selectors, at most 200 each: tag, attributes, text up to 2000 characters."""
    rows = with_hidden(tokens, rule)
    out = None
    for key, selector in wanted.items():
        hit = first_rows(selectors.match(elements(rows), selector), LIMITS["selected"], "page_id")
        texts = collected_text(rows, hit)
        part = hit.select("page_id", "node", "tag", "attrs", "hidden", "place").join(texts, ["page_id", "node"]).select("page_id", F.lit(key).alias("key"), "place", "tag", "attrs", F.substring("text", 1, 2000).alias("text"), "hidden")
        out = part if out is None else out.unionByName(part)
    return out


def raw_texts(tokens: DataFrame, tag: str) -> DataFrame:
    """``(page_id, node, seq, attrs, text)`` of elements whose content is one raw text."""
    here = elements(tokens).where(F.col("tag") == tag).select("page_id", "node", "seq", "attrs", within("head").alias("head"))
    texts = tokens.where((F.col("kind") == TEXT) & (F.col("tag") == tag)).select("page_id", "node", "text")
    return here.join(texts, ["page_id", "node"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def inline_scripts(tokens: DataFrame) -> DataFrame:
    kind = F.lower(js_trim(F.coalesce(attr("type"), F.lit(""))))
    rows = raw_texts(tokens, "script").where(attr("src").isNull() & kind.isin(EXECUTABLE) & ~blank(F.col("text")))
    return first_rows(rows, LIMITS["resources"], "page_id").select("page_id", "place", "text")


def inline_code(tokens: DataFrame) -> DataFrame:
    """Counts of event handlers, script addresses, style elements and style attributes."""
    script = reduce(lambda a, b: a + b, (F.coalesce(attr(n).rlike(f"(?i)^[{JS_WS}]*javascript:").cast("int"), F.lit(0)) for n in ("href", "src", "action", "formaction")))
    handlers = F.size(F.filter(F.map_keys("attrs"), lambda k: k.startswith("on") & (F.length(k) > 2)))
    return elements(tokens).groupBy("page_id").agg(F.sum(handlers).cast("int").alias("event_handlers"), F.sum(script).cast("int").alias("javascript_urls"), F.count_if(F.col("tag") == "style").cast("int").alias("style_elements"), F.count_if(~blank(attr("style"))).cast("int").alias("style_attributes"))


def form_actions(tokens: DataFrame) -> DataFrame:
    rows = elements(with_base(tokens)).select("page_id", "base", "seq", F.explode(F.array(F.when(F.col("tag") == "form", attr("action")), attr("formaction"))).alias("written")).where(~blank(F.col("written")))
    made = rows.select("page_id", "seq", absolute_url(F.col("written"), F.col("base")).alias("action"))
    return made.groupBy("page_id", "action").agg(F.min("seq").alias("seq"))


def style_blocks(tokens: DataFrame) -> DataFrame:
    rows = first_rows(raw_texts(tokens, "style"), LIMITS["styles"], "page_id")
    return rows.select("page_id", "place", F.substring("text", 1, 2_000_000).alias("css"), attr("id").alias("id"))


def element_name() -> Column:
    """An element as tag#id.class for people."""
    cls = F.try_element_at(F.filter(F.split(F.coalesce(attr("class"), F.lit("")), f"[{JS_WS}]+"), lambda c: c != ""), F.lit(1))
    named = F.concat(F.lit("#"), F.nullif(attr("id"), F.lit("")))
    return F.concat(F.col("tag"), F.coalesce(named, F.lit("")), F.coalesce(F.concat(F.lit("."), cls), F.lit("")))


def style_attributes(tokens: DataFrame) -> DataFrame:
    rows = elements(tokens).where(~blank(attr("style")))
    return first_rows(rows.select("page_id", "seq", attr("style").alias("css"), element_name().alias("element")), LIMITS["style_attributes"], "page_id")


def stylesheets(tokens: DataFrame) -> DataFrame:
    rel = F.split(F.lower(F.coalesce(attr("rel"), F.lit(""))), f"[{JS_WS}]+")
    wanted = F.array_contains(rel, "stylesheet") | (F.array_contains(rel, "preload") & F.coalesce(F.lower(attr("as")) == "style", F.lit(False)))
    rows = elements(with_base(tokens)).where((F.col("tag") == "link") & ~blank(attr("href")) & wanted)
    return rows.select("page_id", "seq", absolute_url(attr("href"), F.col("base")).alias("href")).groupBy("page_id", "href").agg(F.min("seq").alias("seq"))


# Class names of containers that are closed, of sliders and of what stays in place.
HIDDEN_CLASS = r"(?i)(?:^|[\s_-])(?:modal|drawer|offcanvas|off-canvas|popover|tooltip|sr-only|visually-hidden|screen-reader-text)(?:$|[\s_-])"
CAROUSEL = r"(?i)carousel|slider|swiper|slick|splide|glide|owl-|flickity|marquee|ticker|scroller|embla|keen-slider|snap"
FIXED = r"(?i)(?:^|[\s:_-])(?:fixed|sticky)(?:$|[\s_-])|position-fixed|is-fixed|is-sticky"
SKIPPED = "noscript script style svg template title".split()


def positions(tokens: DataFrame) -> DataFrame:
    """``(page_id, node, seq, tag, position)`` of every element: hidden, first-screen, below or unknown.

    Text before an element is a running sum over the page of trimmed, visible text outside navigation.
    """
    names = F.concat_ws(" ", attr("class"), attr("id"))
    hides = hides_content(F.col("tag"), F.col("attrs")) | F.coalesce(attr("class").rlike(HIDDEN_CLASS), F.lit(False)) | F.col("tag").isin(SKIPPED)
    length = F.when(F.col("kind") == TEXT, utf16_length(js_trim(F.regexp_replace("text", f"[{JS_WS}]+", " ")))).otherwise(0)
    rows = tokens.select("page_id", "seq", "kind", "node", "tag", "close", length.alias("_length"), hides.alias("_hides"), names.rlike(CAROUSEL).alias("_slides"), ((F.col("tag") == "header") | names.rlike(FIXED)).alias("_stays"), F.col("tag").isin("nav", "header").alias("_leads"))
    rows = rows.select("*", standing_in(F.col("_hides")).alias("_hidden"), standing_in(F.col("_slides")).alias("_carousel"), standing_in(F.col("_stays")).alias("_fixed"), standing_in(F.col("_leads")).alias("_nav"))
    rows = rows.withColumn("_n", F.when(~F.col("_hidden") & ~F.col("_nav"), F.col("_length")).otherwise(0)).withColumn("_i", F.when((F.col("kind") == ENTER) & (F.col("tag") == "img") & ~F.col("_hidden"), 1).otherwise(0))
    before = _in_order().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("text_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("images_before", F.coalesce(F.sum("_i").over(before), F.lit(0))).withColumn("total", F.sum("_n").over(_page()))
    place = (
        F.when(F.col("_hidden"), "hidden").when(F.col("_carousel"), "unknown").when((F.col("text_before") < 200) & (F.col("images_before") == 0), "first-screen")
        .when(F.col("_fixed"), "unknown").when((F.col("text_before") >= 1500) & (F.col("text_before") >= 0.25 * F.col("total")), "below").otherwise("unknown")
    )
    return elements(rows).select("page_id", "node", "seq", "tag", "text_before", "images_before", place.alias("position"))


#: What the facets of heads need of ``tokenize``.
HEAD_EVENTS = {"names": ["page_id", "seq", "kind", "node", "tag", "attrs", "text", "path"], "within": "head", "kinds": (ENTER, TEXT)}


def head_elements(tokens: DataFrame) -> DataFrame:
    """Elements of the head in page order: attributes, size of content in bytes, title text and Capo weight."""
    return _head_rows(tokens)


def _head_rows(tokens: DataFrame, **told: Column) -> DataFrame:
    """``head_elements`` with what ``told`` says over the rows of a page, in the same window.

    The content of such an element is one text, the event after its own, so it is told from the row that follows; only its
    size moves, and the text of titles.
    """
    filled = ["noscript", "script", "style", "title"]
    wanted = F.when(F.col("kind") == ENTER, F.col("tag").isin("base", "link", "meta", *filled)).otherwise((F.col("kind") == TEXT) & F.col("tag").isin(filled))
    content = F.when(F.col("kind") == TEXT, F.struct("node", F.octet_length("text").alias("size"), F.when(F.col("tag") == "title", clean_text(F.col("text"))).alias("text")))
    rows = tokens.where(wanted & within("head") & ~within("svg")).select("page_id", "seq", "kind", "node", "tag", "attrs", content.alias("content"))
    place = F.count_if(F.col("kind") == ENTER).over(_so_far()).cast("int")
    after = rows.select("*", F.lead("content").over(_in_order()).alias("after"), place.alias("place"), *(c.alias(n) for n, c in told.items()))
    made = elements(after).withColumn("content", F.when(F.col("after.node") == F.col("node"), F.col("after")))
    return made.select("page_id", "place", "tag", "attrs", "content.size", "content.text", capo_weight().alias("weight"), *told)


def capo_weight() -> Column:
    """Weight of a head element in the order browsers like; what is not known weighs 100."""
    rel = F.lower(F.coalesce(attr("rel"), F.lit("")))
    script = F.col("tag") == "script"
    has = lambda n: attr(n).isNotNull()
    return (
        F.when((F.col("tag") == "meta") & (F.lower(attr("http-equiv")) == "content-security-policy"), -30).when((F.col("tag") == "meta") & has("charset"), -20).when((F.col("tag") == "meta") & (F.lower(attr("name")) == "viewport"), -15)
        .when(F.col("tag") == "base", -10).when(F.col("tag") == "title", 10).when((F.col("tag") == "link") & (rel == "preconnect"), 20).when(script & has("src") & has("async"), 30)
        .when(F.col("tag") == "style", 60).when((F.col("tag") == "link") & (rel == "stylesheet"), 60).when(script & has("src") & (has("defer") | (F.lower(attr("type")) == "module")), 80).when(script & has("src"), 50)
        .when((F.col("tag") == "link") & rel.isin("preload", "modulepreload"), 70).when((F.col("tag") == "link") & rel.isin("prefetch", "dns-prefetch", "prerender"), 90).otherwise(100)
    )


def head_issues(tokens: DataFrame, config: dict | None = None) -> DataFrame:
    """``(page_id, rule, severity, element)``; ``config`` maps rules to "off" or to limits such as {"max": 10}."""
    config = config or {}
    limit = lambda rule, default: config[rule].get("max", default) if isinstance(config.get(rule), dict) else default
    entered = F.col("kind") == ENTER
    rel, name = F.lower(F.coalesce(attr("rel"), F.lit(""))), F.lower(F.coalesce(attr("name"), attr("property")))
    rows = _head_rows(
        tokens,
        early=F.count_if(entered & ((F.col("tag") == "link") & (rel == "stylesheet") | (F.col("tag") == "script"))).over(_so_far()),
        preloads=F.count_if(entered & (rel == "preload")).over(_so_far()),
        dims=F.max(name.isin("og:image:width", "og:image:height").cast("int")).over(_in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    ).withColumn("rel", rel)
    tests = {
        "render-blocking-script": (F.col("tag") == "script") & attr("src").isNotNull() & attr("async").isNull() & attr("defer").isNull() & (F.coalesce(F.lower(attr("type")), F.lit("")) != "module"),
        "charset-not-early": (F.col("tag") == "meta") & attr("charset").isNotNull() & (F.col("early") >= limit("charset-not-early", 3)),
        "too-many-preloads": (F.col("rel") == "preload") & (F.col("preloads") == limit("too-many-preloads", 6) + 1),
        "preload-font-crossorigin": (F.col("rel") == "preload") & (F.lower(attr("as")) == "font") & attr("crossorigin").isNull(),
        "preconnect-missing-crossorigin": (F.col("rel") == "preconnect") & F.coalesce(attr("href").contains("fonts.gstatic.com"), F.lit(False)) & attr("crossorigin").isNull(),
        "inline-style-size": (F.col("tag") == "style") & (F.col("size") > limit("inline-style-size", 51_200)),
        "non-absolute-canonical": (F.col("rel") == "canonical") & ~F.coalesce(attr("href").rlike("(?i)^https?://"), F.lit(False)),
        "og-image-missing-dimensions": (name == "og:image") & (F.coalesce(F.col("dims"), F.lit(0)) == 0),
        "viewport-user-scalable": (name == "viewport") & F.coalesce(attr("content").rlike("(?i)user-scalable\\s*=\\s*(?:no|0)"), F.lit(False)),
        "empty-meta-content": (F.col("tag") == "meta") & attr("content").isNotNull() & blank(attr("content")),
        "deprecated-twitter-meta": F.coalesce(name.isin("twitter:site:id", "twitter:creator:id", "twitter:domain", "twitter:url"), F.lit(False)),
    }
    found = F.filter(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(r)) for r, t in tests.items() if config.get(r) != "off")), lambda r: r.isNotNull())
    return rows.select("page_id", F.explode(found).alias("rule"), F.lit("warn").alias("severity"), (F.col("place") - 1).alias("element"))
