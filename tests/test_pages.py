"""Facets on small pages with known results."""

import pytest
from pyspark.sql import functions as F

from leafmill.functions import colors, text, urls
from leafmill.operators import clean, css, facets, forms, jsonld, markdown, selectors
from leafmill.operators.tokenizer import ENTER, TEXT, elements, events, tokenize
from leafmill.plans import catalog

URL = "https://kiosk.example/"
STALL = """<!doctype html><html lang="it"><head><title>Frutta &amp; verdura</title><meta name="description" content="Cassette di stagione."><link rel="canonical" href="/banco">
<body><h2>Oggi</h2><p><a href="https://kiosk.example">Pere</a> e <a href="mele?tipo=renette" rel=nofollow>mele renette</a>, <a name="qui">senza indirizzo</a></p>
<figure><img src=cassetta.webp alt=" La  cassetta "><img alt="niente"><a href="//mercato.example/lunedi"><img data-src="/luna.png" src="data:image/gif;base64,AAAA" alt=""></a></figure><a href="https://kiosk.example">di nuovo</a>"""


def page(spark, html, url=URL):
    return tokenize(spark.createDataFrame([(1, url, html, "extra")], "page_id bigint, url string, html string, seq string"))


def test_links(spark):
    got = [(r.link_count, r.url, r.text, r.kind, r.rel) for r in facets.links(page(spark, STALL)).orderBy("place").collect()]
    assert got == [(2, "https://kiosk.example/", "Pere", "internal", None), (1, "https://kiosk.example/mele?tipo=renette", "mele renette", "internal", "nofollow"), (1, "https://mercato.example/lunedi", "", "external", None)]


def test_images_and_meta(spark):
    tokens = page(spark, STALL)
    assert [(r.url, r.alt) for r in facets.images(tokens).orderBy("seq").collect()] == [("https://kiosk.example/cassetta.webp", "La cassetta"), ("https://kiosk.example/luna.png", "")]
    m = facets.meta(tokens).first()
    assert (m.title, m.description, m.language, m.canonical) == ("Frutta & verdura", "Cassette di stagione.", "it", "https://kiosk.example/banco")


def test_ids(spark):
    html = '<header id="top"><a name="start"></a></header><main><h2 id="team">Team</h2><p id="team">Again</p><a href="#team" name="">T</a><div name="no"></div></main>'
    assert [r.id for r in facets.ids(page(spark, html)).orderBy("seq").collect()] == ["top", "start", "team"]


def test_empty_and_odd_pages(spark):
    rows = [(1, URL, None), (2, URL, ""), (3, URL, "  "), (4, URL, "<a href=x"), (5, URL, "a < b & c"), (None, None, "<p>x</p>"), (6, URL, "<p>" + "x" * 300_000)]
    tokens = tokenize(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    for facet in (facets.links, facets.images, facets.meta, facets.headings, facets.visible_text, facets.ids, facets.scripts, facets.positions, facets.head_elements, forms.fields, forms.buttons, jsonld.structured_data, jsonld.hydration):
        facet(tokens).count()
    assert facets.visible_text(tokens).where("page_id = 6").first().length == 300_000
    assert tokenize(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_tokenizer_rules():
    tags = lambda html: [e[2] for e in events(html) if e[0] == ENTER]
    texts = lambda html: [e[4] for e in events(html) if e[0] == TEXT]
    assert texts("<p>a &amp;lt; b<script>x && '</p>'</script>") == ["a &lt; b", "x && '</p>'"]
    assert [(e[2], e[7]) for e in events("<ul><li>1<li>2<li>3</ul>") if e[0] == ENTER and e[2] == "li"] == [("li", 1), ("li", 2), ("li", 3)]
    assert texts("<pre>a\n  b</pre><p>a\n  b</p>") == ["a\n  b", "a b"]
    assert tags("<head><title>x</title><div><p>y") == ["head", "title", "div", "p"] and [e[5] for e in events("<head><title>x</title><div>") if e[2] == "div" and e[0] == ENTER] == [[]]
    assert events("</div></p>") == [] and events("<!-- <p> -->") == []


@pytest.mark.parametrize("size", [1, 3, 7, 64])
def test_chunks_of_any_size_give_the_page(spark, size):
    from leafmill.sources import bytes as raw

    body = "<title>Çörek ve şiş 🥖</title>".encode()
    rows = [(1, URL, k // size, bytearray(body[k : k + size])) for k in range(0, len(body), size)]
    whole = raw.join_chunks(spark.createDataFrame(rows + rows[:1], "page_id bigint, url string, chunk_seq int, chunk binary"))
    assert raw.decode_pages(whole).first().html == body.decode()


def test_encodings(spark):
    from leafmill.sources import bytes as raw

    latin = '<meta charset="iso-8859-1"><title>Façana</title>'
    rows = [(1, URL, bytearray(latin.encode("latin-1")), None), (2, URL, bytearray("Façana".encode("latin-1")), "text/html; charset=latin1"), (3, URL, bytearray("﻿Façana".encode()), "text/html; charset=latin1"), (4, URL, bytearray("Façana".encode()), "text/html; charset=nonsense"), (5, URL, None, None)]
    got = {r.page_id: r.html for r in raw.decode_pages(spark.createDataFrame(rows, "page_id bigint, url string, body binary, content_type string")).collect()}
    assert got == {1: latin, 2: "Façana", 3: "Façana", 4: "Façana", 5: ""}


def test_selectors(spark):
    html = '<main><section class="a b"><h2 id="x">1</h2><p>2</p><p lang="de-AT">3</p></section><section><p data-k="Foo Bar">4</p></section></main><p>5</p>'
    nodes = elements(page(spark, html))
    count = lambda s: selectors.match(nodes, s).count()
    assert [count(s) for s in ("p", "section p", "main > p", "section > p", ".a", "#x", ".a.b > h2", "p:first-of-type", "section:nth-child(2) p", "p:nth-child(odd)", "[lang|=de]", "[data-k~=Bar]", "[data-k^=foo i]", "p:not([lang], [data-k])", "h2, p", "*")] == [4, 3, 0, 3, 1, 1, 1, 3, 1, 2, 1, 1, 1, 2, 5, 8]
    for bad in ("a + b", "a ~ b", "p:last-child", "a:hover", "", "a >", "p:nth-child(x)", "[a=", "> p"):
        with pytest.raises(ValueError):
            selectors.match(nodes, bad)
    assert selectors.types("a.x > b, #c i") == {"b", "i"} and selectors.types("a, .b") is None
    assert all(selectors.steps(s) for s in selectors.CONSENT)


def test_context_and_select(spark):
    tokens = page(spark, "<h1>out</h1><article><h2>in</h2><b>x</b> y</article>")
    assert [r.text for r in facets.headings(facets.in_context(tokens, "article")).collect()] == ["in"]
    assert facets.headings(facets.in_context(tokens, ".missing")).count() == 2
    assert [(r.key, r.tag, r.text) for r in facets.select(tokens, {"k": "article"}).collect()] == [("k", "article", "inx y")]


def test_hidden_and_positions(spark):
    html = "<img src=a><p>" + "word " * 100 + "</p><div hidden><img src=b></div><p>" + "word " * 500 + "</p><img src=c><div class='swiper'><img src=d></div>"
    got = {r.node: r.position for r in facets.positions(page(spark, html)).where("tag = 'img'").collect()}
    assert list(got.values()) == ["first-screen", "hidden", "below", "unknown"]
    attrs = spark.createDataFrame([("div", {"aria-hidden": "true"}), ("main", {"aria-hidden": "true"}), ("dialog", {}), ("dialog", {"open": ""}), ("p", {"style": "Display: none"}), ("template", {}), ("p", {})], "tag string, attrs map<string,string>")
    assert [r[0] for r in attrs.select(facets.hides_content(F.col("tag"), F.col("attrs"))).collect()] == [True, False, True, False, True, True, False]


def test_visible_text(spark):
    html = "<title>no</title><nav>Start</nav><p>Websites aus Köln<br>Wir  <b>bauen</b> sie.</p><script>x</script><ul><li>a</li><li>b</li></ul> "
    assert facets.visible_text(page(spark, html)).first().content == "Start Websites aus Köln Wir bauen sie. a b"


def test_head(spark):
    html = '<head><script src="/s.js"></script><meta charset="utf-8"><link rel="preconnect" href="https://c.example"><script async src="/a.js"></script><script defer src="/d.js"></script><link rel="prefetch" href="/n"></head>'
    assert [r.weight for r in facets.head_elements(page(spark, html)).orderBy("place").collect()] == [50, -20, 20, 30, 80, 90]
    bad = '<head><meta charset="utf-8"><link rel="preload" as="font" href="/f"><link rel="canonical" href="/x"><meta name="viewport" content="user-scalable=no"><meta name="a" content=""></head>'
    assert {r.rule for r in facets.head_issues(page(spark, bad)).collect()} == {"preload-font-crossorigin", "non-absolute-canonical", "viewport-user-scalable", "empty-meta-content"}
    eight = "<head>" + '<link rel="preload" href="/x">' * 8 + "</head>"
    assert facets.head_issues(page(spark, eight)).where("rule = 'too-many-preloads'").count() == 1
    assert facets.head_issues(page(spark, eight), {"too-many-preloads": {"max": 10}}).count() == 0 and facets.head_issues(page(spark, eight), {"too-many-preloads": "off"}).count() == 0


def test_head_contents_are_neither_joined_nor_gathered(spark):
    from leafmill.plans import cases

    html = "<head><style></style><style>é{}</style><svg><title>no</title><style>p{}</style></svg><title> A  &amp; b</title><script src=x></script><noscript><p>n</noscript><base><title></title><meta charset=x></head><body><script>out</script><p>x"
    expected = [("style", None, None), ("style", 4, None)]
    assert [(r.tag, r["size"], r.text) for r in facets.head_elements(page(spark, html)).orderBy("place").collect()] == expected
    html = html.replace("<svg><title>no</title><style>p{}</style></svg>", "")
    expected += [("title", 6, "A & b"), ("script", None, None), ("noscript", 4, None), ("base", None, None), ("title", None, None), ("meta", None, None)]
    assert [(r.tag, r["size"], r.text) for r in facets.head_elements(page(spark, html)).orderBy("place").collect()] == expected
    made = cases._each_page(spark, "/root/testdata/sf0.001", "<style>", "p{}" * 20_000, "</style>", head=True)
    plan = facets.head_issues(tokenize(made.limit(5)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "collect_list" not in plan and plan.split("MapInArrow")[0].count("Join") == 0
    issues = facets.head_issues(tokenize(made))
    assert issues.where("rule = 'inline-style-size'").count() == issues.count() == made.count() == catalog.pages(spark, "/root/testdata/sf0.001").count()
    assert made.select("html").distinct().first().html == "<html><head><style>" + "p{}" * 20_000 + "</style></head><body></body></html>"


def test_events_told_by_column_tag_and_kind_are_those_of_all(spark):
    pages = spark.createDataFrame([(1, URL, STALL), (2, URL, "<head><title>a</title><link rel=x><style>p{}"), (3, URL, None), (4, URL, "<p>x<head><base href=y>")], "page_id bigint, url string, html string")
    few, names = tokenize(pages, **facets.HEAD_EVENTS), facets.HEAD_EVENTS["names"]
    every = tokenize(pages).where(facets.within("head") & F.col("kind").isin(ENTER, TEXT)).select(*names)
    by_place = lambda r: (r.page_id, r.seq)
    assert few.schema == every.schema and sorted(few.collect(), key=by_place) == sorted(every.collect(), key=by_place) and few.count() > 5
    assert sorted(facets.head_issues(few).collect()) == sorted(facets.head_issues(tokenize(pages)).collect())
    assert sorted(map(str, facets.head_elements(few).collect())) == sorted(map(str, facets.head_elements(tokenize(pages)).collect()))


def test_forms(spark):
    html = '<form><label>Wrap <select name=s><option>no</option></select></label><label for=e>Mail</label><input id=e type=EMAIL required><input type=submit value=" Go "><input name=p placeholder=" a  b " aria-label="Say"></form><input name=out>'
    got = [(r.type, r.name, r.label, r.required, r.placeholder) for r in forms.fields(page(spark, html)).orderBy("place").collect()]
    assert got == [("select", "s", "Wrap", False, None), ("email", None, "Mail", True, None), ("text", "p", "Say", False, "a b")]
    assert [r.button for r in forms.buttons(page(spark, html)).collect()] == ["Go"]


def test_form_queries_render_every_customer(spark, tmp_path):
    spark.range(60).selectExpr("id AS c_custkey", "1 AS c_nationkey", "'n' AS c_name", "'m' AS c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    tokens = tokenize(catalog._form_pages(spark, str(tmp_path)))
    assert elements(tokens).where("tag = 'form'").count() == 60 and facets.form_actions(tokens).count() == 60
    counts = {q: catalog.queries()[q](spark, str(tmp_path)).count() for q in ("form_list", "form_fields", "form_buttons", "form_actions")}
    assert counts == {"form_list": 50, "form_fields": 150, "form_buttons": 100, "form_actions": 50}


def test_structured_data():
    items, invalid = jsonld.read_blocks(['{"@context":"c","@graph":[{"@id":"1"},{"@id":"2"}]}', '[{"@type":"B"}, "x"]', '{"a":1,}', "", "<!-- {\"@type\": \"E\"} -->", '/* <![CDATA[ */ {"@type": "R"} /* ]]> */', "NaN"])
    assert [i.get("@type") for i in items] == [None, None, "B", "E", "R"] and items[1]["@context"] == "c" and [k for k, _ in invalid] == [2, 6]


def test_jsonld_queries_render_every_order(spark, tmp_path):
    spark.range(60).selectExpr("1000 * id AS o_orderkey", "'O' AS o_orderstatus").write.parquet(str(tmp_path / "orders.parquet"))
    assert elements(tokenize(catalog._data_pages(spark, str(tmp_path)))).where("tag = 'script'").count() == 60
    assert {q: catalog.queries()[q](spark, str(tmp_path)).count() for q in ("jsonld_items", "jsonld_invalid")} == {"jsonld_items": 68, "jsonld_invalid": 16}


def test_colours(spark):
    cases = {"#abc": "#aabbcc", "RED": "#ff0000", "rgb(1,2,3)": "#010203", "rgb(100% 0% 0% / 50%)": "#ff0000", "hsl(120deg 100% 50%)": "#00ff00", "hsl(0.5turn, 100%, 50%)": "#00ffff", "oklch(1 0 0)": "#ffffff", "var(--x)": None, "12px": None, "rgb(from red r g b)": None, "#12": None}
    rows = spark.createDataFrame(list(cases), "string").select("value", colors.to_hex(colors.parse_color("value")).alias("hex")).collect()
    assert {r.value: r.hex for r in rows} == cases
    assert colors.find("1px solid #fff, red url(x) transparent") == ["#fff", "red"] and len(colors.NAMED) == 148
    d = spark.createDataFrame([("#000", "#fff"), ("#123", "#123")], "a string, b string").select(colors.color_distance(colors.parse_color("a"), colors.parse_color("b")).alias("d")).collect()
    assert abs(d[0].d - 100) < 0.1 and d[1].d == 0


def test_css(spark):
    source = '@import "a.css"; a{color:red;b:url(x;y) "};" !important} @media (x){.q,.r{margin:0}} /* z{} */ :root{--a:var(--b,#f00);--b:var(--a)} p{color:var(--a)} .k{font:12px "F,G", serif}'
    found, imports = css.read(source)
    assert imports == ["a.css"] and [(p, v, s, r) for p, v, s, r, _ in found][:3] == [("color", "red", "a", []), ("b", 'url(x;y) "};"', "a", []), ("margin", "0", ".q,.r", ["@media (x)"])]
    sheet = spark.createDataFrame([(1, 0, source, "s", None), (1, 1, None, "s", None), (1, 2, "color: blue", "s", "p#x")], "sheet_id bigint, seq int, css string, origin string, element string")
    decls = css.declarations(sheet)
    assert decls.where("element = 'p#x'").first().value == "blue"
    assert css.variables(decls).where("name = '--a'").first().uses == 1
    assert css.Variables({"--a": "var(--b,1)", "--b": "var(--a)"}).put("var(--a) var(--c, x(1, 2))") == " x(1, 2)"
    assert css.fonts(decls).count() == 1


def test_clean():
    c = lambda html, **what: clean.clean(html, URL, clean.Cleaning(**what))
    html = '<div class="a" id=b style="x"><!-- c --><script>1</script><a href="https://o.example/">out</a> <a href="/in">in</a><p aria-hidden="true">h</p>so­ft&shy;</div>'
    assert c(html) == html and c("  ") == ""
    assert c(html, scripts=True, comments=True, classes=True, ids=True, styles=True, aria_hidden=True, hyphenation=True, links=("internal",)) == '<div>out <a href="/in">in</a>soft</div>'
    assert c("<p>x</p><article><b>y</b></article>z", context="article") == "<article><b>y</b></article>"
    assert c('<div id="cookie-BANNER-1">x</div>y', consent=True) == "y"


def test_markdown():
    got = markdown.to_markdown('<title>t</title><h1>A <b>b</b></h1><p>See <a href="/x">this</a> and <code>&lt;</code><img src=i.png alt=I></p><ul><li>1</li><li>2</li></ul><pre>a\n b</pre>', URL)
    assert "# A **b**" in got and "[this](https://kiosk.example/x)" in got and "`<`" in got and "![I](https://kiosk.example/i.png)" in got and "- 1\n- 2" in got and "```\na\n b\n```" in got


def test_addresses(spark):
    for written, want in {"https://Kiosk.example": "https://kiosk.example/", "/çörek": "https://kiosk.example/%C3%A7%C3%B6rek", "?tag=3": "https://kiosk.example/a/b?tag=3", "../x/./y": "https://kiosk.example/x/y", "MailTo:Banco@Kiosk.example?subject=P e R": "mailto:banco@kiosk.example?subject=P e R", "sms:7": "sms:7", "//Mercato.example:443/": "https://mercato.example/", "http://çörek.example": "http://xn--rek-1la9e.example/", "http://[x": "http://[x"}.items():
        assert urls.absolute_one(written, "https://kiosk.example/a/b") == want
    hosts = spark.createDataFrame(["www.chor.or.jp", "banco.kiosk.com.br", "posta.mercato.example", "stall"], "string")
    assert [r[0] for r in hosts.select(urls.site_of(F.col("value"))).collect()] == ["chor.or.jp", "kiosk.com.br", "mercato.example", "stall"]


def test_text_functions(spark):
    rows = spark.createDataFrame([(" a­​ 　b﻿ ",), (None,), ("",), ("x" * 20 + "\0",), ("Exif data of this file here",), ("grüße und mehr als sechzehn",), ("👩a",)], "t string")
    got = rows.select(text.clean_text(F.col("t")), text.looks_binary(F.col("t")), text.utf16_length(F.col("t"))).collect()
    assert [r[0] for r in got][:3] == ["a b", None, ""] and [r[1] for r in got] == [False, False, False, True, True, False, False] and got[-1][2] == 3


def test_streaming(spark, tmp_path):
    from leafmill.streaming import pages as streaming

    source = tmp_path / "in"
    spark.createDataFrame([(1, 1, URL, STALL), (1, 1, URL, STALL), (2, 1, URL, "<a href=/x>y</a>")], "page_id bigint, site_id bigint, url string, html string").selectExpr("*", "timestamp'2026-01-01' AS fetched_at", "timestamp'2026-01-01' AS loaded_at").write.parquet(str(source))
    stream = streaming.once(streaming.read_pages(spark, str(source)))
    streaming.link_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


@pytest.mark.parametrize("size", [1, 5, 2000])
@pytest.mark.parametrize(("codec", "declared"), [("utf-8", None), ("utf-16-be", None), ("cp1252", "text/html; charset=latin1"), ("cp1251", None)])
def test_chunks_decoded_with_state(size, codec, declared):
    from leafmill.streaming.decoding import Reading

    words = {"cp1251": "<meta charset=windows-1251>Хлеб и соль"}.get(codec, "Façana – pa i sal")
    body = (b"\xfe\xff" if codec == "utf-16-be" else b"") + (words + " x" * 1500).encode(codec)
    chunks = [(k // size, body[k : k + size], k + size >= len(body)) for k in range(0, len(body), size)]
    reading, out = Reading(), ""
    for k in range(0, len(chunks), 2):  # the second of two comes first, and again
        out += reading.read(chunks[k + 1 : k + 2], declared) + reading.read(chunks[k : k + 2], declared)
    assert out == words + " x" * 1500 and not reading.early and not reading.held


def test_once_by_names_of_rows(spark, tmp_path):
    from leafmill.core import once

    rows = [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e"), (3, "f"), (3, "f")]
    spark.createDataFrame(rows, "id bigint, v string").repartition(3).write.parquet(str(tmp_path / "t"))
    for df in (spark.read.parquet(str(tmp_path / "t")), spark.createDataFrame(rows, "id bigint, v string")):
        got = once(df, F.col("id")).collect()
        assert sorted(str(r.id) for r in got) == ["1", "2", "3", "None", "None"] and once(df.limit(0), F.col("id")).count() == 0


def test_what_stands_in_marked_elements(spark):
    html = '<i id=a></i><div class=k><p id=b><div class=k><i id=c></i></div><i id=d></i></div><i id=e></i>'
    tokens = page(spark, html)
    marked = facets.marked_inside(tokens, F.col("attrs")["class"] == "k", "in_k")
    assert {r.id for r in elements(marked).where("in_k AND tag <> 'div'").select(F.col("attrs")["id"].alias("id")).collect()} == {"b", "c", "d"}
    assert {r.id for r in elements(facets.in_context(tokens, "div > div")).where("tag = 'i'").select(F.col("attrs")["id"].alias("id")).collect()} == {"c"}
    assert elements(facets.in_context(tokens, ".none")).count() == elements(tokens).count()


def test_editor_and_columns_match_the_same(spark):
    html = '<main id=m class="a b"><p lang=de-AT>x<p data-v="Foo bar"><img alt=""><ul><li>1<li class=a>2<li>3</ul></main>'
    tokens, found = page(spark, html), events(html)
    for selector in ("p, li", "#m.a > p", "main li:nth-child(odd)", "li:not(.a)", "[lang|=de]", '[data-v~="bar"]', "[data-v^='FOO' i]", "ul li.a", "p:first-of-type", "[alt='']", "main > ul > li:nth-of-type(-n+2)"):
        assert selectors.matching(found, selector) == {r.node for r in selectors.match(elements(tokens), selector).collect()}, selector
    for wrong in ("p + p", "a:hover", ""):
        with pytest.raises(ValueError):
            selectors.matching(found, wrong)


def test_style_map_of_a_page(spark):
    none = spark.createDataFrame([], "sheet_id bigint, css string, origin string")
    tokens = page(spark, "<style>:root{--a:var(--a);--b:var(--c);--c:var(--b, 1px)}p{width:var(--b)}</style><p style='color:var(--x, teal)'>")
    made = css.style_map(css.style_sources(none, facets.style_blocks(tokens), facets.style_attributes(tokens))).first()
    assert [(c.color, c.selector, c.variable) for c in made.colors] == [("#008080", "p", "--x")] and [v.name for v in made.variables] == ["--a", "--b", "--c"]
    assert css.style_map(css.style_sources(none, facets.style_blocks(tokens).limit(0), facets.style_attributes(tokens).limit(0))).count() == 0


def test_record_with_parameters(spark):
    from leafmill.operators.record import parse_pages

    pages = spark.createDataFrame([(1, URL, STALL), (2, URL, ""), (3, None, None)], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in parse_pages(pages, "links", "images", "head_issues", "form_actions", "islands", "style_map", positions=True, select={"h": "h2"}, class_prefixes=["x"], markdown={}, hidden_rule=lambda tag, attrs, hides: tag == "figure").collect()}
    assert [i.hidden for i in got[1].images] == [True, True] and got[1].images[0].position == "first-screen" and got[1].select[0].text == "Oggi" and got[1].class_counts == {"x": 0} and got[1].markdown.startswith("## Oggi")
    assert got[2].links is None and got[3].links is None


def test_entry_without_and_with_all_queries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1 and set(entry.oracle_sql()) <= set(entry.queries())
