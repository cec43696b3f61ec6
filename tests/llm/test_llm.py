"""The training-data operators against brute force, round trips and edge cases."""

import random
import unicodedata
from collections import Counter

import numpy as np
import pytest

from leafmill.llm import heavy, leakage, mojibake, packing, residue, skeleton, subjects
from leafmill.llm.merge import add_up

# ---- 1 most frequent values


def values(spark, rows):
    return spark.createDataFrame([(f, v, 1, "x") for f, v in rows], "field string, item_value string, prefix int, h string")


@pytest.mark.parametrize("share", [0.01, 0.1])
def test_heavy_values_equal_counting(spark, share):
    rng = random.Random(5)
    rows = [("a", f"v{int(rng.paretovariate(0.7))}") for _ in range(20_000)] + [("b", f"u{rng.randrange(10**9)}") for _ in range(9000)] + [("b", "hot")] * 1000 + [("b", None)] * 500
    got = {(r.field, r.item_value): (r.item_count, r.field_total) for r in heavy.heavy_values(values(spark, rows), share, heavy.SketchShape(1024, 5)).collect()}
    want = {}
    for f in "ab":
        counts = Counter(v for g, v in rows if g == f and v is not None)
        total = sum(counts.values())
        want |= {(f, v): (n, total) for v, n in counts.items() if n >= share * total}
    assert got == want


def test_heavy_values_edges(spark):
    assert heavy.heavy_values(values(spark, [])).count() == 0
    assert heavy.heavy_values(values(spark, [("a", None), (None, "x")])).count() == 0
    tied = [("a", ""), ("a", "x"), ("a", "y" * 100_000), ("a", "x"), ("a", "")]
    assert {r.item_value[:1]: r.item_count for r in heavy.heavy_values(values(spark, tied), 0.2).collect()} == {"": 2, "x": 2, "y": 1}


def test_sketch_is_close_and_its_slack_holds(spark):
    rows = [("a", f"v{k}") for k in range(3000)] + [("a", "top")] * 700
    sketch = heavy.sketch_fields(values(spark, rows), heavy.SketchShape(512, 5))["a"]
    assert sketch.total == 3700 and len(sketch.heavy(0.1)) >= 1
    top = spark.sql("SELECT shiftrightunsigned(xxhash64('top'), 32) AS p").first().p
    assert abs(float(sketch.estimate(32, np.array([top], np.uint64))[0]) - 700) <= sketch.slack(32)


# ---- 2 look-alikes


@pytest.mark.parametrize("other", ["Ｋäｓｅ １", "Käse 1", "Кäѕе 1", "K​ä­se⁠1", "Käse 1", "Käse　1", " Käse 1", "Käse 1"])
def test_same_look(other):
    plain = "Käse1" if "⁠" in other else "Käse 1"
    assert skeleton.skeleton(other) == skeleton.skeleton(plain)


@pytest.mark.parametrize("other", ["käse 1", "Kase 1", "Käse 1!", "Kaese 1", "Käse 11", "Käse ¹", "Kaße 1"])
def test_other_look(other):
    assert skeleton.skeleton(other) != skeleton.skeleton("Käse 1")


@pytest.mark.parametrize("code", [0xE0001, 0xE0041, 0xE007F, 0xE0100, 0xE01EF])
def test_no_ink_above_the_first_planes(code):
    assert skeleton.skeleton(f"Kä{chr(code)}se 1") == skeleton.skeleton("Käse 1")


def test_skeleton_keeps_itself():
    for code in range(0x20, 0x3000):
        form = skeleton.skeleton("x" + chr(code) + "x") if unicodedata.category(chr(code)) != "Cn" else ""
        assert skeleton.skeleton(form) == form


def test_lookalike_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    forms = ["Ab c", "Аb c", "Ab​ c", "ab c", "Ａb c", "", None, "​", "ß" * 50_000]
    rows = [(rng.choice("xy"), k if k < 55 else k - 50, rng.randrange(4), rng.choice(forms), "e", "e") for k in range(60)]
    df = spark.createDataFrame(rows, "field string, rec_id bigint, page_id bigint, text string, skeleton string, lo string")
    got = {tuple(r) for r in skeleton.lookalike_pairs(skeleton.ambiguous(df)).collect()}
    want = set()
    for a in rows:
        for b in rows:
            if a[:1] == b[:1] and a[2] == b[2] and a[1] < b[1] and a[3] != b[3] and skeleton.skeleton(a[3]) and skeleton.skeleton(a[3]) == skeleton.skeleton(b[3]):
                want.add((a[0], a[1], b[1]))
    assert got == want and want
    assert skeleton.lookalike_pairs(skeleton.ambiguous(df.limit(0))).count() == 0


# ---- 3 residue

SITES = frozenset(("mouettepress", "palnilab"))


def verdict(text):
    kind = residue.classify(residue.message(text, SITES))
    return None if kind == "about" else "slot" if residue.slots(residue.fold(text)) else kind


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("502 Bad Gateway", "error"), ("502 Bad Gate", "error"), ("Mouettepress – Seite nicht gefunden (404)", "error"), ("ページが見つかりません | Palnilab", "error"), ("+++ 404 Not Found +++", "error"), ("Страница не найдена", "error"),
        ("Your browser does not support s…", "notice"), ("ATIVE O JAVASCRIPT PARA PROSSEGUIR (PALNILAB)", "notice"), ("Cookies and scripts must be allowed (M…", "notice"), ("Ρlеаѕе enаble Jаvаsсriрt to view this site", "notice"),
        ("Lorem ipsum dolor sit amet", "filler"), ("Velit massa velit velit – Palnilab", "filler"), ("undefined | Palnilab", "filler"), ("[object Object]", "filler"), ("Überschrift folgt", "filler"), ("TODO: write descript…", "filler"),
        ("Alles über #{page.title}", "slot"), ("{{city}", "slot"), ("%CITY%", "slot"), ("Hello %1$s, see Lamps", "slot"), ("&lt;%= h1 %&gt; | X", "slot"), ("｛｛productName｝｝", "slot"), ("[shopName] – [shopName]", "slot"), ("IHRE MÖBEL VON __STORE_LOCATION__", "slot"),
    ],
)
def test_residue(text, kind):
    assert verdict(text) == kind


@pytest.mark.parametrize(
    "text",
    ["Access denied? Ten tips for lost keys in Pallamby", "Fehler 503 verstehen und beheben: ein Leitfaden", "Null Fehler: Qualität in Bingorow", "Placeholder plants for shady corners", "Room 404, second floor", "Sample boxes: Rooms", "[Update] Prüfberichte 1121", "100 % Möbel", "Vorlagen mit ${betrag} richtig ausfüllen", "Guide: filling {{name}} in mail templates", "Template engines compared: <%= %> or {{ }}", "Where the filler words lorem ipsum come from", "JavaScript course for beginners, spring 182", "Page not found? A short history of error pages", "Untitled (Blue), oil on canvas, 1317", "Test reports 12", "Doors (NEW)", "", "Guide des tailles", "Does this site need JavaScript? Our view on plain HTML", "Does this site need JavaScript? Our view on plain HTML 2", "アクセス (NEW)", "Your browser"],
)
def test_no_residue(text):
    assert verdict(text) is None


def test_open_notices_of_any_length():
    text = "Please enable JavaScript to continue using this application and reload the page after you have changed the settings of your browser"
    assert verdict(text) == verdict(text + " " + text) == "notice"
    assert verdict("Enable JavaScript in every browser: a guide for beginners that shows each of the settings with pictures and words") is None


def test_residue_table_edges(spark):
    rows = [("f", 1, "404 Not Found", "t"), ("f", 1, "404 Not Found", "t"), ("f", 2, None, "t"), ("f", 3, "", "t"), ("f", 4, "  ", "t"), ("f", 5, "Good " * 50_000, "t"), ("f", None, "{{x}}", "t"), ("f", 6, "Lamps", "t")]
    df = spark.createDataFrame(rows, "field string, rec_id bigint, text string, template string")
    assert found_in(df) == [(0, "slot"), (1, "error")]
    assert found_in(df.limit(0)) == []


def found_in(df):
    mined = residue.mine(df, SITES)
    grown = residue.grow(mined)
    return sorted((r.rec_id or 0, r.kind) for r in residue.residue(mined, residue.judge(grown, residue.templates(grown))).collect())


@pytest.mark.parametrize("text", ["The page you are looking for could not be found", "We are down for maintenance", "La page demandée n’existe pas ou n’est plus disponible", "Dieser Inhalt ist leider nicht mehr verfügbar", "Insert your page description here"])
def test_residue_in_words_of_its_own(text):
    assert verdict(text) in ("error", "filler")


def test_prefix_tree(spark):
    """Places that vary become wildcards, whatever else stands in the table; what is cut short shares the verdict."""
    texts = [f"Alle Lampen in {p} ansehen" for p in "Ulm Bonn Trier Jena Kassel Fulda Passau Worms Speyer Hagen Siegen Celle".split()] * 2 + ["Your browser does not support scripts", "Your browser does not supp", "Your browser", "Rare words stand alone once"]
    df = spark.createDataFrame([("f", k, t, "x") for k, t in enumerate(texts)], "field string, rec_id bigint, text string, tokens string")
    grown = residue.grow(residue.mine(df, SITES))
    made = {(r.template.replace("=", ""), r.n_messages, r.n_records) for r in residue.templates(grown).collect()}
    assert ("alle lampen in <*> ansehen", 12, 24) in made and ("rare words stand alone once", 1, 1) in made
    assert found_in(df) == [(24, "notice"), (25, "notice")]


def test_slots_of_any_length():
    assert residue.slots("{{ " + "a b " * 100 + "}}") and residue.slots("${name | " + "x" * 500 + "}")


# ---- 4 garbled text

GOOD = ["Küchengeräte ab 12 Euro", "Größentabelle für Anfänger", "Übersicht und Fußböden", "Crème brûlée à Paris", "Façade près de la forêt", "Año nuevo en España", "Велосипеды от 12 рублей", "Карта проезда и Вопросы", "Προσφορές και Φυτώριο", "お問い合わせと本棚", "Förderverein in Köln", "Todays picks – a guide", "Öffnungszeiten"]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(g,) for g in GOOD * 40]
    return mojibake.fit(spark.createDataFrame(rows, "text string"))


@pytest.mark.parametrize("good", GOOD)
@pytest.mark.parametrize("wrong", ["cp1252", "latin_1", "mac_roman", "cp437", "cp850"])
def test_utf8_round_trip(model, good, wrong):
    raw = good.encode()
    bad = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in raw)
    if bad != good:
        assert mojibake.restore(bad, model) == good


def test_more_wrong_decodings(model):
    for bad, good in {"Велосипеды от 12 рублей".encode("cp1251").decode("latin_1"): "Велосипеды от 12 рублей", "Größentabelle für Anfänger".encode("latin_1").decode("cp437"): "Größentabelle für Anfänger", "KÃƒÂ¼chengerÃƒÂ¤te ab 12 Euro": "Küchengeräte ab 12 Euro", "grã¶ãÿentabelle": "größentabelle", "K&#195;&#188;chenger&#195;&#164;te": "Küchengeräte"}.items():
        assert (mojibake.restore(bad, model) or "").lower() == good.lower()


@pytest.mark.parametrize("n", [5, 12, 40, 400])
def test_texts_of_any_length_are_judged_alike(model, n):
    good = " ".join(["Größentabelle für Fußböden und Gärtnerei"] * n)
    bad = good.encode().decode("cp1252")
    assert mojibake.restore_all(bad, model) == good and mojibake.restore_all(good, model) is None
    if n < 20:
        assert mojibake.restore(bad, model) == good
    assert "".join(mojibake.stretches(bad)) == bad


def test_right_texts_stay(model):
    known = {}
    texts = [*GOOD, *(g.upper() for g in GOOD), *(g.lower() for g in GOOD), "Küchengeräte ab 1", "plain", "x"]
    mojibake.judge_all(texts, model, known)
    assert not [t for t in texts if known[t][0]]


@pytest.mark.parametrize(("bad", "good"), [("Alle BrÃ¶tchen", "Alle Brötchen"), ("GrÃ¶ÃŸentabelle", "Größentabelle")])
def test_copies_of_a_garbled_text_are_found(spark, bad, good):
    texts = [f"{g} {k}" for k in range(20) for g in GOOD] + [bad] * 400
    df = spark.createDataFrame([("f", k, t) for k, t in enumerate(texts)], "field string, rec_id bigint, text string")
    got = mojibake.garbled(df).collect()
    assert len(got) == 400 and {r.restored for r in got} == {good}


def test_whole_utf8_needs_no_improbable_pair(model):
    model = mojibake.PairModel(np.ones(mojibake.BUCKETS, np.int64), np.ones(mojibake.CHARS, np.int64), model.known)
    for bad, good in (("Alle BrÃ¶tchen", "Alle Brötchen"), ("GrÃ¶ÃŸentabelle", "Größentabelle"), ("FrÃ¼her – Übersicht", "Früher – Übersicht"), ("Br├Âtchen", "Brötchen")):
        assert mojibake.restore(bad, model, []) == good
    for text in ("ГОСТ «МИР»", "Müller – Öl", "Größe", "—école"):
        assert mojibake.restore(text, model, []) is None


def test_runs_are_maximal_segments():
    assert mojibake.runs(np.array([-1.0, 2, -1, 3, -5, 1])) == [(1, 4), (5, 6)] and mojibake.runs(np.zeros(0)) == [] and mojibake.runs(np.array([-1.0])) == []


def test_garbled_edges(spark):
    rows = [("f", k, g, "x") for k, g in enumerate(GOOD * 20)] + [("f", 900, "KÃ¼chengerÃ¤te", "x"), ("f", 900, "KÃ¼chengerÃ¤te", "x"), ("f", 901, None, "x"), ("f", 902, "", "x"), ("f", 903, "gone �", "x"), ("f", 904, " ".join(GOOD * 1000) + " KÃ¼che", "x")]
    df = spark.createDataFrame(rows, "field string, rec_id bigint, text string, restored string")
    got = {r.rec_id: r.restored for r in mojibake.garbled(df).collect()}
    assert set(got) == {900, 903, 904} and got[900] == "Küchengeräte" and got[903] is None
    assert mojibake.garbled(df.limit(0)).count() == 0


# ---- 6 packing


def test_packing_patterns():
    rng = random.Random(3)
    for _ in range(40):
        capacity = rng.randrange(1, 60)
        histogram = Counter(rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 300)))
        patterns = packing.shortest_pack_first(dict(histogram), capacity)
        placed = Counter()
        for pattern, n in patterns:
            assert sum(pattern) <= capacity and n > 0
            for length in pattern:
                placed[length] += n
        assert placed == histogram
        least = -(-sum(k * v for k, v in histogram.items()) // capacity)
        first_fit = []
        for length in sorted(histogram.elements(), reverse=True):
            for k, room in enumerate(first_fit):
                if room >= length:
                    first_fit[k] -= length
                    break
            else:
                first_fit.append(capacity - length)
        assert least <= sum(n for _, n in patterns) <= max(least, int(1.25 * len(first_fit)) + 1)


def test_pack_places_every_piece_once(spark):
    rng = random.Random(4)
    rows = [(k if k != 7 else None, rng.choice([0, 1, 2, 3, 5, 8, 20, 55]), k % 3) for k in range(400)]
    lengths = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, part int")
    got = packing.pack(lengths, [(1, 10)]).toPandas()
    assert got.groupby("container_id").n_tokens.sum().max() <= 10
    assert got.n_tokens.sum() == sum(r[1] for r in rows) and len(got) == sum(max(1, -(-r[1] // 10)) for r in rows)
    assert not got.dropna().duplicated(["doc_id", "piece"]).any()
    assert packing.pack(lengths.limit(0), [(1, 10)]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(lengths, [(1, 10), (2, 0)])


def test_pack_for_many_sizes(spark):
    rng = random.Random(9)
    lengths = spark.createDataFrame([(k, rng.randrange(0, 40), k % 2) for k in range(30)], "doc_id bigint, n_tokens bigint, part int")
    got = packing.pack(lengths, [(k, 1 + k) for k in range(1001)]).toPandas()
    full = got.groupby(["pack_id", "container_id"]).n_tokens.sum().reset_index()
    assert got.pack_id.nunique() == 1001 and (full.n_tokens <= full.pack_id + 1).all()
    assert set(got.groupby("pack_id").n_tokens.sum()) == {sum(r.n_tokens for r in lengths.collect())}
    assert packing.pack(lengths, []).count() == 0


def test_shortest_packs_come_first():
    assert sorted(packing.shortest_pack_first({7: 1, 5: 1, 3: 1}, 10)) == [((5, 3), 1), ((7,), 1)]


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world", 9), (2, None, 9), (3, "", 9), (4, "ab 12\n" * 60_000, 9)], "doc_id bigint, text string, part int")
    got = {r.doc_id: r.n_tokens for r in packing.with_tokens(df).collect()}
    encoding = packing._encoding(f"{packing.TOKENIZER_DIR}/{packing.TOKENIZER}")
    assert got[1] == len(encoding.encode_ordinary("Hello world")) and got[2] == got[3] == 0 and got[4] == len(encoding.encode_ordinary("ab 12\n" * 60_000))


# ---- 7 leaked evaluation texts


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(60)] + ["the", "of", "a"] * 8
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 5, 9, 12, 24, 40]))), "x") for k in range(25)] + [(90, None, "x"), (91, "", "x"), (92, "?!", "x"), (93, "The OF a", "x")]
    docs = []
    for k in range(120):
        parts = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        words = rng.choice(items[:25])[1].split()
        kind = k % 4
        if kind == 0:
            at = rng.randrange(len(words))
            words = words[at : at + rng.randrange(8, 13)]
        elif kind == 1:
            for _ in range(rng.randrange(0, len(words) // 5 + 2)):
                at = rng.randrange(len(words)) if words else 0
                words[at : at + rng.choice([0, 1])] = rng.choice([[], ["zzz"]])
        text = " ".join(parts[:20]) + "\n\n" + ", ".join(w.upper() for w in words) + ".\n<b>" + "</b> \\n ".join(parts[20:])
        docs.append((k, text, 1))
    docs += [(500, None, 1), (501, "", 1), (502, "w1 " * 30_000, 1), (503, docs[1][1], 1)]
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string, pos int"), spark.createDataFrame(items, "item_id bigint, text string, term string")).collect()}

    def words_of(df):
        return {r[0]: tuple(leakage.words(r[1])) for r in df.select(df.columns[0], df.text).collect()}

    number = {}
    code = lambda ws: tuple(number.setdefault(w, len(number)) for w in ws)
    d = words_of(spark.createDataFrame(docs, "doc_id bigint, text string, pos int"))
    want = set()
    for i, ws in words_of(spark.createDataFrame(items, "item_id bigint, text string, term string")).items():
        for k, dw in d.items():
            if ws and dw and k != 502:
                doc, item = np.array(code(dw)), np.array(code(ws))
                if leakage.longest_run(doc, item) >= 10 or leakage.distance_inside(doc, item) <= len(ws) // 6:
                    want.add((k, i))
    assert {g for g in got if g[0] != 502} == want and len(want) > 40


def test_words_of_markup_and_escapes():
    assert leakage.words('A<b>c</b> d\\ne\\n\\nf \\nthe x&amp;y <h2 id="q">Größe_1</h2> a<5 \\n') == "a c d e f nthe x y größe 1 a 5".split()
    assert leakage.words(None) == leakage.words("?! ") == []


def test_leaks_edges(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "x y z")], "item_id bigint, text string")
    assert leakage.leaks(docs, items.limit(0)).count() == 0 and leakage.leaks(docs.limit(0), items).count() == 0 and leakage.leaks(docs, items).count() == 0


def test_distance_and_run():
    doc = np.array([9, 1, 2, 3, 4, 5, 9, 9])
    for item, run, edits in (((1, 2, 3, 7), 3, 1), ((1, 2, 4, 5), 2, 1), ((1, 2, 8, 3), 2, 1)):
        assert leakage.longest_run(doc, np.array(item)) == run and leakage.distance_inside(doc, np.array(item)) == edits
    assert leakage.distance_inside(np.array([1]), np.array([1, 2])) == 1


def test_leaks_in_blocks_equal_leaks_at_once(spark):
    items = spark.createDataFrame([(k, " ".join(f"w{(k * 7 + j) % 40}" for j in range(5 + k % 15))) for k in range(40)], "item_id bigint, text string")
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * 3 + j) % 40}" for j in range(k))) for k in range(80)], "doc_id bigint, text string")
    whole, blocks = ({tuple(r) for r in leakage.leaks(docs, items, most).collect()} for most in (10**6, 40))
    assert whole == blocks and len(whole) > 100


# ---- 8 subjects


def corpus(seed, n):
    """Documents of two subjects with words of their own, in two languages that share the words of the code."""
    rng = random.Random(seed)
    own = {"law": "court judge verdict clause appeal", "music": "violin chord tempo melody sonata", "sport": "match medal coach relay striker", "cooking": "flour oven broth recipe yeast", "climate": "storm glacier flood ozone frost"}
    foreign = {"law": "gericht richter urteil klausel", "music": "geige akkord melodie sonate", "sport": "spiel medaille trainer staffel", "cooking": "mehl ofen brühe rezept", "climate": "sturm gletscher flut eis"}
    own, foreign = ({k: v.split() for k, v in d.items()} for d in (own, foreign))
    rows, truth, labels = [], set(), []
    for k in range(n):
        lang = "de" if k % 4 == 0 else "en"
        mine = rng.sample(sorted(own), 2 if rng.random() < 0.3 else 1)
        kinds, starts, text = [], [], ""
        for s in mine * 2:
            for kind in ("text", "code"):
                bag = foreign[s] if lang == "de" and kind == "text" else own[s]
                filler = "und der die wird nach schritt" if lang == "de" and kind == "text" else "the and step look compare each"
                cell = f"df_{rng.choice(bag)} = load('{rng.choice(bag)}')" if kind == "code" else " ".join(rng.choice(bag + filler.split()) for _ in range(12)) + " " + rng.choice(bag)
                starts.append(len(text))
                kinds.append(kind)
                text += cell + "\n\n"
        starts.append(len(text))
        kinds.append("output")
        text += "violin " * 5
        rows.append((k, text, lang if k % 7 else None, kinds, starts, "x"))
        truth |= {(k, s) for s in mine}
        if k % 5 == 1 or k % 20 == 0:
            labels += [(k, s) for s in mine]
    return rows, truth, labels


DOCS = "doc_id bigint, text string, lang string, cell_types array<string>, cell_starts array<int>, terms string"


def test_subjects_on_held_out_documents(spark):
    rows, truth, labels = corpus(1, 800)
    rows += [(1900, None, None, None, None, "x"), (1901, "", "en", [], [], "x"), (1902, "x", "en", ["output"], [0], "x"), (1903, "import os", "en", ["code"], [0], "x")]
    names = spark.createDataFrame([(1, "law"), (2, "music"), (3, None), (4, "sport"), (5, "cooking"), (6, "climate"), (7, "law")], "subject_id int, subject string")
    got = {(r.doc_id, r.subject) for r in subjects.assign(spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, "law"), (5000, "music"), (3, "none")], "doc_id bigint, subject string"), names).collect()}
    held = {k for k in range(800)} - {k for k, _ in labels}
    right = {g for g in got if g[0] in held} & truth
    assert len(right) >= 0.95 * len({t for t in truth if t[0] in held}) and len(right) >= 0.95 * len({g for g in got if g[0] in held})
    assert not {g for g in got if g[0] >= 1900}


def test_more_than_a_thousand_subjects(spark):
    rows, _, labels = corpus(2, 60)
    names = spark.createDataFrame([(k, s) for k, s in enumerate([*(f"a{k:04}" for k in range(1000)), "law"])], "subject_id int, subject string")
    got = subjects.assign(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, subject string"), names)
    assert {r.subject for r in got.collect()} == {"law"}


def test_documents_stay_whole_in_any_batch(spark):
    rows, _, labels = corpus(3, 200)
    docs, given = spark.createDataFrame(rows, DOCS).coalesce(1), spark.createDataFrame(labels, "doc_id bigint, subject string")
    names = spark.createDataFrame([(1, "law"), (2, "music")], "subject_id int, subject string")
    found = []
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found.append({tuple(r) for r in subjects.assign(docs, given, names).collect()})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] and found[0]


def test_sums_in_two_levels(spark):
    parts = spark.range(0, 100, 1, 100).selectExpr("id % 3 AS k", "id AS v")

    def run(batches):
        total = Counter()
        for b in batches:
            for k, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total[k] += v
        import pyarrow as pa

        yield pa.RecordBatch.from_pylist([{"k": k, "v": v} for k, v in total.items()], pa.schema([("k", pa.int64()), ("v", pa.int64())]))

    assert {tuple(r) for r in add_up(parts, run, ["k"], 5).collect()} == {(k, sum(range(k, 100, 3))) for k in range(3)}


def test_subjects_without_rows_or_labels(spark):
    rows, _, labels = corpus(2, 20)
    names = spark.createDataFrame([(1, "law")], "subject_id int, subject string")
    no_labels = spark.createDataFrame([], "doc_id bigint, subject string")
    docs = spark.createDataFrame(rows, DOCS)
    assert subjects.assign(docs.limit(0), spark.createDataFrame(labels, "doc_id bigint, subject string"), names).count() == 0
    assert subjects.assign(docs, no_labels, names).count() == 0
    assert subjects.assign(docs, no_labels, names.limit(0)).count() == 0
