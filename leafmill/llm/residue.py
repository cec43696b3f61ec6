"""Template residue, filler, error pages and script notices among titles, descriptions and link texts.

1. Every text becomes a message: folded (compatibility forms, case, invisible characters), cut into tokens, with numbers,
   site names, runs of filler words and unresolved slots as classes. Words of the lexicon are marked (``=``), so are the
   borders of parts (``|``).
2. The messages of the corpus grow a prefix tree of fixed depth: below the root by length, then by leading tokens. A branch
   that fewer than ``SUPPORT`` records take is a wildcard from there on. In a leaf a further token stays where at least
   ``SHARE`` of the leaf's records agree on it, else it is a wildcard; lexicon words always stay. What is left is the template.
3. Each template is classified once, however many records have it, by the words it consists of and not by whole phrases:
   all its words must be such that messages of this kind consist of, and some must name the failure, the demand or the gap.
   A text that also has content (other words, wildcards) is no message.
4. Messages cut short are judged by the tree: who begins a mined message that has a verdict and has half of it shares it.
5. Verdicts go back to the records by message. Independently, slots that were never filled in are looked for inside ordinary
   records; a text that speaks about templates beside the slot keeps its examples.

The prefix tree is grown by aggregation (counts of beginnings, counts of tokens by place in a leaf), so it does not depend
on the order or the partitions of the records, and no task holds a leaf.

Cases: null, empty and blank texts are no residue (there is nothing in place of the content); a repeated row is found
once for its key; very long texts are looked through whole; an empty table gives no rows; a notice that demands scripts
or cookies in its first words may go on at any length, unless a word shows that it speaks about them (guide, ...).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.core import materialize
from leafmill.llm.skeleton import skeleton

#: Depth of the prefix tree below the length.
DEPTH = 3
#: Records that a branch of the tree needs to have a node of its own.
SUPPORT = 3
#: Tokens of a message that the tree tells apart; beyond them only lexicon words are kept.
LONGEST = 40
#: Share of a leaf's records that must agree on a token beyond the branch.
SHARE = 0.1

# Words that messages in place of content consist of, in eight languages.
# What a page or a part of it is called.
THINGS = """
page pages site website web content url link address server service file resource domain shop store app application session connection database request account browser window document post title text
headline heading subtitle description name label button caption image field section internet host gateway method access website's instance object reference variable index line value
seite seiten webseite website inhalt server dienst shop adresse sitzung verbindung datenbankverbindung domain anfrage konto titel überschrift beschreibung text dokument bild datei browser internetpräsenz name zugriff
page site serveur service contenu titre texte adresse fichier session navigateur accès demande
página sitio servidor servicio contenido título texto descripción sesión navegador acceso solicitud conexión archivo
página site servidor serviço conteúdo título texto descrição sessão navegador acesso pedido conexão arquivo
страница страницы страницу страницей сайт сайта сайте сервер сервера сервис доступ заголовок текст текста описание браузер браузере соединение запрос
σελίδα σελίδας ιστότοπος ιστοσελίδα υπηρεσία διακομιστή διακομιστής πρόσβαση τίτλος κείμενο κειμένου κείμενό περιγραφή πρόγραμμα περιήγησης
ページ サイト サーバー サービス アクセス コンテンツ タイトル テキスト 文章 本文 説明文 説明 ドキュメント ブラウザ
"""
# The parts of a page that are filled with texts.
PARTS = """
page site website content post title text headline heading subtitle description name label button caption image document link
seite webseite website inhalt titel überschrift beschreibung text dokument bild internetpräsenz internetseite
page contenu titre texte description página sitio contenido título texto descripción conteúdo descrição
страница сайт заголовок текст описание σελίδα τίτλος κείμενο κειμένου κείμενό περιγραφή ページ タイトル テキスト 文章 本文 説明文 説明 ドキュメント
"""
# Names of fields that say nothing where a text should stand.
LABELS = """
title headline heading subtitle description button caption placeholder titel überschrift beschreibung seitentitel titre título descripción descrição заголовок описание τίτλος περιγραφή タイトル ページタイトル 説明文 説明
"""
# Words that only join others.
JOINING = """
the a an this that these it its we you your our i us be been is are was were has have had do does did can could will would may might must should to of on in at for with by from and or not no if as so but there any all more longer only
please sorry oops whoops uh oh again back soon later now here yet some something what went happened looking requested try trying reload refresh return go before after while when temporarily currently unfortunately very own first moment just bit ref code info order
die der das den dem des ein eine einen diese dieser dieses diesen dieser sie ihr ihre ihren ihrem wir es ist sind war wurde wurden wird werden haben hat kann konnte können nicht kein keine und oder für von auf in im zu zur mit bitte leider später wieder hier gleich noch mehr zurück erneut wegen aufgetreten angeforderte angeforderten vorübergehend um einmal einen derzeit zurzeit uns wiederkommen versuchen
le la les l un une des de du d demandée demandé demandada solicitada solicitado pedida ce cette cet vous votre nous il elle est sont a été n pas ne et ou pour sur dans à au aux avec par veuillez désolé plus tard bientôt ici s que qui
el los las una del esta este esto que su sus tu se es está están ha han sido y o para en por con lo sentimos favor más tarde pronto aquí un de
os as um uma do da dos das seu sua é foi não na e com mais breve aqui o no
не и или на в для этот эта это эту вы ваш вам мы по к с был была было пожалуйста позже снова извините здесь сюда у нас будет
η ο το τη την τον του της οι τα δεν και ή για στο στη στην με να σας αυτός αυτή αυτό είναι ήταν παρακαλώ αργότερα ξανά εδώ
を に が は の で と も て へ して ください 下さい でした ません ました です ます この ご お ただいま 現在 申し訳ございません には する した しばらく もう一度 ここ が お探し 一時的 入り して
"""
# Words that name a failure by themselves.
FAILURES = """
error errors forbidden unauthorized unavailable denied maintenance exception nullpointerexception traceback timeout expired suspended crashed malfunction wrong stacktrace typeerror referenceerror segmentation outage failed failure reset refused exceeded parked
fehler verweigert wartungsarbeiten wartung abgelaufen fehlgeschlagen gesperrt serverfehler datenbankfehler störung unerreichbar
erreur refusé introuvable indisponible maintenance expirée expiré interdite interdit
error errores denegado mantenimiento indisponible caducado expirada prohibido
erro erros negado manutenção indisponível expirada proibido
ошибка ошибки ошибку запрещен запрещён недоступен недоступна ошибке истекла неполадки
σφάλμα σφάλματα απορρίφθηκε συντήρησης συντήρηση έληξε απαγορεύεται
エラー 拒否 メンテナンス サーバーエラー
"""
# Words that name a failure together with a negation.
DENIED = """
found available exist exists working reached loaded displayed opened accessible valid set access
gefunden verfügbar erreichbar existiert vorhanden geladen geöffnet
trouvée trouvé disponible existe accessible encontrada encontrado disponible existe encontrado disponível
найдена найден найдено доступен доступна существует βρέθηκε υπάρχει διαθέσιμη διαθέσιμο επιτρέπεται 見つかり 利用 でき 存在
"""
NEGATIONS = "not no longer isn’t can’t cannot couldn’t doesn’t wasn’t won’t nicht kein keine ne n pas plus non no não не нет нельзя δεν μη ません ませんでした"
# Words that name a failure only together.
FAILING = """
http # | too many requests | back soon | back shortly | bad gateway | bad request | timed out | moved permanently | # gone | method allowed not | domain sale | under maintenance | down maintenance | technical difficulties | we’ll back | fatal error | parse error | syntax error | stack trace | undefined variable | undefined index | most recent call last
object reference instance | method not allowed | service temporarily | ведутся работы | технические работы | εργασίες συντήρησης | εκτός λειτουργίας
"""
# Words that begin the report of a program, which goes on with names of its own.
REPORTS = """
nullpointerexception | fatal error | undefined variable | undefined index | parse error | uncaught | traceback most recent call | stack trace | segmentation fault | exception in thread
"""
# What a notice speaks of, and what it demands or says of it.
TOPICS = "javascript js scripts script skripte cookies cookie javascriptを cookieを scripts"
DEMANDS = """
enable enabled activate need needs require requires required disabled deactivated allow allowed turn turned switch switched support supports supported accept block blocked blocks blocker
aktivieren aktiviert benötigt benötigen deaktiviert erlaubt erlauben unterstützt akzeptieren einschalten eingeschaltet erforderlich
activer activez activé nécessite désactivé désactivés autoriser autorisez acceptez requis
requiere active activar activa habilite habilitar desactivado desactivadas necesita permitir aceptar
ative ativar requer desativado permitir aceitar necessita
включите включить нужен нужны требуется требует отключен отключён отключены разрешите
ενεργοποιήστε ενεργοποίηση απαιτεί απαιτείται απενεργοποιημένη απενεργοποιημένα επιτρέψτε
有効 必要 無効 許可
"""
USES = """
view run use using continue experience full best see display function functions properly work works loading nothing happens ad off prosseguir continuar continuer fortzufahren fortfahren anzeigen nutzen ansehen afficher ver visualizar продолжить просмотра работы συνεχίσετε 表示 利用
settings able load order to javascript-enabled older adblocker disable ihnen damit nutzung
"""
# Words that are a notice only together.
WAITING = """
loading please wait | please wait | just moment | checking browser | verify human | are robot | attention required | bitte warten | wird geladen | einen moment | chargement cours | loading | cargando | carregando | загрузка | φόρτωση | 読み込み中
"""
MORE_WAITING = "loading wait checking verify human robot attention warten geladen moment chargement cours cargando carregando загрузка φόρτωση 読み込み中 accessing verifying"
# Words that fill a gap by themselves.
FILLING = """
untitled undefined placeholder placeholders dummy lorem todo tbd tba nan null xxx xxxx asdf qwerty foo bar baz blah n/a
unbenannt unbenannte unbenanntes platzhalter platzhaltertext blindtext mustertext beispieltext beispieltitel beispielseite musterseite testseite testtext standardbeschreibung
无题 無題 サンプル ダミーテキスト ダミー テスト 準備中 工事中 テストページ
"""
# Words that fill a gap beside the name of a part.
OFFERING = """
here goes your insert enter add new sample example test default missing no edit replace change write click me launch until own without my
hier ihr ihre neue neuer neues eingeben einfügen ergänzen folgt kein ohne steht ihren
votre ici insérer insérez ajoutez nouvelle nouveau sans venir exemple d’exemple test
su tu aquí insertar inserte añade añadir nuevo nueva sin ejemplo prueba
seu aqui insira inserir novo nova sem exemplo teste
без новая новый ваш здесь введите вставьте сюда пример примера тестовая тест рыба заглушка
χωρίς νέα νέος σας εδώ εισαγάγετε εισάγετε προσθέστε δείγμα δοκιμαστική
ここ 入力 新しい
"""
# Words that fill a gap only together, or alone.
GAPS = """
coming soon | under construction | im aufbau | in bearbeitung | hier entsteht | en construction | en construcción | em construção | bientôt disponible | em breve | в разработке | υπό κατασκευή | próximamente | hello world | just another site | welcome my site | object object | abc abc | test test | testing | nan | none none | true | false | function | inhalt folgt | text folgt | texte venir | no title | new page | new post | click edit | my site | my website | sample page | example page | test page | test | tests | todo | тест | δοκιμή | null | none | my website | site name | site title
"""
MORE_GAPS = "coming soon under construction aufbau bearbeitung entsteht construcción construção bientôt disponible breve разработке υπό κατασκευή próximamente hello world just another wordpress welcome none true false function testing abc meta home lorem ipsum platzhalter für description"
# The words of the usual Latin filler text.
LOREM = "lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum nunc neque congue massa ligula porta varius risus vestibulum vivamus mauris pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas vitae augue nec tellus orci eget felis tincidunt donec quam semper sapien lacus sagittis ultrices posuere cubilia curae maecenas faucibus interdum phasellus suspendisse".split()
_LOREM_SURE = set("lorem ipsum dolor amet consectetur consectetuer adipiscing elit eiusmod incididunt nunc neque congue ligula varius risus vestibulum vivamus mauris pellentesque tincidunt velit nulla tempor massa porta sit".split())
# Names that template variables usually have.
NAMES = "title name city town brand category description headline heading company product price text label item link url page site shop store user customer firstname lastname subject keyword keywords body content summary author date year tag tags location country region street phone email slug h1 h2 metadescription seotitle pagetitle sitename shopname productname".split()
# Words by which a text with a slot shows that it speaks about templates.
ABOUT = set("template templates vorlage vorlagen placeholders platzhaltern plantillas plantilla modèles gabarits шаблоны шаблон шаблонов πρότυπα テンプレート".split())
# Words by which a text that begins like an open notice shows that it speaks about its subject.
SPEAKS = set("guide guides tutorial tutorials explained beginners leitfaden ratgeber anfänger tutoriel principiantes guía guia руководство οδηγός".split())
# Words that begin a question.
ASKS = set("does do is are why how what which when should braucht warum wie wann wieso pourquoi comment est cómo por-qué como зачем почему как γιατί πώς".split())

_ID = r"[^\W\d]\w*(?:[.\-][^\W\d]\w*)*"
_KEY = rf"(?:{_ID}|\d{{1,2}})"
#: Slots by their marks alone: nothing else writes these.
_MARKED = re.compile(
    rf"\{{\{{\{{?\s*[#/^>&]?\s*(?:{_KEY}|t\([^)]*\))[^{{}}]*?(?:\}}\}}\}}?|\}}?$|$)|\{{%-?\s*{_KEY}[^{{}}]*?(?:%\}}|$)|<%[=\-#@]?\s*{_KEY}[^<>]*?(?:%>|$)|<\?(?:=|php)?\s*(?:echo\s)?\s*\$?{_KEY}[^<>]*?(?:\?>|$)"
    rf"|[$#]\{{\s*{_KEY}[^{{}}]*?(?:\}}|$)|\{{\$\s*{_KEY}[^{{}}]*?(?:\}}|$)|%\({_ID}\)[sdifSDIF]|%\d+\$[sdifSDIF]|@@{_ID}@@|##{_ID}##|\*\|{_ID}\|\*|%%{_ID}%%|\[\[{_ID}\]\]|__[A-Za-z]\w*?__|(?<![\w%])%{_ID}%(?!\w)|(?<![\w\d] )(?<!\w)%[sS](?!\w)|\{{\d{{1,2}}\}}|<<{_ID}>>|(?<![\w$])\${_ID}\$(?!\w)"
)
#: Slots in marks that texts use too: the name decides.
_NAMED = re.compile(rf"\{{\s*({_ID})\s*\}}|\[\s*({_ID})\s*\]|(?<!\w)<({_ID})>|(?<![\w$])\$({_ID})(?!\w)")
_OPEN = re.compile(r"(?:\{\{|\{%|<%=?|<\?=?|\$\{|#\{|\[\[|%\(|\*\||@@|##|%%|__)\s*\$?[^\W\d]?\w*(?:[.][\w]*)*$")
_TOKEN = re.compile(r"<num>|<slot>|<site>|[^\W\d_]+(?:[’'][^\W\d_]+)*|\d+|n/a")
_ELIDED = re.compile(r"(?:[cdjlmnst]|qu)’(?=.)")
_JAPANESE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
#: Marks that divide a text into parts.
_BORDER = re.compile(r"[-–—|·:(]")


# Entities that template marks are written with.
_MARKS = {"&lt;": "<", "&gt;": ">", "&#123;": "{", "&#125;": "}", "&amp;": "&", "&quot;": '"', "&#39;": "'"}
_ENTITY = re.compile("|".join(map(re.escape, _MARKS)), re.I)
#: Words that mix Latin letters with others: look-alikes.
_MIXED = re.compile(r"(?=[^\W\d_]*[A-Za-z])(?=[^\W\d_]*[\u0370-\u058f])[^\W\d_]+")


def fold(text: str) -> str:
    """Case, compatibility forms, entities of markup signs and characters without ink folded away."""
    if "&" in text:
        text = _ENTITY.sub(lambda m: _MARKS[m[0].lower()], text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKC", text.replace("…", "\0")) if unicodedata.category(c) != "Cf").replace("\0", "…")
        text = _MIXED.sub(lambda m: skeleton(m[0]), text.replace("‘", "’"))
    return " ".join(text.replace("'", "’").split())


def _variable(name: str) -> bool:
    """Whether a name in brackets is a variable's: camel or snake case, dotted, or one that variables usually have."""
    plain = re.sub(r"[._\-]", "", name).casefold()
    return plain in _names() or "_" in name or "." in name or bool(re.search(r"[a-z][A-Z]", name))


@lru_cache(1)
def _names() -> frozenset[str]:
    out = set(NAMES)
    for a in ("user", "page", "shop", "site", "product", "item", "post", "seo", "meta", "company", "category", "store", "heading", "link"):
        out |= {a + b for b in ("name", "title", "firstname", "lastname", "label", "text", "description", "location", "url", "price")}
    return frozenset(out)


def slots(text: str) -> list[tuple[int, int]]:
    """Spans of unresolved slots in a folded text, also one that is cut at the end."""
    if not any(c in text for c in "{}%$[]<>#@_*"):
        return []
    found = [m.span() for m in _MARKED.finditer(text)]
    for m in _NAMED.finditer(text):
        name = next(g for g in m.groups() if g)
        if _variable(name) and not any(s <= m.start() < e for s, e in found):
            found.append(m.span())
    cut = _OPEN.search(text)
    if cut and len(text) - cut.start() >= 3 and not any(s <= cut.start() < e for s, e in found):
        found.append(cut.span())
    return sorted(found)


class Lexicon:
    """The words of messages by what they are for."""

    def __init__(self):
        one = lambda *blocks: frozenset(w for b in blocks for w in fold(b).casefold().split())
        sets = lambda block: [frozenset(fold(p).casefold().replace("#", "<num>").split()) for p in re.split(r"[|\n]", block) if p.strip()]
        self.failures, self.denied, self.negations = one(FAILURES), one(DENIED), one(NEGATIONS)
        self.topics, self.demands = one(TOPICS), one(DEMANDS)
        self.filling, self.offering, self.things, self.labels, self.parts = one(FILLING), one(OFFERING), one(THINGS), one(LABELS), one(PARTS)
        self.failing, self.waiting, self.gaps, self.reports = sets(FAILING), sets(WAITING), sets(GAPS), sets(REPORTS)
        self.joining, self.fresh, self.of = one(JOINING), one("new neu neue neuer neues nouveau nouvelle nuevo nueva novo nova новая новый νέα νέος"), one("meta of the der des de la da do της")
        self.lorem, self.lorem_sure = frozenset(LOREM), frozenset(_LOREM_SURE)
        together = frozenset().union(*self.failing, *self.waiting, *self.gaps, *self.reports)
        self.common = self.failures | self.denied | self.negations | self.topics | self.demands | self.filling | self.offering | self.things | self.labels | self.parts | self.joining | together | one(USES, MORE_WAITING, MORE_GAPS) | {"<num>", "<site>", "internal", "interner", "interne", "interno", "внутренняя", "server", "unexpected", "occurred", "runtime", "ocorreu", "ocurrido", "producido", "survenue", "produite", "произошла", "παρουσιάστηκε", "προέκυψε", "発生", "establishing", "limit", "bandwidth", "log", "seconds", "usual"}
        self.words = self.common | self.lorem | ABOUT | SPEAKS | {"<slot>", "<lorem>"}
        japanese = sorted((w for w in self.words if _JAPANESE.search(w)), key=len, reverse=True)
        self.pieces = re.compile("|".join(map(re.escape, [*japanese, "javascript", "cookie"])) + r"|.")
        self.beginnings: dict[str, list[str]] = {}
        for w in sorted(self.common):
            for k in range(1, len(w)):
                self.beginnings.setdefault(w[:k], []).append(w)


@lru_cache(1)
def lexicon() -> Lexicon:
    return Lexicon()


def _tokens(low: str, sites: frozenset[str]) -> Iterator[tuple[str, bool]]:
    """Tokens of a folded text in lower case, and whether a border of parts stands before each."""
    at = 0
    for m in _TOKEN.finditer(low):
        border = at > 0 and bool(_BORDER.search(low, at, m.start()))
        at = m.end()
        word = m[0]
        if word.isdigit():
            word = "<num>"
        elif word in sites:
            word = "<site>"
        elif _JAPANESE.search(word):  # no spaces between words
            for piece in lexicon().pieces.findall(word):
                yield piece, border
                border = False
            continue
        if e := _ELIDED.match(word):
            yield word[: e.end() - 1], border
            word, border = word[e.end() :], False
        yield word, border


def message(text: str, sites: frozenset[str]) -> str:
    """The message of a text: its tokens, ``=`` before words of the lexicon, ``|`` before parts, ``…`` at the end if cut."""
    folded = fold(text)
    for s, e in reversed(slots(folded)):
        folded = folded[:s] + " <slot> " + folded[e:]
    low = folded.casefold()
    words = lexicon().words
    out: list[str] = []
    lorem = False
    tokens = list(_tokens(low, sites))
    all_lorem = all(t in lexicon().lorem or t in ("<num>", "<site>") for t, _ in tokens)
    for k, (t, border) in enumerate(tokens):
        if all_lorem and t in lexicon().lorem:
            if not lorem:
                sure = sum(u in lexicon().lorem_sure for u, _ in tokens) >= 2
                out.append(("=" if sure else "") + ("|" if border else "") + ("<lorem>" if sure else t))
                lorem = sure
            continue
        known = t in words or k == len(tokens) - 1 and t in lexicon().beginnings
        if len(out) >= LONGEST and not known:
            if out[-1] != "<*>":
                out.append("<*>")
            continue
        out.append(("=" if known else "") + ("|" if border else "") + t)
    return " ".join(out) + (" …" if out and low.rstrip().endswith(("…", "...")) else "")


def _says(tokens: list[str], cut: bool) -> str | None:
    """What a message consisting of these words says: notice, error or filler."""
    lex = lexicon()
    if not tokens:
        return None
    have = frozenset(tokens)
    first = frozenset(tokens[:6])
    if any(w <= first for w in lex.reports) and not have & SPEAKS and (have <= lex.common or have & {"at", "in", "line"}):
        return "error"
    if first & lex.topics and first & lex.demands and first <= lex.words and not have & SPEAKS and tokens[0] not in ASKS:  # may go on
        return "notice"
    if tokens[-1] not in lex.words or cut and len(tokens[-1]) < 3:  # the last word may be cut
        enough = len(tokens) > 1 and (cut or len(tokens[-1]) > 2) or cut and len(tokens[-1]) >= 6
        found = {_says([*tokens[:-1], w], False) for w in lex.beginnings.get(tokens[-1], ()) if enough} - {None}
        if found or tokens[-1] not in lex.words:
            return min(found, key=("notice", "error", "filler").index, default=None)
    if not have <= lex.common:
        if sum(t in lex.lorem_sure or t == "<lorem>" for t in tokens) >= 1 and all(t in lex.lorem or t in ("<lorem>", "<num>", "<site>") for t in tokens):
            return "filler" if "<lorem>" in have or len(tokens) > 1 else None
        return None
    if have & lex.topics and have & lex.demands and tokens[0] not in ASKS:
        return "notice"
    if any(w <= have and len(have - w - lex.joining - lex.things) <= 1 for w in lex.waiting):
        return "notice"
    if have & lex.failures or have & lex.denied and have & lex.negations and (have & lex.things or "<num>" in have or len(tokens) <= 3) or any(w <= have for w in lex.failing):
        return "error"
    if have & lex.filling or have & lex.parts and have & lex.offering and tokens[-1] not in lex.fresh and not (have & lex.demands or have & lex.denied) or len(tokens) <= 4 and have & lex.labels and have <= lex.things | lex.labels | lex.of:
        return "filler"
    if any(w <= have and not have - w - lex.joining - {"<num>"} for w in lex.gaps):
        return "filler"
    return None


def parts_of(form: str) -> tuple[list[list[str]], bool]:
    """The parts of a message or template, and whether it is cut."""
    cut = form.endswith(" …")
    parts: list[list[str]] = [[]]
    for t in form.removesuffix(" …").split(" "):
        t = t.removeprefix("=")
        if t.startswith("|"):
            parts.append([])
        if t.removeprefix("|"):
            parts[-1].append(t.removeprefix("|"))
    return [p for p in parts if p], cut


def cores(form: str) -> list[list[str]]:
    """What a message may be without what stands beside it: site names, labels, a name at the end (perhaps cut)."""
    parts, _ = parts_of(form)
    core = [p for p in parts if p not in (["<site>"], ["info"])]
    flat = sum(core, [])
    bare = flat[:]
    while bare and bare[-1] == "<site>":
        bare.pop()
    while bare and bare[0] == "<site>":
        bare.pop(0)
    out = [flat] if bare == flat else [flat, bare]
    if len(core) > 1 and len(core[-1]) == 1:
        out.append(sum(core[:-1], []))
    return [c for c in out if c]


def classify(form: str) -> str | None:
    """The verdict on one template: notice, error, filler, about (speaks of such things) or None."""
    parts, cut = parts_of(form)
    flat = sum(parts, [])
    if "<slot>" in flat:
        return "about" if ABOUT.intersection(flat) else None
    for core in cores(form):
        if kind := _says(core, cut):
            return kind
    return None


_MINED = "field string, rec_id bigint, message string, has_slot boolean"


def mine(records: DataFrame, sites: frozenset[str]) -> DataFrame:
    """``(field, rec_id, message, has_slot)`` for every record with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, bool]] = {}
        for batch in batches:
            if len(known) > 100_000:
                known.clear()
            forms, has = [], []
            for text in batch.column(2).to_pylist():
                made = known.get(text)
                if made is None:
                    made = message(text, sites), bool(slots(fold(text)))
                    if len(text) <= 200:
                        known[text] = made
                forms.append(made[0])
                has.append(made[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(forms, pa.string()), pa.array(has, pa.bool_())], ["field", "rec_id", "message", "has_slot"])

    kept = records.where("trim(text) <> ''").select("field", F.col("rec_id").cast("bigint").alias("rec_id"), "text")
    return kept.mapInArrow(run, _MINED)


def _beginning(tokens: Column, length: Column, k: Column | int) -> Column:
    """The node of the tree that a message reaches by its first ``k`` tokens."""
    return F.concat_ws(" ", length.cast("string"), F.slice(tokens, F.lit(1), k if isinstance(k, Column) else F.lit(k)))


def grow(mined: DataFrame) -> DataFrame:
    """``(message, n_records, n_slots, template)``: every message once, in the prefix tree that all of them grow."""
    counted = mined.groupBy("message").agg(F.count("*").alias("n_records"), F.count_if("has_slot").alias("n_slots"))
    tokens = F.split("message", " ")
    messages = materialize(counted.select("*", tokens.alias("tokens"), F.size(tokens).alias("length")), "p3-messages")
    reach = F.sequence(F.lit(1), F.least(F.lit(DEPTH), F.col("length")))
    nodes = messages.select("n_records", F.explode(F.transform(reach, lambda k: _beginning(F.col("tokens"), F.col("length"), k))).alias("node"))
    nodes = nodes.groupBy("node").agg(F.sum("n_records").alias("n")).where(F.col("n") >= SUPPORT).select("node")
    # a message's branch ends at its deepest node that enough records reach; beginnings of frequent nodes are frequent too
    tries = messages.select("message", F.posexplode(F.transform(reach, lambda k: _beginning(F.col("tokens"), F.col("length"), k))).alias("k", "node"))
    depth = tries.join(nodes, "node", "left_semi").groupBy("message").agg(F.max(F.col("k") + 1).alias("depth"))
    placed = messages.join(depth, "message", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    placed = materialize(placed.withColumn("leaf", _beginning(F.col("tokens"), F.col("length"), F.col("depth"))), "p3-leaves")
    weight = placed.groupBy("leaf").agg(F.sum("n_records").alias("all"))
    agreed = placed.select("leaf", "n_records", "depth", F.posexplode("tokens").alias("at", "token")).where((F.col("at") >= F.col("depth")) & (F.col("at") < LONGEST) & ~F.col("token").startswith("="))
    agreed = agreed.groupBy("leaf", "at", "token").agg(F.sum("n_records").alias("n")).join(weight, "leaf").where(F.col("n") >= F.col("all") * SHARE)
    profile = agreed.groupBy("leaf").agg(F.collect_set(F.concat_ws(" ", F.col("at").cast("string"), "token")).alias("kept"))  # at most LONGEST / SHARE tokens
    stays = lambda t, i: (i < F.col("depth")) | t.startswith("=") | (t == "…") | ((i < LONGEST) & F.coalesce(F.array_contains("kept", F.concat_ws(" ", i.cast("string"), t)), F.lit(False)))
    masked = F.transform("tokens", lambda t, i: F.when(stays(t, i), t).when(t.startswith("|"), "|<*>").otherwise("<*>"))
    return placed.join(profile, "leaf", "left").select("message", "n_records", "n_slots", F.array_join(masked, " ").alias("template"))


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([classify(f) for f in batch.column(0).to_pylist()], pa.string())], [*batch.schema.names, "verdict"])


def templates(grown: DataFrame) -> DataFrame:
    """Every template once: how many messages and records have it, how many of these a slot, and its verdict."""
    counted = grown.groupBy("template").agg(F.count("*").alias("n_messages"), F.sum("n_records").alias("n_records"), F.sum("n_slots").alias("n_slots"))
    return counted.mapInArrow(_verdicts, "template string, n_messages bigint, n_records bigint, n_slots bigint, verdict string")


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All beginnings of messages with a verdict that have half of them, two words and eight characters at least."""
    for batch in batches:
        out = set()
        for form, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for core in cores(form):
                whole = " ".join(core)
                out.update((whole[:k], kind) for k in range(max(8, (len(whole) + 1) // 2), len(whole)) if " " in whole[:k].strip() and whole[k - 1] != " ")
        yield pa.RecordBatch.from_pylist([{"start": s, "kind": k} for s, k in out], pa.schema([("start", pa.string()), ("kind", pa.string())]))


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(m, " ".join(c)) for m in batch.column(0).to_pylist() for c in cores(m)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 2, ["message", "start"])


def judge(grown: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``(message, verdict)`` of the messages that have one: by their template, or as the beginning of one that has."""
    judged = materialize(grown.join(verdicts.select("template", "verdict"), "template").select("message", "n_slots", "template", "verdict"), "p3-judged")
    own = judged.where("verdict IS NOT NULL OR n_slots > 0").select("message", "verdict")
    starts = judged.where("verdict IN ('notice', 'error', 'filler')").select("template", "verdict").distinct().mapInArrow(_starts, "start string, kind string").groupBy("start").agg(F.min("kind").alias("kind"))
    open_ = judged.where("verdict IS NULL AND n_slots = 0").select("message").mapInArrow(_cores, "message string, start string")
    cut = open_.join(starts, "start").groupBy("message").agg(F.min("kind").alias("verdict"))
    return own.unionByName(cut)


def residue(mined: DataFrame, judged: DataFrame) -> DataFrame:
    """``(field, rec_id, kind)`` of the records that are residue: by their message's verdict or an unresolved slot."""
    kind = F.when(F.col("verdict") == "about", None).when(F.col("has_slot"), "slot").otherwise(F.col("verdict"))
    return mined.join(judged, "message").select("field", "rec_id", kind.alias("kind")).where("kind IS NOT NULL").distinct()


def site_names(sites: DataFrame, most: int = 100_000) -> frozenset[str]:
    """Folded site names; a table of more than ``most`` sites is not taken to the driver."""
    names = [r[0] for r in sites.select("site_name").where("site_name IS NOT NULL").distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} site names")
    return frozenset(t for n in names for t in [fold(n).casefold()] if t)
