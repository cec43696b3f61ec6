"""Pages as a table of ordered events: elements entered and left, and texts between them.

Each event knows the elements it stands in (tags and node numbers, outermost first), so most facets are row-local
projections of this table and nothing has to be shuffled to find out whether something is in the head, in an svg or
inside a context. Elements carry their position among their siblings and the event at which they end. What an event needs of
the events before it is told along with it: the base of addresses, whether it is hidden by markup, and for texts the link
and the heading that were opened last, so that no facet has to put a page together again for these.

Cases: a null or blank page has no events; unclosed elements end with the page; end tags of elements that are not open
are ignored; text inside script, style and noscript is one text as written; whitespace collapses except in pre, textarea
and raw text; references are decoded once, in texts and attributes, never in raw text. Extra columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.urls import resolve_one

ENTER, EXIT, TEXT = 0, 1, 2
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "noscript", "iframe", "noembed", "noframes", "xmp"))
RCDATA = frozenset(("title", "textarea"))
HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
HEAD_CONTENT = frozenset("base basefont bgsound command link meta noframes noscript script style template title".split())
# Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
# Start tag, the open elements that it ends, and the elements beyond which it does not look.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th"), ("table", "thead", "tbody", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
}
_MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>]++)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_SPACES = re.compile(r"[\t\n\f\r ]+")

SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("seq", pa.int32()), ("kind", pa.int8()), ("node", pa.int32()), ("tag", pa.string()),
        ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("path", pa.list_(pa.string())), ("inside", pa.list_(pa.int32())),
        ("nth_child", pa.int32()), ("nth_of_type", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()),
        ("close", pa.int32()), ("base", pa.string()), ("hidden", pa.bool_()), ("link", pa.int32()), ("heading", pa.int32()),
    ]
)
DDL = "page_id bigint, url string, seq int, kind tinyint, node int, tag string, attrs map<string,string>, text string, path array<string>, inside array<int>, nth_child int, nth_of_type int, start int, stop int, close int, base string, hidden boolean, link int, heading int"


class _Open:
    """An open element; ``around``: the tags and nodes it stands in, one pair for all events that stand there."""

    __slots__ = ("around", "children", "hides", "kinds", "node", "seq", "tag")

    def __init__(self, node: int, tag: str, seq: int = -1, hides: bool = False, around: tuple[list[str], list[int]] = ((), ())):
        self.node, self.tag, self.seq, self.hides, self.around, self.children, self.kinds = node, tag, seq, hides, around, 0, {}


def attributes(source: str, decode=unescape) -> dict[str, str]:
    """Attributes in order, names lower-cased, the first of a name kept, references decoded, no value as empty text."""
    out: dict[str, str] = {}
    for name, quoted, single, bare in _ATTRIBUTE.findall(source):
        name = name.lower()
        if name not in out:
            out[name] = decode(quoted or single or bare)
    return out


#: Sites write the same attributes again and again; longer ones are not kept.
_SHORT = 300
_known = lru_cache(4096)(attributes)

_HIDING_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def hides(tag: str, attrs: dict[str, str]) -> bool:
    """Whether the markup itself hides an element's content; the same as the columns of ``facets.hides_content``."""
    if tag == "template" or tag == "dialog" and "open" not in attrs or "hidden" in attrs:
        return True
    if (attrs.get("aria-hidden") == "true" or "inert" in attrs) and tag != "main" and attrs.get("role") != "main":
        return True
    return "style" in attrs and bool(_HIDING_STYLE.search(attrs["style"]))


def events(html: str, url: str | None = None) -> list[tuple]:
    """(kind, node, tag, attributes, text, path, inside, nth child, nth of type, start, stop) in page order."""
    return [e[:11] for e in scan(html, url)]


def scan(html: str, url: str | None = None) -> list[tuple]:
    """The events of a page and for each (close, base, hidden, link, heading): the event at which an element ends, the
    address that a base element set, whether markup hides it, the link and heading that a text belongs to."""
    out: list[tuple] = []
    hiding = 0
    link = heading = base = None
    settled = url is None
    root = _Open(-1, "")
    stack: list[_Open] = []
    n, at, end = 0, 0, len(html)
    pending: list[str] = []
    began = 0
    here: tuple[list[str], list[int]] | None = [], []

    def place() -> tuple[list[str], list[int]]:
        nonlocal here
        if here is None:  # an element was entered
            e = stack[-1]
            here = [*e.around[0], e.tag], [*e.around[1], e.node]
        return here

    def flush(stop: int) -> None:
        if pending:
            text = unescape("".join(pending))
            pending.clear()
            if not any(e.tag in ("pre", "textarea") for e in stack):
                text = _SPACES.sub(" ", text)
            if text and (stack or text != " "):
                if stack and stack[-1].tag == "head" and text.strip(" \t\n\f\r"):
                    leave(len(stack) - 1, stop)
                path, inside = place()
                out.append((TEXT, inside[-1] if inside else -1, path[-1] if path else "", None, text, path, inside, None, None, began, stop, None, base, hiding > 0, link, heading))

    def leave(depth: int, stop: int) -> None:
        nonlocal hiding, link, heading, here
        while len(stack) > depth:
            e = stack.pop()
            path, inside = here = e.around
            entered = out[e.seq]
            out[e.seq] = (*entered[:11], len(out), *entered[12:])
            out.append((EXIT, e.node, e.tag, None, None, path, inside, None, None, stop, stop, None, base, hiding > 0, None, None))
            hiding -= e.hides
            if e.tag == "a":
                link = None
            elif e.tag in HEADINGS:
                heading = None

    def find(tags, stops=()) -> int:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in tags:
                return k
            if stack[k].tag in stops:
                return -1
        return -1

    while at < end:
        m = _MARKUP.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            if not pending:
                began = at
            pending.append(html[at:stop])
        if not m:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            k = find((tag,))
            if k >= 0:
                flush(stop)
                leave(k, stop)
                # the end tag itself belongs to the element that ends
                last = out[-1]
                out[-1] = (*last[:9], stop, at, *last[11:])
            continue
        if not m[2]:
            flush(stop)
            continue
        if pending:
            flush(stop)
        tag = m[2].lower()
        if stack and stack[-1].tag == "head" and tag not in HEAD_CONTENT:
            leave(len(stack) - 1, stop)
        if tag in ENDS_P and (k := find(("p",), ("button", "td", "th", "table", "body"))) >= 0:
            leave(k, stop)
        if tag in IMPLIED:
            closes, bounds = IMPLIED[tag]
            while (k := find(closes, bounds)) >= 0:
                leave(k, stop)
        parent = stack[-1] if stack else root
        parent.children += 1
        parent.kinds[tag] = parent.kinds.get(tag, 0) + 1
        path, inside = around = place()
        written = m[3]
        attrs = (_known(written) if len(written) < _SHORT else attributes(written)) if written else {}
        if not settled:
            href = attrs.get("href", "").strip() if tag == "base" else ""
            if href:
                settled = True
                base = resolve_one(href, url) or base
            elif tag != "base":
                settled = tag not in ("html", "head") and "head" not in path
        hidden = hides(tag, attrs) if attrs or tag in ("template", "dialog") else False
        if tag in VOID:  # ends where it begins
            out.append((ENTER, n, tag, attrs, None, path, inside, parent.children, parent.kinds[tag], stop, at, len(out) + 1, base, hidden or hiding > 0, None, None))
            out.append((EXIT, n, tag, None, None, path, inside, None, None, at, at, None, base, hidden or hiding > 0, None, None))
            n += 1
            continue
        opened = _Open(n, tag, len(out), hidden, around)
        hiding += hidden
        if tag == "a" and attrs.get("href"):
            link = n
        elif tag in HEADINGS:
            heading = n
        out.append((ENTER, n, tag, attrs, None, path, inside, parent.children, parent.kinds[tag], stop, at, None, base, hiding > 0, None, None))
        stack.append(opened)
        here = None
        n += 1
        if written.rstrip().endswith("/") and any(e.tag in ("svg", "math") for e in stack):
            leave(len(stack) - 1, at)
        elif tag in RAW or tag in RCDATA and not any(e.tag == "svg" for e in stack[:-1]):
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, k) if (k := html.find("<", at)) >= 0 else None
            to = close.start() if close else end
            if to > at:
                text = html[at:to]
                if tag in RCDATA:
                    text = unescape(text) if tag == "textarea" else _SPACES.sub(" ", unescape(text))
                path, inside = place()
                out.append((TEXT, stack[-1].node, tag, None, text, path, inside, None, None, at, to, None, base, hiding > 0, link, heading))
            at = to
    flush(end)
    leave(0, end)
    return out


#: Pages whose texts are in Python at once, and the events after which rows are handed on.
_PAGES, _EVENTS = 64, 20_000


def _run(batches: Iterator[pa.RecordBatch], names: list[str] = SCHEMA.names, within: str | None = None, kinds: tuple[int, ...] = (ENTER, EXIT, TEXT)) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([SCHEMA.field(name) for name in names])
    columns: dict[str, list] = {name: [] for name in SCHEMA.names}

    def made() -> pa.RecordBatch:
        columns["attrs"] = [None if a is None else list(a.items()) for a in columns["attrs"]]
        out = pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
        for c in columns:
            columns[c] = []
        return out

    for batch in batches:
        for at in range(0, batch.num_rows, _PAGES):
            for page, url, html in zip(*(c.to_pylist() for c in batch.slice(at, _PAGES).columns), strict=True):
                found = scan(html, url) if html and html.strip() else []
                seqs = range(len(found))
                if within is not None or len(kinds) < 3:
                    seqs = [k for k, e in enumerate(found) if e[0] in kinds and (within is None or within in e[5])]
                    found = [found[k] for k in seqs]
                for name, values in zip(SCHEMA.names, ([page] * len(found), [url] * len(found), seqs, *zip(*found))):  # noqa: B905
                    columns[name].extend(values)
            if len(columns["page_id"]) > _EVENTS:
                yield made()
        if columns["page_id"]:
            yield made()


def tokenize(pages: DataFrame, names: list[str] | None = None, within: str | None = None, kinds: tuple[int, ...] = (ENTER, EXIT, TEXT)) -> DataFrame:
    """Events of ``pages(page_id, url, html)``; see ``DDL``. Works on batch and streaming tables alike.

    A reader that needs few columns (``names``), kinds of events or only what stands in elements of one tag (``within``) says
    so here, as no plan can tell the Python stage; whole pages are read all the same, and numbers are those of all events.
    """
    names = names or SCHEMA.names
    ddl = ", ".join(d for d in DDL.split(", ") if d.split(" ")[0] in names)
    names = [d.split(" ")[0] for d in ddl.split(", ")]
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(lambda batches: _run(batches, names, within, kinds), ddl)


def elements(tokens: DataFrame) -> DataFrame:
    """The entered elements only."""
    return tokens.where(F.col("kind") == ENTER)
