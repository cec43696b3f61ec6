"""Pages without what is not wanted: edits of the source by the places of elements, untouched bytes staying as they are."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.urls import absolute_one, kind_of, resolve_one, resource_of
from leafmill.operators.selectors import CONSENT, matching
from leafmill.operators.tokenizer import ENTER, EXIT, TEXT, VOID, attributes, events

_HYPHENS = re.compile("\u00ad|&shy;|&#0*173;|&#x0*ad;", re.I)
_METADATA = re.compile(r"8BIM|Exif|Photoshop 3\.0|Adobe XMP Core|xmpmeta|rdf:RDF|xpacket", re.I)
#: Metadata for which a comment goes in any case.
_COMMENT_DATA = re.compile(r"xpacket|xmpmeta|rdf:RDF|Adobe XMP Core|Exif|8BIM", re.I)
_READER_CLASSES = frozenset(("screen-reader-text", "sr-only", "visually-hidden", "skip-link"))
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)


def looks_binary(text: str) -> bool:
    n = len(text) + sum(c > "\uffff" for c in text)
    if n < 16:
        return False
    controls = sum(c < " " and c not in "\t\n\r" for c in text)
    return bool(_METADATA.search(text)) or "\0" in text or controls > 20 or controls / n > 0.05


@dataclass(frozen=True)
class Cleaning:
    """What to take out."""

    scripts: bool = False
    styles: bool = False
    comments: bool = False
    consent: bool = False
    aria_hidden: bool = False
    images: bool = False
    meta: bool = False
    link_tags: bool = False
    hyphenation: bool = False
    classes: bool = False
    ids: bool = False
    links: tuple[str, ...] | None = None  # kinds of links to keep; others become their text
    resources: bool = True  # whether links to downloads are kept
    context: str | None = None  # selectors outside whose elements elements are unwrapped and texts dropped; comments stay


_REFERENCE = re.compile(r"&(?:#(\d+)|#x([\da-f]+)|([a-z]+\d?));", re.I)
#: The named characters of HTML 4 and the apostrophe.
_NAMES = name2codepoint | {"apos": 39}


def decode(text: str) -> str:
    """References in an attribute that is judged: numbers and the names of HTML 4, each with its semicolon; others stay."""

    def one(m: re.Match) -> str:
        code = int(m[1]) if m[1] else int(m[2], 16) if m[2] else _NAMES.get(m[3])
        return m[0] if code is None else chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else "\ufffd"

    return _REFERENCE.sub(one, text) if "&" in text else text


def _written(html: str, start: int, stop: int, name: str) -> str | None:
    """An attribute of the tag between two places, decoded as above."""
    tag = re.match(r"<[^\s/>]+", html[start:stop])
    return attributes(html[start + tag.end() : stop].removesuffix(">"), decode).get(name)


def clean(html: str, url: str, what: Cleaning) -> str:
    """The page with the wanted cuts made."""
    if not html.strip():
        return ""
    found = events(html)
    cuts: list[tuple[int, int, str]] = []  # start, stop, replacement
    ends = {e[1]: e for e in found if e[0] == EXIT}
    judged, base = what.links is not None or not what.resources, url
    for e in found if judged else ():
        if e[0] == ENTER and e[2] == "base" and (href := _written(html, e[9], e[10], "href")) is not None and (to := resolve_one(href, url)):
            base = to
            break
    context = matching(found, what.context) if what.context else set()
    unwanted = matching(found, ", ".join(CONSENT)) if what.consent else set()
    gone, within, last = -1, -1, 0  # event at which what is taken out, or what is in the context, ends
    closing = {e[1]: k for k, e in enumerate(found) if e[0] == EXIT}
    for at, (kind, node, tag, attrs, _, _, _, _, _, start, stop) in enumerate(found):
        if at <= gone or kind == EXIT:
            continue
        if node in context and kind == ENTER and tag not in VOID:  # nothing is inside the others
            within = max(within, closing[node])
        outside = bool(what.context) and at > within
        if kind == TEXT:
            if outside or looks_binary(html[start:stop]):
                cuts.append((start, stop, ""))
            elif what.hyphenation and tag not in ("script", "style") and _HYPHENS.search(html[start:stop]):
                cuts.append((start, stop, _HYPHENS.sub("", html[start:stop])))
            continue
        end = ends[node]
        classes = set(attrs.get("class", "").split())
        hidden = (attrs.get("aria-hidden") == "true" or "inert" in attrs) and tag != "main" and attrs.get("role") != "main"
        if (
            ":" in tag or what.scripts and tag == "script" or what.styles and tag in ("style", "svg") or what.images and tag in ("img", "picture", "figure") or what.meta and tag == "meta"
            or what.link_tags and tag == "link" or what.hyphenation and tag == "wbr" or what.aria_hidden and (hidden or classes & _READER_CLASSES) or node in unwanted
        ):
            gone = closing[node]
            cuts.append((start, end[10], ""))
            continue
        unwrap = outside
        if judged and tag == "a" and (href := _written(html, start, stop, "href")):
            to = absolute_one(href, base)
            unwrap = unwrap or what.links is not None and kind_of(href, to, url) not in what.links or not what.resources and resource_of(to)
        if unwrap:
            cuts.append((start, stop, ""))
            if end[9] < end[10]:
                cuts.append((end[9], end[10], ""))
            continue
        drop = [n for n in attrs if what.classes and n == "class" or what.ids and n == "id" or what.styles and n == "style" or looks_binary(attrs[n])]
        if drop:
            source = html[start:stop]
            for name in drop:
                source = re.sub(rf"""\s+{re.escape(name)}(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>])""", "", source, count=1, flags=re.I)
            cuts.append((start, stop, source))
    raw = [(e[9], e[10]) for e in found if e[0] == TEXT]
    for m in _COMMENT.finditer(html):
        while last < len(raw) and raw[last][1] <= m.start():
            last += 1
        if (last == len(raw) or m.start() < raw[last][0]) and (what.comments or _COMMENT_DATA.search(m[0])):
            cuts.append((m.start(), m.end(), ""))
    out, at = [], 0
    for start, stop, new in sorted(cuts):
        if start >= at:
            out += [html[at:start], new]
            at = stop
    return "".join([*out, html[at:]])


def clean_pages(pages: DataFrame, **what) -> DataFrame:
    """``(page_id, html)`` of ``pages(page_id, url, html)`` after ``Cleaning(**what)``."""
    wanted = asdict(Cleaning(**what))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cleaning = Cleaning(**wanted)
        for batch in batches:
            texts = [None if h is None else clean(h, u or "", cleaning) for h, u in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "html"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(run, "page_id bigint, html string")


