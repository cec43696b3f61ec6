"""CSS selectors as predicates and joins over the elements of pages.

A compound (tag, id, classes, attributes, positions, negations) becomes one column predicate. Combinators become semi
joins along the parent or the enclosing elements, always within a page. Unsupported or malformed selectors raise
``ValueError`` when the plan is built.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import JS_WS

_NAME = r"(?:\\[0-9a-fA-F]{1,6}\s?|\\[^\n0-9a-fA-F]|[\w\-]|[^\x00-\x7F])+"
_PART = re.compile(rf"(?P<star>\*)|(?P<id>\#{_NAME})|(?P<cls>\.{_NAME})|(?P<attr>\[(?:[^\]\"']|\"(?:\\.|[^\"])*\"|'(?:\\.|[^'])*')*\])|(?P<pseudo>:[a-zA-Z\-]+(?:\((?:[^()\"']|\"[^\"]*\"|'[^']*'|\([^()]*\))*\))?)|(?P<tag>{_NAME})")
_ATTR = re.compile(rf"\[\s*({_NAME})\s*(?:([~|^$*]?=)\s*(?:\"((?:\\.|[^\"])*)\"|'((?:\\.|[^'])*)'|({_NAME}))\s*([iIsS])?\s*)?\]\Z", re.S)
_NTH = re.compile(r"\s*(?:(?P<word>odd|even)|(?:(?P<a>[+-]?\d*)n(?:\s*(?P<sign>[+-])\s*(?P<b>\d+))?)|(?P<only>[+-]?\d+))\s*\Z", re.I)


def _unescape(name: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            code = int(m[1], 16)
            return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else "�"
        return m[2]

    return re.sub(r"\\(?:([0-9a-fA-F]{1,6})\s?|(.))", one, name, flags=re.S)


def split_list(selector: str) -> list[str]:
    """The members of a selector list: commas inside brackets, quotes and escapes do not divide."""
    out, depth, quote, start, k = [], 0, "", 0, 0
    while k < len(selector):
        c = selector[k]
        if c == "\\":
            k += 1
        elif quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(selector[start:k])
            start = k + 1
        k += 1
    out.append(selector[start:])
    return [s.strip() for s in out]


@dataclass(frozen=True)
class Nth:
    a: int
    b: int

    def holds(self, position: int) -> bool:
        if self.a == 0:
            return position == self.b
        steps, rest = divmod(position - self.b, self.a)
        return rest == 0 and steps >= 0

    def column(self, position: Column) -> Column:
        if self.a == 0:
            return position == self.b
        steps = (position - self.b) / self.a
        return (steps >= 0) & (steps == F.floor(steps))


def parse_nth(formula: str) -> Nth:
    m = _NTH.match(formula)
    if not m:
        raise ValueError(f"bad position formula: {formula!r}")
    if m["word"]:
        return Nth(2, 1 if m["word"].lower() == "odd" else 0)
    if m["only"]:
        return Nth(0, int(m["only"]))
    a = int(m["a"] + "1" if m["a"] in ("", "+", "-") else m["a"])
    return Nth(a, int((m["sign"] or "+") + (m["b"] or "0")))


def _attribute(source: str) -> Column:
    m = _ATTR.match(source)
    if not m:
        raise ValueError(f"bad attribute selector: {source!r}")
    value = F.col("attrs")[_unescape(m[1]).lower()]
    if not m[2]:
        return value.isNotNull()
    wanted = _unescape(next((g for g in (m[3], m[4], m[5]) if g is not None), ""))
    if (m[6] or "").lower() == "i":
        value, wanted = F.lower(value), wanted.lower()
    if m[2] == "=":
        test = value == wanted
    elif m[2] == "|=":
        test = (value == wanted) | value.startswith(wanted + "-")
    elif not wanted or m[2] == "~=" and re.search(r"\s", wanted):
        return F.lit(False)
    elif m[2] == "~=":
        test = F.array_contains(F.split(value, f"[{JS_WS}]+"), wanted)
    else:
        test = {"^=": value.startswith, "$=": value.endswith, "*=": value.contains}[m[2]](wanted)
    return F.coalesce(test, F.lit(False))


def _pseudo(source: str) -> Column:
    name, mark, inner = source[1:].partition("(")
    name, inner = name.lower(), inner[:-1] if mark else None
    if name in ("first-child", "first-of-type") and inner is None:
        return F.col("nth_child" if name == "first-child" else "nth_of_type") == 1
    if name in ("nth-child", "nth-of-type") and inner is not None:
        return parse_nth(inner).column(F.col(name.replace("-", "_")))
    if name == "not" and inner is not None:
        return ~reduce(lambda x, y: x | y, (compound(s) for s in split_list(inner)))
    raise ValueError(f"unsupported selector: {source!r}")


def compound(source: str) -> Column:
    """The predicate of a selector without combinators."""
    at, tests = 0, []
    while at < len(source):
        m = _PART.match(source, at)
        if not m:
            raise ValueError(f"unsupported selector: {source!r}")
        kind, text = m.lastgroup, m[0]
        if kind in ("tag", "star") and at:
            raise ValueError(f"unsupported selector: {source!r}")
        if kind == "tag":
            tests.append(F.col("tag") == _unescape(text).lower())
        elif kind == "id":
            tests.append(F.coalesce(F.col("attrs")["id"] == _unescape(text[1:]), F.lit(False)))
        elif kind == "cls":
            tests.append(F.coalesce(F.array_contains(F.split(F.col("attrs")["class"], f"[{JS_WS}]+"), _unescape(text[1:])), F.lit(False)))
        elif kind == "attr":
            tests.append(_attribute(text))
        elif kind == "pseudo":
            tests.append(_pseudo(text))
        at = m.end()
    if not source:
        raise ValueError("empty selector")
    return reduce(lambda x, y: x & y, tests, F.lit(True))


def steps(selector: str) -> list[tuple[str, str]]:
    """(combinator, compound) from left to right; the first has none."""
    out: list[tuple[str, str]] = []
    at, combinator, text = 0, "", selector.strip()
    while at < len(text):
        start = at
        while at < len(text) and (m := _PART.match(text, at)):
            at = m.end()
        if at == start:
            raise ValueError(f"unsupported selector: {selector!r}")
        out.append((combinator, text[start:at]))
        m = re.compile(r"\s*([>+~])\s*|\s+").match(text, at)
        if not m:
            if at < len(text):
                raise ValueError(f"unsupported selector: {selector!r}")
            break
        combinator = m[1] or " "
        if combinator in "+~" or m.end() == len(text):
            raise ValueError(f"unsupported selector: {selector!r}")
        at = m.end()
    if not out:
        raise ValueError("empty selector")
    return out


def types(selector: str) -> set[str] | None:
    """The tags that a selector list can match, None for all."""
    found = set()
    for s in split_list(selector):
        m = re.match(_NAME, steps(s)[-1][1])
        if not m:
            return None
        found.add(_unescape(m[0]).lower())
    return found


def match(elements: DataFrame, selector: str) -> DataFrame:
    """The rows of ``elements`` that a selector list matches."""
    key = ["page_id", "node"]
    simple: list[Column] = []
    joined: DataFrame | None = None
    for s in split_list(selector):
        chain = steps(s)
        if len(chain) == 1:
            simple.append(compound(chain[0][1]))
            continue
        above = elements.where(compound(chain[0][1])).select("page_id", F.col("node").alias("above"))
        for combinator, part in chain[1:]:
            here = elements.where(compound(part))
            link = F.element_at("inside", -1) if combinator == ">" else F.explode("inside")
            pairs = here.where(F.size("inside") > 0).select("page_id", "node", link.alias("above"))
            hit = pairs.join(above, ["page_id", "above"], "left_semi").select(*key).distinct()
            above = hit.select("page_id", F.col("node").alias("above"))
        joined = hit if joined is None else joined.unionByName(hit)
    if joined is None:
        return elements.where(reduce(lambda x, y: x | y, simple))
    if simple:
        joined = joined.unionByName(elements.where(reduce(lambda x, y: x | y, simple)).select(*key))
    return elements.join(joined.distinct(), key, "left_semi")


# The same selectors over the events of one page, for what edits pages: tests of (tag, attributes, position, position of type).
Test = Callable[[str, dict, int, int], bool]


def _attribute_test(source: str) -> Test:
    m = _ATTR.match(source)
    if not m:
        raise ValueError(f"bad attribute selector: {source!r}")
    name, sign = _unescape(m[1]).lower(), m[2]
    wanted = _unescape(next((g for g in (m[3], m[4], m[5]) if g is not None), ""))
    fold = str.lower if (m[6] or "").lower() == "i" else str
    wanted = fold(wanted)
    signs = {
        None: lambda v: True, "=": lambda v: v == wanted, "|=": lambda v: v == wanted or v.startswith(wanted + "-"), "~=": lambda v: bool(wanted) and wanted in v.split(),
        "^=": lambda v: bool(wanted) and v.startswith(wanted), "$=": lambda v: bool(wanted) and v.endswith(wanted), "*=": lambda v: bool(wanted) and wanted in v,
    }
    test = signs[sign]
    return lambda tag, attrs, k, t: name in attrs and test(fold(attrs[name]))


def _pseudo_test(source: str) -> Test:
    name, mark, inner = source[1:].partition("(")
    name, inner = name.lower(), inner[:-1] if mark else None
    if name in ("first-child", "first-of-type") and inner is None:
        return (lambda tag, attrs, k, t: k == 1) if name == "first-child" else (lambda tag, attrs, k, t: t == 1)
    if name in ("nth-child", "nth-of-type") and inner is not None:
        nth = parse_nth(inner)
        return (lambda tag, attrs, k, t: nth.holds(k)) if name == "nth-child" else (lambda tag, attrs, k, t: nth.holds(t))
    if name == "not" and inner is not None:
        tests = [compound_test(s) for s in split_list(inner)]
        return lambda *e: not any(test(*e) for test in tests)
    raise ValueError(f"unsupported selector: {source!r}")


@lru_cache(2000)
def compound_test(source: str) -> Test:
    """The test of a selector without combinators."""
    at, tests = 0, []
    while at < len(source):
        m = _PART.match(source, at)
        if not m or m.lastgroup in ("tag", "star") and at:
            raise ValueError(f"unsupported selector: {source!r}")
        kind, name = m.lastgroup, _unescape(m[0].lstrip("#.") if m.lastgroup in ("id", "cls") else m[0])
        if kind == "tag":
            tests.append(lambda tag, attrs, k, t, name=name.lower(): tag == name)
        elif kind == "id":
            tests.append(lambda tag, attrs, k, t, name=name: attrs.get("id") == name)
        elif kind == "cls":
            tests.append(lambda tag, attrs, k, t, name=name: name in attrs.get("class", "").split())
        elif kind == "attr":
            tests.append(_attribute_test(m[0]))
        elif kind == "pseudo":
            tests.append(_pseudo_test(m[0]))
        at = m.end()
    if not source:
        raise ValueError("empty selector")
    return lambda *e: all(test(*e) for test in tests)


def matching(found: list[tuple], selector: str) -> set[int]:
    """The nodes that a selector list matches among the events of a page (see ``tokenizer.events``)."""
    chains = [[(c, compound_test(part)) for c, part in steps(s)] for s in split_list(selector)]
    bare = [len(chain) > 1 or not re.match(r"(?:[\w-]*)[#.\[]", s) for chain, s in zip(chains, split_list(selector), strict=True)]
    reached: list[list[set[int]]] = [[set() for _ in chain] for chain in chains]
    out: set[int] = set()
    for e in found:
        if e[0] != 0:
            continue
        node, inside = e[1], e[6]
        for chain, sets, may_be_bare in zip(chains, reached, bare, strict=True):
            if not may_be_bare and not e[3]:
                continue
            for k, (combinator, test) in enumerate(chain):
                if test(e[2], e[3], e[7], e[8]) and (k == 0 or (inside[-1:] and inside[-1] in sets[k - 1] if combinator == ">" else not sets[k - 1].isdisjoint(inside))):
                    sets[k].add(node)
            if node in sets[-1]:
                out.add(node)
    return out


# The dialogs, banners and blockers of widespread consent tools.
CONSENT = (
    "#BorlabsCookieBox", "[id^='brlbs-cmpnt']", "[class^='brlbs-cmpnt']", ".brlbs-cmpnt-dialog", "[consent-skip-blocker]", "#CybotCookiebotDialog", "#usercentrics-root",
    "#usercentrics-cmp-ui", ".cmplz-cookiebanner", "#cmplz-cookiebanner-container", ".cky-consent-container", "#cookie-law-info-bar", "#onetrust-consent-sdk",
    "#onetrust-banner-sdk", ".klaro", "#ccm-widget", ".ccm-root", ".rcb-banner", "[id^='real-cookie-banner']", "#cmpbox", "#cmpbox2", ".cmpboxBG", "#cc-main", "#didomi-host",
    "[id^='sp_message_container']", ".qc-cmp2-container", "#truste-consent-track", "#moove_gdpr_cookie_info_bar", "[id*='cookie-banner' i]", "[id*='cookiebanner' i]",
    "[id*='consent-banner' i]", "div[class*='consent-banner']", "div[id*='consent-modal']", "div[class*='consent-modal']", "div[id*='consent-wrapper']", "div[class*='consent-wrapper']",
)
