"""URLs: resolving, kinds of links, sites and downloads.

``resolve`` serialises like browsers do (scheme and host in lower case, default ports dropped, dot segments resolved,
characters beyond ASCII and unsafe ones percent-encoded); what cannot be parsed stays as written. Everything else is
plain column arithmetic.
"""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from leafmill.functions.text import JS_WS, js_trim

_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
# File name extensions of downloads and media.
RESOURCES = "pdf doc docx xls xlsx ppt pptx odt ods odp rtf csv epub vcf ics zip rar 7z tar gz tgz bz2 exe msi dmg apk mp3 m4a wav ogg mp4 m4v webm avi mov mkv wmv jpg jpeg png gif svg webp avif bmp tif tiff ico".split()
# Labels under which sites are registered one level deeper.
SECOND_LEVEL = "co com org net gov gv ac edu or".split()
_STRIP = "".join(chr(c) for c in range(33))
_KEPT_PATH = "!$%&'()*+,-./:;=@_~[]|^\\"


def _segments(path: str) -> str:
    out: list[str] = []
    parts = path.replace("\\", "/").split("/")
    for k, part in enumerate(parts[1:] if path.startswith("/") else parts):
        low = part.lower().replace("%2e", ".")
        last = k == len(parts) - (2 if path.startswith("/") else 1)
        if low == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(part)
    return "/" + "/".join(out)


def _host(host: str) -> str | None:
    host = host.lower()
    if host.startswith("["):
        return host if host.endswith("]") else None
    if not host.isascii():
        try:
            host = ".".join(p if p.isascii() else "xn--" + p.encode("punycode").decode() for p in host.split("."))
        except UnicodeError:
            return None
    return None if not host or any(c in host for c in " #/<>?@[\\]^|%") else host


def _split(url: str) -> tuple[str, str | None, str, str | None, str | None]:
    url, mark, fragment = url.partition("#")
    fragment = fragment if mark else None
    url, mark, query = url.partition("?")
    query = query if mark else None
    scheme, rest = "", url
    head, mark, tail = url.partition(":")
    if mark and head and head[0].isalpha() and head.isascii() and all(c.isalnum() or c in "+-." for c in head):
        scheme, rest = head.lower(), tail
    authority = None
    if scheme in _PORTS or not scheme:
        rest = rest.replace("\\", "/")
    if rest.startswith("//"):
        authority, slash, path = rest[2:].partition("/")
        rest = slash + path
    return scheme, authority, rest, query, fragment


@lru_cache(50_000)
def resolve_one(url: str, base: str | None) -> str | None:
    """``url`` seen from ``base`` as an absolute URL; None if it is none."""
    url = url.strip(_STRIP).translate({9: None, 10: None, 13: None})
    scheme, authority, path, query, fragment = _split(url)
    if scheme and scheme not in _PORTS:
        return url
    if scheme and authority is None and path:
        b = _split(base) if base else ("", None, "", None, None)
        if b[0] == scheme and not path.startswith("/"):
            scheme = ""
        else:
            authority, slash, rest = path.lstrip("/").partition("/")
            path = slash + rest
    if not scheme:
        if not base:
            return None
        b = _split(base)
        if b[0] not in _PORTS or not b[1]:
            return None
        scheme = b[0]
        if authority is None:
            authority = b[1]
            if not path:
                path = b[2]
                query = query if query is not None else b[3]
            elif not path.startswith("/"):
                path = (b[2].rsplit("/", 1)[0] if "/" in b[2] else "") + "/" + path
    if authority is None:
        return None
    user, mark, place = authority.rpartition("@")
    host, colon, port = place.partition(":") if not place.startswith("[") else (place, "", "")
    host = _host(host)
    if host is None or colon and port and not port.isdigit() or port.isdigit() and int(port) > 65535:
        return None
    port = "" if not port or port.lstrip("0") == _PORTS[scheme] else f":{int(port)}"
    path = quote(_segments(path or "/"), safe=_KEPT_PATH)
    out = f"{scheme}://{quote(user, safe=':%') + '@' if mark else ''}{host}{port}{path}"
    if query is not None:
        out += "?" + quote(query, safe="!$%&()*+,-./:;=?@_~[]|^`{}\\")
    if fragment is not None:
        out += "#" + quote(fragment, safe="!#$%&'()*+,-./:;=?@_~[]|^{}\\")
    return out


_BLANKS = "".join((" \t\n\x0b\f\r\xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff", *map(chr, range(0x2000, 0x200B))))


def js_strip(text: str) -> str:
    return text.strip(_BLANKS)


@lru_cache(50_000)
def absolute_one(url: str, base: str | None) -> str:
    """Absolute form of a link as written: mail addresses in lower case, other schemes as they are, pages resolved."""
    url = js_strip(url)
    if m := re.match(r"(?:mail|mailto):([^?]*)(.*)", url, re.I):
        return "mailto:" + m[1].strip().lower() + m[2]
    if (m := re.match(r"([a-z][a-z\d+.-]*):", url, re.I)) and m[1].lower() not in ("http", "https"):
        return url
    return resolve_one(url, base) or url


@F.pandas_udf(StringType())
def _absolute(url: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if u is None else absolute_one(u, b) for u, b in zip(url, base, strict=True)], dtype=object)


_absolute = _absolute.asNondeterministic()  # else a filter on the result would have it computed twice


@F.pandas_udf(ArrayType(StringType()))
def absolute_urls(urls: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if us is None else [absolute_one(u, b) for u in us] for us, b in zip(urls, base, strict=True)], dtype=object)


#: Addresses that are their own absolute form, and paths that only need the host of a base that is its own too.
_DONE = "^https?://[a-z0-9][a-z0-9.\\-]*[a-z0-9]/(?:[A-Za-z0-9_~/=&,;@\\-]|\\.(?![./]|$)|[?](?=[^?#]*$))*$"
_PATH = "^/(?!/)(?:[A-Za-z0-9_~/=&,;@\\-]|\\.(?![./]|$))*$"
_ORIGIN = "^(https?://[a-z0-9][a-z0-9.\\-]*[a-z0-9])(?:[/?#].*)?$"


def absolute_url(url: Column, base: Column) -> Column:
    """``url`` seen from ``base``: plain addresses and paths inside code generation, the others in Python."""
    plain = F.when(url.rlike(_DONE), url).when(url.rlike(_PATH) & base.rlike(_ORIGIN), F.concat(F.regexp_extract(base, _ORIGIN, 1), url))
    return F.coalesce(plain, _absolute(F.when(plain.isNull(), url), base))


def special_protocol(url: Column) -> Column:
    """The scheme of a URL that leads to no web page, in lower case with its colon; null for pages."""
    scheme = F.lower(F.regexp_extract(js_trim(url), "(?i)^([a-z][a-z0-9+.\\-]*:)", 1))
    return F.when(~scheme.isin("", "http:", "https:"), scheme)


def site_of(host: Column) -> Column:
    """The registrable part of a host by its last labels."""
    labels = F.split(F.regexp_replace(F.lower(host), "^www\\.", ""), "\\.")
    size = F.size(labels)
    depth = F.when((size >= 3) & F.element_at(labels, -2).isin(*SECOND_LEVEL), 3).otherwise(2)
    return F.array_join(F.slice(labels, F.greatest(size - depth + 1, F.lit(1)), depth), ".")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def is_resource(url: Column) -> Column:
    """Whether the path ends in the extension of a download; a host with such an ending is none."""
    path = F.regexp_replace(F.regexp_replace(url, "^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*", ""), "[?#].*$", "")
    return path.rlike(f"(?i)\\.(?:{'|'.join(RESOURCES)})$")


def link_kind(href: Column, resolved: Column, page: Column) -> Column:
    """special, anchor, internal or external for a link as written, its resolved form and the URL of the page."""
    plain = lambda c: F.split_part(c, F.lit("#"), F.lit(1))
    here = F.regexp_replace(plain(page), "^(https?://[^/?#]+)(?=[?#]|$)", "$1/")
    special = href.rlike(f"(?i)^[{JS_WS}]*(?!https?:)[a-z][a-z0-9+.\\-]*:")
    anchor = F.when(href.rlike(f"^[{JS_WS}]*/?#"), plain(resolved) == here).otherwise(False)
    same = site_of(host_of(resolved)) == site_of(host_of(page))
    return F.when(special, "special").when(anchor, "anchor").when(same, "internal").otherwise("external")


def kind_of(href: str, resolved: str, page: str) -> str:
    """``link_kind`` for one link, for use outside of columns."""
    scheme = re.match(r"([a-z][a-z\d+.-]*):", js_strip(href), re.I)
    if scheme and scheme[1].lower() not in ("http", "https"):
        return "special"
    here = re.sub(r"^(https?://[^/?#]+)(?=[?#]|$)", r"\1/", page.split("#")[0])
    if re.match("/?#", js_strip(href)) and resolved.split("#")[0] == here:
        return "anchor"
    return "internal" if _site(resolved) == _site(page) else "external"


def _site(url: str) -> str:
    m = re.match(r"https?://(?:[^/?#@]*@)?([^/?#:]*)", url, re.I)
    labels = (m[1] if m else "").lower().removeprefix("www.").split(".")
    return ".".join(labels[-3:] if len(labels) > 2 and labels[-2] in SECOND_LEVEL else labels[-2:])


_RESOURCE_PATH = re.compile(rf"\.(?:{'|'.join(RESOURCES)})\Z", re.I)


def resource_of(url: str) -> bool:
    """``is_resource`` for one address."""
    return bool(_RESOURCE_PATH.search(re.split("[?#]", re.sub(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*", "", url), maxsplit=1)[0]))
