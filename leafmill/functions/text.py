"""Text functions with the whitespace of scripts in browsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers' scripts know it, as the inside of a character class.
JS_WS = r"\t\n\x0B\f\r    -     　﻿"


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{JS_WS}]+|[{JS_WS}]+$", "")


def remove_hyphenation(text: Column) -> Column:
    """Without soft hyphens and zero width spaces."""
    return F.regexp_replace(text, "[\\u00ad\\u200b]", "")


def clean_text(text: Column) -> Column:
    """Hyphenation removed, white space collapsed and trimmed."""
    return js_trim(F.regexp_replace(remove_hyphenation(text), f"[{JS_WS}]+", " "))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, "[^\\x{10000}-\\x{10FFFF}]", ""))


# Words by which image metadata shows itself.
_METADATA = "8BIM|Exif|Photoshop 3\\.0|Adobe XMP Core|xmpmeta|rdf:RDF|xpacket"
_CONTROLS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"


def looks_binary(text: Column) -> Column:
    """Whether a text of 16 characters or more is image metadata or raw bytes rather than text."""
    n = utf16_length(text)
    controls = F.length(text) - F.length(F.regexp_replace(text, _CONTROLS, ""))
    return F.coalesce((n >= 16) & (text.rlike(f"(?i)(?:{_METADATA})") | text.contains("\u0000") | (controls > 20) | (controls / n > 0.05)), F.lit(False))
