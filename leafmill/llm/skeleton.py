"""One form of each text for all that look the same: the confusables skeleton.

The skeleton is: decompose (canonical), replace every character by the prototype of its look-alike class, decompose
again. The look-alike table is derived from the Unicode character database (wide, narrow, font, no-break and plain
compatibility forms, all spaces, all characters without ink) plus the short list of letters of other scripts that are
drawn like Latin ones. Accents, case and signs stay as they are.

Cases: null and empty texts, and texts without any ink, have no skeleton and form no pair; a leading or trailing space
cannot be seen and is dropped; equal texts as stored form no pair with each other, however often they are delivered;
characters outside the table stand for themselves.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.core import materialize

# Letters and signs that ordinary type draws like the character before the colon.
LOOKALIKES = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈᎫͿ", "K": "КΚᏦ", "L": "Ꮮ", "M": "МΜϺᎷ",
    "N": "ΝͶ", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "ҮΥ", "Z": "ΖᏃ", "a": "аɑ",
    "b": "Ьᖯ", "c": "сϲᴄ", "d": "ԁ", "e": "еҽ", "f": "ք", "g": "ɡց", "h": "һհ", "i": "іӏ", "j": "јϳ", "l": "ⅼ", "m": "ⅿ", "n": "ո", "o": "оοօᴏ",
    "p": "рρ", "q": "ԛգ", "s": "ѕꜱ", "u": "սᴜ", "v": "νѵᴠ", "w": "ԝաᴡ", "x": "х", "y": "уүʏ", "z": "ᴢ", "-": "‐‑‒−⁃﹣", "'": "ʹʼˈ", ":": "։ː∶",
    ".": "․", "/": "⁄∕", ";": ";", "!": "ǃ", "|": "∣ǀ", "~": "∼", "*": "∗", "µ": "μ",
}
#: Tags and further variation selectors, the characters without ink above the planes that the table goes through.
INKLESS = (*range(0xE0001, 0xE0080), *range(0xE0100, 0xE01F0))
_KEPT = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>"}
# Compatibility forms that look different from what they decompose to.
_DIFFERENT = set("ſℓ℮ϐϑϕϖϰϱϴϵϒ")


@lru_cache(1)
def prototypes() -> dict[int, str | None]:
    """Character code to prototype (None: no ink), from the character database and the list above."""
    table: dict[int, str | None] = {}
    for code in (*range(0x20000), *INKLESS):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind == "Zs" or ch in "\t\n\x0b\x0c\r\u0085  ":
            table[code] = " "
        elif kind in ("Cf", "Cc") or 0xFE00 <= code <= 0xFE0F or code in INKLESS or ch in "͏ᅟᅠ឴឵ㅤﾠ" or 0x180B <= code <= 0x180F:
            table[code] = None
        else:
            parts = unicodedata.decomposition(ch)
            if parts[:1] == "<" and parts.split(" ")[0] in _KEPT and ch not in _DIFFERENT:
                full = unicodedata.normalize("NFKD", ch)
                if not full.startswith(" "):
                    table[code] = full
    for plain, others in LOOKALIKES.items():
        for ch in others:
            table[ord(ch)] = plain
    for code, form in table.items():
        if form and len(form) <= 4:
            table[code] = "".join(table.get(ord(c), c) or "" if c != chr(code) else c for c in form)
    return table


def skeleton(text: str | None) -> str:
    """The form that all texts looking like ``text`` share; empty if nothing of it can be seen."""
    if not text:
        return ""
    if text.isascii() and text.isprintable():
        return text.strip(" ")
    form = unicodedata.normalize("NFD", text).translate(prototypes())
    return unicodedata.normalize("NFD", form).strip(" ")


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        forms = pa.array([skeleton(t) for t in texts], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, forms], [*batch.schema.names, "skeleton"])


def with_skeleton(records: DataFrame) -> DataFrame:
    """``records(field, rec_id, page_id, text)`` with their ``skeleton``; rows without any ink are left out."""
    kept = records.where("text <> ''").select("field", F.col("rec_id").cast("bigint").alias("rec_id"), F.col("page_id").cast("bigint").alias("page_id"), "text")
    return kept.mapInArrow(_add, "field string, rec_id bigint, page_id bigint, text string, skeleton string").where("skeleton <> ''")


def _unusual(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text is not the composed form of its own skeleton, with the bit of their key."""
    for batch in _add(batches):
        texts, forms = batch.column("text").to_pylist(), batch.column("skeleton").to_pylist()
        odd = batch.filter(pa.array([bool(f) and unicodedata.normalize("NFC", f) != t for t, f in zip(texts, forms, strict=True)], pa.bool_()))
        yield pa.RecordBatch.from_arrays([*odd.columns, pa.array(_bits(odd), pa.int32())], [*odd.schema.names, "bit"])


def _bits(batch: pa.RecordBatch) -> list[int]:
    """The bit of each row's key in a map of ``BITS``."""
    return [crc32(f"{f}|{p}|{s}".encode("utf-8", "surrogatepass")) & (BITS - 1) for f, p, s in zip(*(batch.column(c).to_pylist() for c in _KEY), strict=True)]


def _likely(maps):
    """Rows with their skeleton whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = maps.value
        for batch in _add(batches):
            yield batch.filter(pa.array([known[b >> 3] >> (b & 7) & 1 == 1 for b in _bits(batch)], pa.bool_()))

    return run


#: Bits that stand for keys in the filter that goes before the join: 2 MB whatever the corpus, made in maps of ``WIDTH`` bits.
BITS, WIDTH = 1 << 24, 1 << 15
_KEY = ["field", "page_id", "skeleton"]


def ambiguous(records: DataFrame) -> DataFrame:
    """The rows of ``records`` with their skeleton in every (field, page, skeleton) that is stored in more than one way.

    Of differing texts with one skeleton at least one is not the composed form of the skeleton. The keys of such texts,
    hashed, are written first; only rows with one of these keys go on, most others are stopped by a bit map of fixed size
    before anything is shuffled. Groups are then recognised from their smallest and largest text, which aggregate
    before the shuffle, so a hot group costs one row a task; the semi joins may be split where they are skewed.
    """
    key = F.xxhash64(*_KEY)
    kept = records.where("text <> ''").select("field", F.col("rec_id").cast("bigint").alias("rec_id"), F.col("page_id").cast("bigint").alias("page_id"), "text")
    odd = kept.where(F.col("text").rlike(r"[^\x20-\x7e]|^ | $"))
    unusual = odd.mapInArrow(_unusual, "field string, rec_id bigint, page_id bigint, text string, skeleton string, bit int")
    keys = materialize(unusual.select(key.alias("key"), "bit").distinct(), "p2-keys")
    maps = bytearray(BITS // 8)
    for row in keys.groupBy(F.expr(f"bit div {WIDTH}").alias("map")).agg(F.bitmap_construct_agg(F.col("bit") % WIDTH).alias("bits")).collect():  # of fixed size
        maps[row.map * WIDTH // 8 : (row.map + 1) * WIDTH // 8] = row.bits
    shared = records.sparkSession.sparkContext.broadcast(bytes(maps))
    likely = kept.mapInArrow(_likely(shared), "field string, rec_id bigint, page_id bigint, text string, skeleton string").where("skeleton <> ''")
    near = likely.withColumn("key", key).join(keys.select("key"), "key", "left_semi").drop("key")
    near = materialize(near, "p2-near")
    mixed = near.groupBy(*_KEY).agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo <> hi").select(*_KEY)
    return near.join(mixed, _KEY, "left_semi")


def lookalike_pairs(mixed: DataFrame) -> DataFrame:
    """``(field, id_a, id_b)``, id_a < id_b, of records in ``mixed`` with one skeleton and differing texts."""
    a = mixed.select(*_KEY, F.col("rec_id").alias("ra"), F.col("text").alias("ta"))
    b = mixed.select(*_KEY, F.col("rec_id").alias("rb"), F.col("text").alias("tb"))
    pairs = a.join(b, _KEY).where("ta < tb AND ra <> rb")
    return pairs.select("field", F.least("ra", "rb").alias("id_a"), F.greatest("ra", "rb").alias("id_b")).distinct()
