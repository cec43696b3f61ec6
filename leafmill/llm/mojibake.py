"""Text decoded with the wrong character encoding: found, and restored where the bytes can still be told.

1. One scan counts adjacent character pairs (case, digits and ideographs folded) into a table of fixed size.
2. A pair's score is its mutual information with a cubed joint term, log p(xy)^3 / (p(x) p(y)): pairs that occur together
   always but seldom at all, as garbled pairs do, score low, which plain mutual information would not give.
3. In each text the maximum-scoring segments of (threshold - score) are the improbable runs. The threshold is a quantile
   of the corpus's own pair mass.
4. Only inside these runs inverse mappings are tried: back to bytes with the encoding that may have been used wrongly,
   then UTF-8 or another encoding; the result counts if its pairs are clearly more probable. This repeats for text that
   was garbled more than once. A replacement character (U+FFFD) is a wrong decoding that cannot be restored.

Cases: null and empty texts are never found; a text counts once in the statistics, however many rows have it; texts whose
spans of characters beyond ASCII are UTF-8 throughout are found without an improbable pair too; repeated rows are found once; a corpus of any
size works, with fewer pairs known the UTF-8 test, which checks itself, still holds; very long texts are scored in full.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 20
CHARS = 0x10001
QUANTILE = 0.1
#: What an inverse mapping must take away from the sum by which pairs lie below the threshold, in all and for each
#: character beyond ASCII, and the share of it that may be left. UTF-8 checks itself: a letter followed by signs that
#: together decode to a known character need not gain anything. One single-byte encoding for another has no such check.
GAIN_UTF8, LEFT_UTF8, LOSS_SURE = 2.0, 0.65, 2.0
GAIN, GAIN_EACH, LEFT = 6.0, 2.2, 0.4
#: Encodings that text is commonly read in by mistake, and the ones it was really written in.
SINGLE = ("cp1252", "latin_1", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859_2", "iso8859_5", "iso8859_7", "koi8_r", "cp437", "cp850", "cp852", "cp866", "mac_roman")
DOUBLE = ("cp932", "euc_jp", "gbk", "big5", "euc_kr")
WRITTEN = ("cp1252", "cp1250", "cp1251", "cp1253", "iso8859_5", "iso8859_7", "koi8_r", "cp437", "cp850", "cp866", "mac_roman", "cp932", "euc_jp")


@lru_cache(1)
def _fold_table() -> np.ndarray:
    """Character code to the symbol that is counted."""
    out = np.arange(CHARS, dtype=np.int64)
    for c in range(0xD800):
        ch = chr(c)
        low = ch.lower()
        out[c] = 0x30 if ch.isdigit() else 0x20 if ch.isspace() else ord(low) if len(low) == 1 else c
    out[0x3400:0xA000] = 0x4E00
    out[0xAC00:0xD7A4] = 0xAC00
    return out


def _codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), CHARS - 1)


def _symbols(text: str) -> np.ndarray:
    return _fold_table()[_codes(text)]


def _bucket(pairs_a: np.ndarray, pairs_b: np.ndarray) -> np.ndarray:
    x = (pairs_a.astype(np.uint64) << np.uint64(17)) ^ pairs_b.astype(np.uint64)
    return (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs, chars, stored = np.zeros(BUCKETS, np.int64), np.zeros(CHARS, np.int64), np.zeros(CHARS, np.int64)
    for batch in batches:
        texts = "\n".join(t for t in batch.column(0).to_pylist() if t)
        stored += np.bincount(_codes(texts), minlength=CHARS)
        s = _symbols(texts)
        chars += np.bincount(s, minlength=CHARS)
        pairs += np.bincount(_bucket(s[:-1], s[1:]), minlength=BUCKETS)
    for kind, counts in (("p", pairs), ("c", chars), ("s", stored)):
        at = np.flatnonzero(counts)
        for k in range(0, len(at), 50_000):
            part = at[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(part)), pa.array(part.astype(np.int32)), pa.array(counts[part])], ["kind", "slot", "n"])


class PairModel:
    """Pair scores from corpus counts; its size is fixed."""

    def __init__(self, pairs: np.ndarray, chars: np.ndarray, stored: np.ndarray):
        total = max(1.0, float(pairs.sum()))
        self.log_pair = np.log((pairs + 0.02) / total).astype(np.float32)
        self.log_char = np.log((chars + 0.5) / total).astype(np.float32)
        self.threshold = -18.0
        self.known = stored > 0

    def scores(self, symbols: np.ndarray) -> np.ndarray:
        if len(symbols) < 2:
            return np.zeros(0, np.float32)
        return 3 * self.log_pair[_bucket(symbols[:-1], symbols[1:])] - self.log_char[symbols[:-1]] - self.log_char[symbols[1:]]

    def settle(self, mass: list[tuple[float, int]]) -> None:
        """Set the threshold to the quantile of the pair mass given as (score, count)."""
        if mass:
            s, n = np.array([m[0] for m in mass]), np.array([m[1] for m in mass], float)
            order = np.argsort(s)
            self.threshold = float(s[order][np.searchsorted(np.cumsum(n[order]) / n.sum(), QUANTILE)])

    def badness(self, text: str) -> float:
        """How far the pairs with a character beyond ASCII lie below the threshold, in total."""
        codes = _codes(text)
        s = self.scores(_fold_table()[codes])
        wide = codes > 0x7F
        return float((np.clip(self.threshold - s, 0, 8) * (wide[:-1] | wide[1:])).sum()) if len(codes) > 1 else 0.0


def fit(texts: DataFrame) -> PairModel:
    """Pair statistics over every row of ``texts(text)``; the driver gets at most ``BUCKETS + 2 * CHARS`` counters."""
    counted = texts.mapInArrow(_count, "kind string, slot int, n bigint").groupBy("kind", "slot").agg(F.sum("n").alias("n")).toPandas()
    pairs, chars, stored = np.zeros(BUCKETS, np.int64), np.zeros(CHARS, np.int64), np.zeros(CHARS, np.int64)
    for kind, into in (("p", pairs), ("c", chars), ("s", stored)):
        part = counted[counted.kind == kind]
        into[part.slot.to_numpy()] = part.n.to_numpy()
    model = PairModel(pairs, chars, stored)
    # The bucket alone does not name its characters, so the mass of scores is taken from the symbols that do occur.
    seen = np.flatnonzero(chars)
    mass: list[tuple[float, int]] = []
    for a in seen:
        b = _bucket(np.full(len(seen), a), seen)
        n = pairs[b]
        if n.any():
            s = 3 * model.log_pair[b] - model.log_char[a] - model.log_char[seen]
            keep = n > 0
            mass += [(float(x), int(y)) for x, y in zip(s[keep], n[keep], strict=True)]
    model.settle(mass)
    return model


def runs(weights: np.ndarray) -> list[tuple[int, int]]:
    """All maximal scoring segments [start, end) of a weight sequence (Ruzzo and Tompa), in linear time."""
    out: list[list[float]] = []  # start, end, sum before, sum through
    total = 0.0
    for i, w in enumerate(weights.tolist()):
        before, total = total, total + w
        if w <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j -= 1
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3]]
            del out[j:]
    return [(int(s), int(e)) for s, e, _, _ in out]


@lru_cache(64)
def _bytes_of(encoding: str, recased: bool = False) -> dict[str, tuple[int, ...]]:
    """Character to the bytes that it may have been in a single-byte encoding; undefined bytes stay control characters.

    ``recased``: the text was put in one case after the wrong decoding; a character stands for its other case too.
    """
    exact = {}
    for b in range(256):
        try:
            ch = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            ch = chr(b)
        exact.setdefault(ch, b)
    out: dict[str, list[int]] = {ch: [b] for ch, b in exact.items()}
    for ch, b in exact.items() if recased else ():
        for other in (ch.lower(), ch.upper()):
            if len(other) == 1 and b > 0x7F and b not in out.setdefault(other, []):
                out[other].append(b)
    return {k: tuple(v) for k, v in out.items()}


def _sensible(ch: str) -> bool:
    return unicodedata.category(ch)[0] in "LNPSZ" or unicodedata.category(ch) == "Cf" and ch in "­​‌‍⁠﻿"


@lru_cache(64)
def _utf8_shape(encoding: str, recased: bool) -> re.Pattern:
    """What the first two bytes of a UTF-8 sequence look like in an encoding: a cheap test before the exact one."""
    table = _bytes_of(encoding, recased)
    leads = "".join(c for c, b in table.items() if any(0xC2 <= x <= 0xF4 for x in b))
    follow = "".join(c for c, b in table.items() if any(0x80 <= x <= 0xBF for x in b))
    return re.compile(f"[{re.escape(leads)}][ {re.escape(follow)}]")


def _utf8_inside(text: str, encoding: str, recased: bool, known: np.ndarray) -> tuple[str, int]:
    """``text`` with every UTF-8 sequence that was read in ``encoding`` decoded; 0 without any, 2 if all are sure ones."""
    table = _bytes_of(encoding, recased)
    out, i, hit, n = [], 0, 0, len(text)
    while i < n:
        done = False
        if ord(text[i]) > 0x7F or text[i] in "~}":
            for lead in table.get(text[i], ()):
                size = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
                if not size or i + size > n:
                    continue
                spaced = lead in (0xC2, 0xC3)  # a no-break space that became a plain one
                raw = [lead]
                for ch in text[i + 1 : i + size]:
                    raw += [b for b in table.get(ch, ()) if 0x80 <= b <= 0xBF][:1] or ([0xA0] if ch == " " and spaced else [])
                if len(raw) != size:
                    continue
                try:
                    ch = bytes(raw).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if _sensible(ch) and not (" " in text[i : i + size] and ch.lower() == text[i].lower()):
                    out.append(ch)
                    i += size
                    sure = text[i - size].isalpha() and not any(c.isalnum() or c == " " for c in text[i - size + 1 : i]) and known[min(ord(ch), CHARS - 1)]
                    hit = min(hit or 2, 2 if sure else 1)
                    done = True
                    break
        if not done:
            out.append(text[i])
            i += 1
    return "".join(out), hit


_PRIVATE = {"": b"\xa0", "": b"\xfd", "": b"\xfe", "": b"\xff"}


def _raw(text: str, encoding: str) -> bytes | None:
    """The bytes of ``text`` in the encoding it was read in."""
    if encoding in DOUBLE:
        out = b""
        for ch in text:
            try:
                out += _PRIVATE.get(ch) or (ch.encode(encoding) if ord(ch) > 0x9F or ord(ch) < 0x80 else bytes([ord(ch)]))
            except UnicodeEncodeError:
                return None
        return out
    table = _bytes_of(encoding)
    try:
        return bytes(table[ch][0] for ch in text)
    except KeyError:
        return None


def _utf8_from_double(text: str, encoding: str) -> str | None:
    raw = _raw(text, encoding)
    if raw is None:
        return None
    try:
        out = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return out if out != text and all(_sensible(c) or c in "\n\t" for c in out) else None


def _spread(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of pairs as spans of characters, grown over the characters beyond ASCII that touch them, then merged."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        e += 1
        if not any(ord(c) > 0x7F for c in text[s:e]):
            continue
        while s > 0 and ord(text[s - 1]) > 0x7F:
            s -= 1
        while e < len(text) and ord(text[e]) > 0x7F:
            e += 1
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _entities(text: str) -> str | None:
    """Numeric references beyond ASCII as characters."""
    out = re.sub(r"&#(\d{3,5});", lambda m: chr(int(m[1])) if 127 < int(m[1]) < 0xD800 else m[0], text)
    return out if out != text else None


def restore(text: str, model: PairModel, spans: list[tuple[int, int]] | None = None, rounds: int = 3) -> str | None:
    """The text as it was written, as far as it can be told; None if no inverse mapping makes an improbable run probable."""
    if rounds == 0 or not text:
        return None
    plain = _entities(text)
    if plain and (again := restore(plain, model, None, rounds - 1)):
        return again
    if spans is None:
        spans = runs(np.clip(model.threshold - model.scores(_symbols(text)), -6, 6))
    areas = _spread(text, spans)
    if not areas:
        return _whole_utf8(text, model, rounds)
    before, best, gain = model.badness(text), None, -LOSS_SURE

    def offer(candidate: str | None, kind: int) -> None:
        """kind: 1 for UTF-8, 2 for UTF-8 that is sure."""
        nonlocal best, gain
        if candidate is None or candidate == text:
            return
        if again := restore(candidate, model, None, rounds - 1):
            candidate = again
        left = model.badness(candidate)
        won = before - left
        if won <= gain:
            return
        if kind == 1 and (won < GAIN_UTF8 or left > LEFT_UTF8 * before or not _known(candidate, model, 0.8)):
            return
        best, gain = candidate, won

    recased = text in (text.lower(), text.upper())
    for encoding in SINGLE:
        if not _utf8_shape(encoding, recased).search(text):
            continue
        pieces, at, kinds = [], 0, set()
        for s, e in areas:
            piece, kind = _utf8_inside(text[s:e], encoding, recased, model.known)
            pieces += [text[at:s], piece]
            kinds.add(kind)
            at = e
        if kinds - {0}:
            offer("".join([*pieces, text[at:]]), min(kinds - {0}))
    for encoding in DOUBLE if any(ord(c) > 0x2E00 for s, e in areas for c in text[s:e]) else ():
        offer(_utf8_from_double(text, encoding), 1)
        for s, e in areas:
            for end in (e, min(e + 1, len(text))):
                piece = _utf8_from_double(text[s:end], encoding)
                if piece:
                    offer(text[:s] + piece + text[end:], 1)
    wide = sum(ord(c) > 0x7F for s, e in areas for c in text[s:e])
    if best is None and before >= max(GAIN, GAIN_EACH * wide):
        ranked = [(left, c) for c, left in _reread(text, areas, model) if before - left >= max(GAIN, GAIN_EACH * wide) and left <= LEFT * before]
        best = min(ranked)[1] if ranked else None
    return best if best is not None else _whole_utf8(text, model, rounds)


#: A single character between plain ones is no UTF-8 sequence that was read wrongly.
_WIDE = re.compile(r"[^\x00-\x7F]{2,}")


def _whole_utf8(text: str, model: PairModel, rounds: int) -> str | None:
    """``text`` decoded where all its spans beyond ASCII are UTF-8 to the last character, whatever their pairs score.

    Nothing but UTF-8 comes out even like this, so no improbable pair is asked for; a single character in place of letters
    only is too little to tell, but for box drawings, which no text has.
    """
    spans = _WIDE.findall(text)
    if not spans:
        return None
    recased, found = text in (text.lower(), text.upper()), []
    for encoding in SINGLE:
        shape = _utf8_shape(encoding, recased)
        if not all(shape.match(s) for s in spans):
            continue
        pairs = [_utf8_inside(s, encoding, recased, model.known) for s in spans]
        new = "".join(piece for piece, _ in pairs)
        whole = all(len(piece.encode("utf-8", "surrogatepass")) == len(s) for s, (piece, _) in zip(spans, pairs, strict=True))
        if whole and (len(new) > 1 or "\u2500" <= spans[0][0] <= "\u259f" or spans[0][0].isalpha() and not any(c.isalpha() for c in spans[0][1:])) and _known(new, model):
            pieces = iter(pairs)
            candidate = _WIDE.sub(lambda _: next(pieces)[0], text)  # noqa: B023
            candidate = restore(candidate, model, None, rounds - 1) or candidate
            found.append((model.badness(candidate), candidate))
    best = min(found, default=None)
    return best[1] if best and best[0] <= model.badness(text) + LOSS_SURE else None


@lru_cache(1)
def _swaps() -> list[tuple[frozenset[str], list[dict[int, str]]]]:
    """For each single-byte encoding its characters beyond ASCII, and their meaning in each other single-byte one."""
    out = []
    for read in SINGLE:
        table = {ch: b[0] for ch, b in _bytes_of(read).items() if ord(ch) > 0x7F}
        maps = []
        for written in WRITTEN:
            if written == read or written in DOUBLE:
                continue
            meaning = {}
            for ch, b in table.items():
                try:
                    new = bytes([b]).decode(written)
                except UnicodeDecodeError:
                    new = "\0"
                keeps = not ch.isalpha() or new.isalpha() or new in "‘’“”–—…"
                meaning[ord(ch)] = new if keeps and not new.isspace() and ord(new) > 0xA0 else "\0"
            maps.append(meaning)
        out.append((frozenset(table), maps))
    return out


def _inside(text: str, areas: list[tuple[int, int]], change) -> str | None:
    """``text`` with each area changed; None if one cannot be."""
    pieces, at = [], 0
    for s, e in areas:
        new = change(text[s:e])
        if new is None:
            return None
        pieces += [text[at:s], new]
        at = e
    return "".join([*pieces, text[at:]])


def _reread(text: str, areas: list[tuple[int, int]], model: PairModel) -> list[tuple[str, float]]:
    """``text`` with its improbable areas read in every other encoding that gives only characters the corpus knows, and the
    badness of each. What explains the areas is applied to the rest of the text too where that leaves less badness."""
    letters = {c for s, e in areas for c in text[s:e] if ord(c) > 0x7F}
    everywhere = {c for c in text if ord(c) > 0x7F}
    found: set[str] = set()
    wide = sum(ord(c) > 0x7F for s, e in areas for c in text[s:e])
    if everywhere > letters and wide < 2:
        return []  # one odd letter beside others that stay is a look-alike
    double = wide >= 2 and any(ord(c) > 0x2E00 for c in letters)

    def good(new: str) -> bool:
        return new != "\0" and bool(model.known[min(ord(new), CHARS - 1)]) and _sensible(new)

    for read, (has, maps) in zip(SINGLE, _swaps(), strict=True):
        if not letters <= has:
            continue
        for meaning in maps:
            if all(good(meaning[ord(c)]) for c in letters) and _fits(candidate := _inside(text, areas, lambda t: t.translate(meaning))):  # noqa: B023
                found.add(candidate)
                if everywhere > letters and everywhere <= has and all(good(meaning[ord(c)]) for c in everywhere) and _fits(whole := text.translate(meaning)):
                    found.add(whole)
    for read in (*SINGLE, *(DOUBLE if double else ())):
        if read in SINGLE and not letters <= _swaps()[SINGLE.index(read)][0]:
            continue
        for written in WRITTEN:
            if written == read or written not in DOUBLE and read not in DOUBLE:
                continue

            def again(t: str) -> str | None:
                raw = _raw(t, read)  # noqa: B023
                try:
                    return raw.decode(written) if raw is not None else None  # noqa: B023
                except UnicodeDecodeError:
                    return None

            for candidate in (_inside(text, areas, again), again(text)):
                if candidate is not None and _known(candidate, model):
                    found.add(candidate)
    found.discard(text)
    return [(c, model.badness(c)) for c in sorted(found)]


_MISFIT = re.compile(r"[a-z][^\W\d_a-z\u00df-\u024f]|[^\W\d_A-Z\u00c0-\u024f][A-Za-z]|[A-Za-z][^\W\d_A-Za-z\u00c0-\u024f]")


def _fits(text: str) -> bool:
    """Whether no word mixes Latin with other letters or has a capital after a small letter beyond ASCII."""
    small = None
    for c in text:
        if ord(c) > 0x7F and c.isupper() and small:
            return False
        small = c.islower()
    return not any(ord(c) > 0x24F for c in "".join(_MISFIT.findall(text)))


def _known(text: str, model: PairModel, share: float = 1.0) -> bool:
    """Whether of the characters beyond ASCII at least ``share`` are letters and signs that the corpus has."""
    wide = [c for c in text if ord(c) > 0x7F]
    return sum(_sensible(c) and bool(model.known[min(ord(c), CHARS - 1)]) for c in wide) >= share * len(wide)


#: Characters after which a text is divided at the next border; every stretch is judged by itself, whatever the length.
STRETCH = 300
_BREAK = re.compile(r"[ \t\n\r]|[\u3001\u3002\uff01\uff1f]|(?<=[\x00-\x7f])(?=[\x00-\x7f])")


def stretches(text: str) -> list[str]:
    """The text in pieces of ``STRETCH`` characters and what follows up to a border that no garbled sequence holds."""
    out, at = [], 0
    while at < len(text):
        m = _BREAK.search(text, at + STRETCH)
        end = m.end() if m else len(text)
        out.append(text[at:end])
        at = end
    return out


def restore_all(text: str, model: PairModel) -> str | None:
    """``restore`` for every stretch of a text."""
    pieces = stretches(text)
    better = [restore(p, model) if not p.isascii() or "&#" in p else None for p in pieces]
    return "".join(b or p for b, p in zip(better, pieces, strict=True)) if any(better) else None


def _detect(model: PairModel):
    schema = pa.schema([("field", pa.string()), ("rec_id", pa.int64()), ("text", pa.string()), ("restored", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[bool, str | None]] = {}
        for batch in batches:
            fields, ids, texts = (c.to_pylist() for c in batch.columns)
            fresh = list({t for t in texts if t not in known})
            judged = {t: known[t] for t in texts if t in known}
            judge_all(fresh, model, judged)
            rows = [(f, i, t, judged[t][1]) for f, i, t in zip(fields, ids, texts, strict=True) if judged[t][0]]
            if len(known) > 100_000:
                known.clear()
            known |= {t: j for t, j in judged.items() if len(t) <= 200}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def judge_all(texts: list[str], model: PairModel, into: dict[str, tuple[bool, str | None]]) -> None:
    """For each text whether it is garbled and, if so, its restored form or None."""
    for t in texts:
        restored = restore_all(t, model) if not t.isascii() or "&#" in t else None
        into[t] = (restored is not None or "\ufffd" in t, restored)


def detect(records: DataFrame, model: PairModel) -> DataFrame:
    """Rows ``(field, rec_id, text, restored)`` of garbled records; ``restored`` is null where nothing can be told."""
    odd = records.where(F.col("text").rlike(r"[^\x00-\x7F]|&#")).select("field", F.col("rec_id").cast("bigint").alias("rec_id"), "text")
    shared = records.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _detect(shared.value)(batches)

    return odd.mapInArrow(run, "field string, rec_id bigint, text string, restored string")


def distinct_texts(records: DataFrame) -> DataFrame:
    """Every text once, so that copies of a garbled one cannot make its pairs probable."""
    return records.where("text <> ''").select("text").distinct()


def garbled(records: DataFrame) -> DataFrame:
    """All garbled rows of ``records(field, rec_id, text)``, each key and text once."""
    model = fit(distinct_texts(records))
    return detect(records, model).dropDuplicates(["field", "rec_id", "text"])
