"""Pages that arrive chunk by chunk, decoded as they come.

The state of a page holds its first bytes until the encoding can be told, and then no more than an incomplete character and
chunks that came before their turn, so a page of any length needs little memory. Text is given out with the batch in which
it can be told; joined by ``part`` it is the page.

Cases: null chunks are empty; a chunk delivered twice counts once; a page whose end never comes is given out up to its last
whole character; bytes that mean nothing become replacement characters; a page with less than ``HELD`` bytes comes with its
last chunk, which ``last`` marks.
"""

from __future__ import annotations

import codecs
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.sources.bytes import CP1252, known_label

#: Bytes that are held until the encoding is settled.
HELD = 1024
_META = re.compile(r"<meta[^>]*?charset\s*=\s*[\"']?\s*([^\"'>\s/;]+)", re.I)
_HEADER = re.compile(r"charset\s*=\s*[\"']?([^\"';\s]+)", re.I)
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_BE, "utf-16-be"), (codecs.BOM_UTF16_LE, "utf-16-le"))


@dataclass
class Reading:
    """Where the decoding of one page stands."""

    turn: int = 0
    held: bytes = b""
    encoding: str | None = None
    rest: tuple[bytes, int] = (b"", 0)
    early: dict[int, tuple[bytes, bool]] = field(default_factory=dict)
    part: int = 0

    def _settle(self, declared: str | None) -> None:
        for mark, name in _MARKS:
            if self.held.startswith(mark):
                self.encoding, self.held = name, self.held[len(mark) :]
                return
        start = re.sub("(?s)<!--.*?-->", "", self.held[:HELD].decode("latin-1"))
        label = m[1].lower() if (m := _META.search(start)) else ""
        meta = "utf-8" if label.startswith("utf-16") else "windows-1252" if label == "x-user-defined" else label
        given = m[1] if (m := _HEADER.search(declared or "")) else None
        self.encoding = known_label(given) or known_label(meta) or "utf-8"

    def read(self, chunks: list[tuple[int, bytes, bool]], declared: str | None) -> str:
        """The text that these chunks (number, bytes, whether the last) and those held make, as far as it can be told."""
        self.early |= {n: (b, last) for n, b, last in chunks if n >= self.turn}
        text = ""
        while self.turn in self.early:
            body, last = self.early.pop(self.turn)
            self.turn += 1
            self.held += body
            if self.encoding is None and (len(self.held) >= HELD or last):
                self._settle(declared)
            if self.encoding is not None:
                if self.encoding == "cp1252":
                    text, self.held = text + self.held.decode("latin-1").translate(CP1252), b""
                    continue
                decoder = codecs.getincrementaldecoder(self.encoding)("replace")
                decoder.setstate(self.rest)
                text += decoder.decode(self.held, last)
                self.rest, self.held = decoder.getstate(), b""
        return text


def decode_stream(chunks: DataFrame, timeout: str = "NoTimeout") -> DataFrame:
    """``(page_id, part, text)`` of a stream ``(page_id, chunk_seq, chunk, content_type, last)``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        reading = pickle.loads(state.get[0]) if state.exists else Reading()
        rows = pd.concat(list(batches))
        declared = next((c for c in rows["content_type"] if c is not None), None)
        text = reading.read([(int(n), bytes(b or b""), bool(last)) for n, b, last in zip(rows["chunk_seq"], rows["chunk"], rows["last"], strict=True)], declared)
        out = pd.DataFrame({"page_id": [key[0]], "part": [reading.part], "text": [text]}) if text else pd.DataFrame({"page_id": [], "part": [], "text": []})
        reading.part += bool(text)
        state.update((pickle.dumps(reading),))
        yield out

    given = chunks.select(F.col("page_id").cast("bigint").alias("page_id"), "chunk_seq", "chunk", "content_type", "last")
    return given.groupBy("page_id").applyInPandasWithState(run, "page_id bigint, part int, text string", "reading binary", "append", timeout)


def joined(parts: DataFrame) -> DataFrame:
    """Whole pages of the parts that a stream gave out."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "text")))
    return parts.groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("html"))
