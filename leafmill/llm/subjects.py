"""Subject areas of documents by seeded non-negative matrix factorisation.

The document-term matrix (text and code cells, weighted terms hashed to a fixed number of columns) is factored into
mixtures W and components H by alternating multiplicative updates. One component is anchored to each subject: it starts
from the terms that labelled documents of the subject have more often than others, and such terms stay closed to the
other subjects. Further components take what is common to a language or to code. W is row-local and never leaves its
task; H (fixed size) is updated on the driver from the sums W'X and W'W over all documents, which add up block by block.

With H fixed, every cell gets its own mixture W over the components, by the same updates, with each term counting by what
part of it is whose. The anchored component that holds most of the mixture is the cell's subject if it holds enough, and a
document has the subjects that hold at least the asked share of its cells.

Cases: documents without text or code cells, and empty or null texts, have no subject; null languages only lack the
seed of their language; repeated documents count each time and have rows of their own; labels of unknown documents or subjects are ignored; without
any label the anchored components are empty and nothing is assigned; very long cells are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.core import FEW_ROWS, materialize
from leafmill.llm.merge import add_up

COLUMNS = 1 << 15
ROUNDS = 4
INNER = 12
MOST_LABELS = 200_000
_TERM = re.compile(r"[^\W\d_]{3,}")
_CAMEL = re.compile(r"(?<=[a-zß-ÿ])(?=[A-Z])")


def terms(text: str) -> list[int]:
    """Hashed terms of a cell: words of three letters or more, names in code split at case changes and underscores."""
    return [crc32(w.encode()) & (COLUMNS - 1) for w in _TERM.findall(_CAMEL.sub(" ", text).lower())]


_CELLS = "doc_id bigint, lang string, kinds array<string>, sizes array<int>, terms array<int>, counts array<int>"


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("kinds", pa.list_(pa.string())), ("sizes", numbers), ("terms", numbers), ("counts", numbers)])
    for batch in batches:
        rows: list[tuple] = []
        for doc, lang, text, kinds, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text, starts = text or "", starts or []
            kept, sizes, found, counts = [], [], [], []
            for k, (kind, start) in enumerate(zip(kinds or (), starts, strict=False)):
                if kind in ("text", "code"):
                    end = starts[k + 1] if k + 1 < len(starts) else len(text)
                    t, n = np.unique(np.array(terms(text[start:end]), np.int32), return_counts=True)
                    kept.append(kind)
                    sizes.append(len(t))
                    found.append(t)
                    counts.append(n)
            if kept:
                rows.append((doc, lang, kept, sizes, np.concatenate(found), np.concatenate(counts)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def cells(documents: DataFrame) -> DataFrame:
    """The text and code cells of ``documents`` as sparse term counts: a row for each document with the terms of its cells
    one after the other and how many terms each cell has."""
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text", "cell_types", "cell_starts").mapInArrow(_cells, _CELLS)


@dataclass
class Block:
    """Rows of a sparse matrix: ``start`` has where each row begins in ``terms`` and ``counts``."""

    ids: np.ndarray
    start: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    langs: list = field(default_factory=list)

    def weighted(self, idf: np.ndarray) -> Block:
        """Logarithmic counts by rarity, rows of length one."""
        x = np.log1p(self.counts) * idf[self.terms]
        lengths = np.diff(np.append(self.start, len(x)))
        norm = np.sqrt(_row_sums(x[:, None] ** 2, self.start, lengths)[:, 0])
        return Block(self.ids, self.start, self.terms, (x / np.maximum(np.repeat(norm, lengths), 1e-9)).astype(np.float32), self.langs)

    def times(self, h: np.ndarray) -> np.ndarray:
        """X H' for components ``h``."""
        lengths = np.diff(np.append(self.start, len(self.terms)))
        return _row_sums(h.T[self.terms] * self.counts[:, None], self.start, lengths)


def _row_sums(values: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.zeros((len(start), values.shape[1]), values.dtype)
    full = lengths > 0
    if len(values):
        out[full] = np.add.reduceat(values, start[full], axis=0)
    return out


def _block(batch: pa.RecordBatch, rows: str = "documents") -> Block:
    """A batch of documents as sparse rows: one for each document, for each document's code cells, or for each cell."""
    ids = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
    t, n = (batch.column(c).flatten().to_numpy() for c in ("terms", "counts"))
    sizes = batch.column("sizes").flatten().to_numpy()
    langs = batch.column("lang").to_pylist()
    if rows == "cells":
        return Block(ids, np.cumsum(sizes) - sizes, t, n, langs)
    owner = np.repeat(np.repeat(np.arange(len(batch)), np.diff(batch.column("sizes").offsets.to_numpy())), sizes)
    if rows == "code":
        code = np.repeat(np.array([k == "code" for k in batch.column("kinds").flatten().to_pylist()], bool), sizes)
        t, n, owner = t[code], n[code], owner[code]
    key, where = np.unique(owner.astype(np.int64) * COLUMNS + t, return_inverse=True)
    total = np.bincount(where, weights=n, minlength=len(key)) if len(key) else np.zeros(0)
    return Block(ids, np.searchsorted(key // COLUMNS, np.arange(len(batch))), (key % COLUMNS).astype(np.int32), total, langs)


def mixtures(x: Block, h: np.ndarray, rounds: int = INNER) -> np.ndarray:
    """W for fixed H: multiplicative updates of all rows of a block."""
    xh, hh = x.times(h), h @ h.T
    w = np.maximum(xh, 1e-6)
    for _ in range(rounds):
        w *= xh / np.maximum(w @ hh, 1e-9)
    return w


_SUMS = "kind string, k int, part int, sums binary"
_PIECE = 4096


def _emit(kind: str, sums: np.ndarray) -> pa.RecordBatch:
    rows = [(kind, k, p // _PIECE, sums[k, p : p + _PIECE].astype(np.float64).tobytes()) for k in range(len(sums)) for p in range(0, sums.shape[1], _PIECE)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["kind", "k", "part", "sums"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for kind, k, part, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            piece = np.frombuffer(raw, np.float64)
            total[kind, k, part] = total[kind, k, part] + piece if (kind, k, part) in total else piece
    if total:
        rows = [(*key, v.tobytes()) for key, v in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["kind", "k", "part", "sums"])


def _gather(stored: DataFrame, run, sizes: dict[str, tuple[int, int]]) -> dict[str, np.ndarray]:
    """Add up the fixed-size sums that ``run`` yields for every partition; the driver gets one of each."""
    merged = add_up(stored.mapInArrow(run, _SUMS), _merge, ["kind", "k", "part"], 24)
    out = {kind: np.zeros(shape) for kind, shape in sizes.items()}
    for row in merged.collect():  # of fixed size
        piece = np.frombuffer(row.sums, np.float64)
        out[row.kind][row.k, row.part * _PIECE : row.part * _PIECE + len(piece)] = piece
    return out


@dataclass
class Model:
    """Components (subjects first), term weights and subject names; its size is fixed."""

    subjects: list[str]
    idf: np.ndarray
    h: np.ndarray
    mass: np.ndarray
    company: np.ndarray
    usual: np.ndarray

    def parts(self) -> np.ndarray:
        """The components with every term divided by its mass in all of them: what part of a term is whose.

        So terms of rare languages count like those of frequent ones. ``SUPPORT`` keeps terms seen too seldom from being
        anybody's; a term whose documents are about a subject not by ``COMPANY`` of what is possible more than all
        documents (setting-up code, say, that has a subject's word) is not the subject's.
        """
        explained = self.h * self.mass[:, None]
        part = explained / (explained.sum(axis=0) + SUPPORT)
        least = self.usual + COMPANY * (1 - self.usual)
        part[: len(self.subjects)][self.company < least[:, None]] = 0
        return part.astype(np.float32)


#: What every term starts with in every component that is open to it.
OPEN = 0.01
SUPPORT, COMPANY = 0.3, 0.35
LANGS = ("en", "de", "es", None)


def fit(stored: DataFrame, labels: DataFrame, subjects: list[str], rounds: int = ROUNDS) -> Model:
    """Factor the documents of ``stored`` (see ``cells``); ``labels(doc_id, subject)``, at most ``MOST_LABELS`` documents."""
    spark = stored.sparkSession
    place = {s: k for k, s in enumerate(subjects)}
    of: dict[int, set[int]] = {}
    for r in labels.where("doc_id IS NOT NULL AND subject IS NOT NULL").select("doc_id", "subject").distinct().orderBy(F.xxhash64("doc_id")).limit(MOST_LABELS).collect():
        if r.subject in place:
            of.setdefault(r.doc_id, set()).add(place[r.subject])
    shared = spark.sparkContext.broadcast(of)
    n = len(subjects)

    def counts(batches):
        df, seen, sums = np.zeros((1, COLUMNS)), np.zeros((1, n + 2)), np.zeros((n + 1, COLUMNS))
        for batch in batches:
            x = _block(batch)
            df[0] += np.bincount(x.terms, minlength=COLUMNS)
            seen[0, n + 1] += len(x.ids)
            ends = np.append(x.start, len(x.terms))
            for i, doc in enumerate(x.ids.tolist()):
                if mine := shared.value.get(doc):
                    there = x.terms[ends[i] : ends[i + 1]]
                    for s in (*mine, n):
                        sums[s, there] += 1 / len(mine) if s < n else 1
                        seen[0, s] += 1 / len(mine) if s < n else 1
        yield _emit("df", df)
        yield _emit("seen", seen)
        yield _emit("label", sums)

    first = _gather(stored, counts, {"df": (1, COLUMNS), "seen": (1, n + 2), "label": (n + 1, COLUMNS)})
    total, df = first["seen"][0, n + 1], first["df"][0]
    idf = np.where(df >= 2, np.log((total + 1) / (df + 0.5)), 0).clip(0).astype(np.float32)
    # Seeds: terms much more frequent under a subject's labels than under the others.
    have, seen = first["label"], first["seen"][0]
    rate = (have[:n] + 0.05) / np.maximum(seen[:n, None] + 1, 1)
    other = (have[n] - have[:n] + 0.3) / np.maximum(seen[n] - seen[:n, None] + 6, 1)
    lift = np.log(rate / other)
    seeds = np.where((lift > 0.9) & (have[:n] >= 1.5), lift * np.sqrt(have[:n] / np.maximum(seen[:n, None], 1)), 0) * idf
    closed = (seeds > 0) & (seeds < 0.5 * seeds.max(axis=0, keepdims=True))
    seeds[closed] = 0
    anchored = seeds.max(axis=0) > 0

    def commons(batches):
        sums, docs, cells = np.zeros((len(LANGS) + 1, COLUMNS)), np.zeros((len(LANGS) + 1, COLUMNS)), np.zeros((1, len(LANGS) + 1))
        for batch in batches:
            x = _block(batch).weighted(idf)
            rows = np.repeat(np.arange(len(x.ids)), np.diff(np.append(x.start, len(x.terms))))
            lang = np.array([LANGS.index(v) if v in LANGS else len(LANGS) - 1 for v in x.langs], np.int64)
            for k in range(len(LANGS)):
                pick = lang[rows] == k
                sums[k] += np.bincount(x.terms[pick], weights=x.counts[pick], minlength=COLUMNS)
                docs[k] += np.bincount(x.terms[pick], minlength=COLUMNS)
                cells[0, k] += (lang == k).sum()
            c = _block(batch, "code").weighted(idf)
            sums[len(LANGS)] += np.bincount(c.terms, weights=c.counts, minlength=COLUMNS)
            docs[len(LANGS)] += np.bincount(c.terms, minlength=COLUMNS)
            cells[0, len(LANGS)] += sum("code" in kinds for kinds in batch.column("kinds").to_pylist())
        yield _emit("common", sums)
        yield _emit("docs", docs)
        yield _emit("cells", cells)

    # Seeds of the common components: what many documents of a language, or much code, have, by how many have it.
    got = _gather(stored, commons, {"common": (len(LANGS) + 1, COLUMNS), "docs": (len(LANGS) + 1, COLUMNS), "cells": (1, len(LANGS) + 1)})
    common = got["common"] * (got["docs"] / np.maximum(got["cells"].T, 1)) ** 2
    common[:, anchored] *= 0.05
    h = np.vstack([seeds, common]).astype(np.float32)
    h /= np.maximum(np.sqrt((h**2).sum(axis=1, keepdims=True)), 1e-9)
    open_to = np.ones_like(h)
    open_to[:n][:, anchored] = (seeds[:, anchored] > 0).astype(np.float32)
    open_to[:n][seeds.max(axis=1) == 0] = 0  # a subject without any seed stays empty
    h = np.where(open_to > 0, h + OPEN, 0).astype(np.float32)

    for _ in range(rounds):
        now = spark.sparkContext.broadcast(h)

        def sums(batches, now=now):
            h = now.value
            wx, ww, ws = np.zeros((len(h), COLUMNS)), np.zeros((len(h), len(h))), np.zeros((1, len(h)))
            for batch in batches:
                x = _block(batch).weighted(idf)
                w = mixtures(x, h)
                rows = np.repeat(np.arange(len(x.ids)), np.diff(np.append(x.start, len(x.terms))))
                for k in range(len(h)):
                    wx[k] += np.bincount(x.terms, weights=w[rows, k] * x.counts, minlength=COLUMNS)
                ww += w.T @ w
                ws[0] += w.sum(axis=0)
            yield _emit("ws", ws)
            yield _emit("wx", wx)
            yield _emit("ww", ww)

        got = _gather(stored, sums, {"wx": h.shape, "ww": (len(h), len(h)), "ws": (1, len(h))})
        h = (h * got["wx"] / np.maximum(got["ww"] @ h, 1e-9) * open_to).astype(np.float32)
        mass = got["ws"][0]
    final = spark.sparkContext.broadcast(h)

    def company(batches):
        h = final.value
        sums = np.zeros((n + 1, COLUMNS))
        for batch in batches:
            x = _block(batch).weighted(idf)
            w = mixtures(x, h)[:, :n]
            w = w / np.maximum(w.sum(axis=1, keepdims=True), 0.01)
            rows = np.repeat(np.arange(len(x.ids)), np.diff(np.append(x.start, len(x.terms))))
            for k in range(n):
                sums[k] += np.bincount(x.terms, weights=w[rows, k] * x.counts, minlength=COLUMNS)
            sums[n] += np.bincount(x.terms, weights=x.counts, minlength=COLUMNS)
        yield _emit("company", sums)

    got = _gather(stored, company, {"company": (n + 1, COLUMNS)})["company"]
    return Model(subjects, idf, h, mass, got[:n] / np.maximum(got[n], 1e-9), got[:n].sum(axis=1) / max(got[n].sum(), 1e-9))


#: What a cell's mixture must hold of a subject at least, in terms.
EVIDENCE = 0.15
#: Updates of the mixture of a cell.
SETTLED = 40


def _judge(model: Model, share: float):
    parts, n = model.parts(), len(model.subjects)
    weight = parts.sum(axis=1)
    names = np.array(model.subjects, object)
    schema = pa.schema([("doc_id", pa.int64()), ("subject", pa.string()), ("share", pa.float64())])

    def run(batches):
        for batch in batches:
            x = _block(batch, "cells")
            x = Block(x.ids, x.start, x.terms, np.log2(1 + x.counts).astype(np.float32))
            w = mixtures(x, parts, SETTLED)[:, :n] * weight[:n]
            best = w.argmax(axis=1) if len(w) else np.zeros(0, np.int64)
            sure = w[np.arange(len(w)), best] >= EVIDENCE
            n_cells = np.diff(batch.column("sizes").offsets.to_numpy())
            owner = np.repeat(np.arange(len(batch)), n_cells)
            have = np.bincount(owner[sure] * n + best[sure], minlength=len(batch) * n).reshape(len(batch), n)
            doc, subject = np.nonzero((have > 0) & (have >= share * n_cells[:, None]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(names[subject], pa.string()), pa.array(have[doc, subject] / n_cells[doc])], schema=schema)

    return run


def document_subjects(stored: DataFrame, model: Model, share: float = 0.2) -> DataFrame:
    """``(doc_id, subject, share)`` of subjects that hold at least ``share`` of a document's text and code cells."""
    return stored.mapInArrow(_judge(model, share), "doc_id bigint, subject string, share double")


def assign(documents: DataFrame, labels: DataFrame, subjects: DataFrame, share: float = 0.2) -> DataFrame:
    names = [r.subject for r in subjects.where("subject IS NOT NULL").select("subject").distinct().orderBy("subject").collect()]  # the allowed subjects, a fixed list
    if not names:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, subject string, share double")
    stored = materialize(cells(documents), "p8-cells", FEW_ROWS)
    return document_subjects(stored, fit(stored, labels, names), share)
