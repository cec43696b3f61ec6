"""Evaluation texts that stand in the corpus, found through a distributed positional inverted index.

1. The index is divided by document, as large search systems divide it: each stored row has the postings (term, position)
   of one document, and a task turns its rows into the posting lists of its shard. Tokens that no test item uses cannot
   take part in a match and are not stored; positions count all words.
2. Term frequencies come from the stored index. Every run of an item, and for inexact matches a few more pairs of adjacent
   words than words may differ, is looked up term by term from the rarest on: the list of the rarest term is intersected
   with the offset-adjusted list of the next rarest, and so on, so that frequent terms are only asked about places that
   are left. A match lies in one document, so nothing is shuffled for it.
3. A run whose words all stand on one diagonal (position minus offset in the item) is an exact phrase. An inexact match
   changes at most so many pairs as words may differ: where enough pairs are left on near diagonals, the edit distance of
   the whole item to that stretch of the document decides (proximity).

Words are runs of letters and digits, case folded; markup, escapes and borders of cells separate words and count nothing.
Test items of more than ``MOST_WORDS`` words are taken in blocks, each with an index of the words that it uses.

Cases: null and empty texts hold nothing and leak nothing; an item without words is left out; an item shorter than the
run counts only as a whole; repeated items and documents each give their own rows; ties in rarity are broken by term, so
results do not depend on partitioning; an item that stands in very many documents makes rows, not groups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.core import FEW_ROWS, materialize

RUN = 10
ONE_IN = 6
#: Pairs of words that an inexact match keeps at least, where the item is long enough.
KEPT = 3
#: Words of test items that are looked up at once; more are taken in blocks.
MOST_WORDS = 2_000_000
#: Places that are followed at once in a task; more are followed in turns.
AT_ONCE = 500_000
_TAGS = "a b i u p em br hr td th tr li ul ol dl dt dd div pre sup sub img span code font mark strong small table tbody thead h[1-6] blockquote center section".split()
_MARKUP = re.compile(rf"</?(?:{'|'.join(_TAGS)})(?:[ \t\n\x0b\f\r][^<>]*)?/?>|\\[nrt](?:(?<=[^\W_]\\[nrt])|(?![a-z]))|&(?:[a-z]{{2,6}}|#[0-9]{{1,6}});")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text, in order."""
    return _WORD.findall(_MARKUP.sub(" ", text.lower())) if text else []


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many as ``n`` says, one range after the other."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + n, n)


class Chains:
    """Sequences of places in the items, rarest first, with their common beginnings found once."""

    def __init__(self, places: list[tuple[int, ...]], width: int):
        self.places = np.array(places, np.int64).reshape(-1, width)
        # chains by their first two places, these by the first
        self.order = np.lexsort((self.places[:, 1], self.places[:, 0])) if len(places) else np.zeros(0, np.int64)
        pairs, self.n_chains = np.unique(self.places[:, :2], axis=0, return_counts=True)
        self.seconds = pairs[:, 1]
        self.firsts, self.n_pairs = np.unique(pairs[:, 0], return_counts=True)
        self.pair_start = np.cumsum(self.n_pairs) - self.n_pairs
        self.chain_start = np.cumsum(self.n_chains) - self.n_chains


@dataclass(frozen=True)
class Items:
    """Test items one after the other: their terms, where each begins, and what is looked up."""

    ids: np.ndarray
    terms: np.ndarray
    begin: np.ndarray
    edits: np.ndarray
    runs: Chains
    run_item: np.ndarray
    pairs: Chains
    pair_item: np.ndarray
    need: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, tuple[int, ...]]], frequency: dict[int, int]) -> Items:
        begin = np.cumsum([0, *(len(ts) for _, ts in rows)])
        runs, run_item, pairs, pair_item, need = [], [], [], [], []
        for k, (_, ts) in enumerate(rows):
            rarity = [(frequency.get(t, 0), t, o) for o, t in enumerate(ts)]
            for s in range(len(ts) - RUN + 1):
                runs.append(tuple(begin[k] + o for *_, o in sorted(rarity[s : s + RUN])))
                run_item.append(k)
            free, chosen = [True] * len(ts), 0
            edits = len(ts) // ONE_IN
            for _, _, o in sorted(rarity):
                near = min((rarity[p] for p in (o - 1, o + 1) if 0 <= p < len(ts) and free[p]), default=None)
                if free[o] and (near or len(ts) == 1) and chosen < edits + KEPT:
                    other = near[2] if near else o
                    free[o] = free[other] = False
                    pairs.append((begin[k] + o, begin[k] + other))
                    pair_item.append(k)
                    chosen += 1
            need.append(chosen - edits)
        number = lambda xs: np.array(xs, np.int64)
        return cls(number([i for i, _ in rows]), number([t for _, ts in rows for t in ts]), begin, np.diff(begin) // ONE_IN, Chains(runs, RUN), number(run_item), Chains(pairs, 2), number(pair_item), number(need))


class Shard:
    """The posting lists of some documents, and the same postings by position."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, pos: np.ndarray, n_docs: int):
        order = np.argsort(term, kind="stable")
        self.term, self.doc, self.pos = term[order], doc[order], pos[order]
        self.length = np.zeros(n_docs, np.int64)
        np.maximum.at(self.length, doc, pos + 1)
        self.base = np.cumsum(self.length) - self.length
        self.row = np.full(int(self.length.sum()), -1, np.int32)
        self.row[self.base[doc] + pos] = term

    def has(self, doc: np.ndarray, pos: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Whether the term stands at the position of the document."""
        inside = (pos >= 0) & (pos < self.length[doc])
        out = np.zeros(len(doc), bool)
        out[inside] = self.row[self.base[doc[inside]] + pos[inside]] == term[inside]
        return out

    def standing(self, chains: Chains, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, position minus place, chain) where all words of a chain stand on one diagonal."""
        first = np.searchsorted(self.term, terms[chains.firsts], "left")
        n = np.searchsorted(self.term, terms[chains.firsts], "right") - first
        turn = np.cumsum(n * chains.n_pairs) // AT_ONCE
        out = []
        for t in np.unique(turn[n > 0]):
            here = np.flatnonzero((turn == t) & (n > 0))
            posting = _ranges(first[here], n[here])
            head = np.repeat(here, n[here])
            doc, shift = self.doc[posting], self.pos[posting] - chains.firsts[head]
            pair = _ranges(chains.pair_start[head], chains.n_pairs[head])
            doc, shift = np.repeat(doc, chains.n_pairs[head]), np.repeat(shift, chains.n_pairs[head])
            keep = self.has(doc, shift + chains.seconds[pair], terms[chains.seconds[pair]])
            doc, shift, pair = doc[keep], shift[keep], pair[keep]
            many = chains.n_chains[pair]
            chain = chains.order[_ranges(chains.chain_start[pair], many)]
            doc, shift = np.repeat(doc, many), np.repeat(shift, many)
            for column in chains.places.T[2:]:
                keep = self.has(doc, shift + column[chain], terms[column[chain]])
                doc, shift, chain = doc[keep], shift[keep], chain[keep]
            out.append((doc, shift, chain))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def longest_run(row: np.ndarray, item: np.ndarray) -> int:
    """Most consecutive words of the item that stand consecutively in a stretch of a document."""
    run, best = np.zeros(len(row) + 1, np.int64), 0
    for t in item:
        run[1:] = np.where(row == t, run[:-1] + 1, 0)
        best = max(best, int(run.max()))
    return best


def distance_inside(row: np.ndarray, item: np.ndarray) -> int:
    """Fewest replaced, dropped and added words that turn the item into a part of a stretch of a document."""
    steps = np.arange(len(row) + 1)
    cost = np.zeros(len(row) + 1, np.int64)
    for t in item:
        step = np.minimum(np.concatenate(([cost[0] + 1], cost[:-1] + (row != t))), cost + 1)
        cost = np.minimum.accumulate(step - steps) + steps
    return int(cost.min())


def _same(*columns: np.ndarray) -> np.ndarray:
    """For each row but the first, whether all columns are as in the row before."""
    return np.logical_and.reduce([c[1:] == c[:-1] for c in columns])


def search(shard: Shard, items: Items) -> list[tuple[int, int, int, int | None]]:
    """(document, item, longest run, edits): matches of a shard, exact ones by run, others as a whole."""
    doc, shift, run = shard.standing(items.runs, items.terms)
    item = items.run_item[run]
    order = np.lexsort((run, shift, doc))
    doc, shift, run, item = doc[order], shift[order], run[order], item[order]
    exact: dict[tuple[int, int], int] = {}
    if len(doc):
        starts = np.flatnonzero(np.concatenate(([True], ~(_same(doc, shift, item) & (run[1:] == run[:-1] + 1)))))
        lengths = np.diff(np.append(starts, len(doc))) + RUN - 1
        for d, k, n in zip(doc[starts].tolist(), item[starts].tolist(), lengths.tolist(), strict=True):
            exact[d, k] = max(n, exact.get((d, k), 0))
    out = [(d, k, n, None) for (d, k), n in exact.items()]

    doc, shift, pair = shard.standing(items.pairs, items.terms)
    item = items.pair_item[pair]
    order = np.lexsort((shift, item, doc))
    doc, shift, item = doc[order], shift[order], item[order]
    last = np.arange(len(doc)) + items.need[item] - 1
    keep = last < len(doc)
    at, last = np.flatnonzero(keep), last[keep]
    keep = (doc[last] == doc[at]) & (item[last] == item[at]) & (shift[last] - shift[at] <= items.edits[item[at]])
    stretches: dict[tuple[int, int], list[list[int]]] = {}
    for k in at[keep].tolist():
        d, i = int(doc[k]), int(item[k])
        if (d, i) in exact:
            continue
        e, start = int(items.edits[i]), int(shift[k] + items.begin[i])
        lo, hi = max(start - e, 0), min(start + int(items.begin[i + 1] - items.begin[i]) + 2 * e, int(shard.length[d]))
        own = stretches.setdefault((d, i), [])
        if own and lo <= own[-1][1]:
            own[-1][1] = max(hi, own[-1][1])
        else:
            own.append([lo, hi])
    for (d, i), own in stretches.items():
        terms = items.terms[items.begin[i] : items.begin[i + 1]]
        rows = [shard.row[shard.base[d] + lo : shard.base[d] + hi] for lo, hi in own]
        edits = min(distance_inside(r, terms) for r in rows)
        if edits <= items.edits[i]:
            out.append((d, i, max(longest_run(r, terms) for r in rows), edits))
    return out


_POSTINGS = "doc_id bigint, terms array<int>, positions array<int>"


def store(documents: DataFrame, vocabulary: list[str]) -> DataFrame:
    """The index of ``documents(doc_id, text)``: a document's postings whose words are in the vocabulary, written once."""
    shared = documents.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(vocabulary)})  # at most MOST_WORDS, or one item's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, numbers = shared.value.get, pa.list_(pa.int32())
        for batch in batches:
            ids, terms, positions = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [known(w, -1) for w in words(text)]
                row = np.array(found, np.int32)
                at = np.flatnonzero(row >= 0)
                if len(at):
                    ids.append(doc)
                    terms.append(row[at])
                    positions.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, numbers), pa.array(positions, numbers)], ["doc_id", "terms", "positions"])

    return materialize(documents.mapInArrow(run, _POSTINGS), "p7-postings", FEW_ROWS)


def _search(items: Items):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("run", pa.int32()), ("edits", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, positions = batch.column(1), batch.column(2)
            doc = np.repeat(np.arange(len(batch)), np.diff(terms.offsets.to_numpy()))
            shard = Shard(terms.flatten().to_numpy(), doc, positions.flatten().to_numpy().astype(np.int64), len(batch))
            if found := search(shard, items):
                d, i, n, e = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array(items.ids[list(i)]), pa.array(n, pa.int32()), pa.array(e, pa.int32())], schema=schema)

    return run


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [words(t) for t in batch.column(1).to_pylist()]
        made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["item_id", "w"])
        yield made.filter(pa.array([bool(ws) for ws in found], pa.bool_()))


def _block(documents: DataFrame, given: DataFrame) -> DataFrame | None:
    """Matches of one block of items."""
    rows = [(r.item_id, r.w) for r in given.collect()]  # at most MOST_WORDS words, or one item
    if not rows:
        return None
    vocabulary = sorted({w for _, ws in rows for w in ws})
    number = {w: k for k, w in enumerate(vocabulary)}
    index = store(documents, vocabulary)
    frequency = {r.term: r.n for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    items = Items.of([(i, tuple(number[w] for w in ws)) for i, ws in rows], frequency)
    return index.mapInArrow(_search(items), "doc_id bigint, item_id bigint, run int, edits int")


def leaks(documents: DataFrame, eval_items: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """``(doc_id, item_id, run, edits)``: documents that hold an item, by an exact run or as a whole with few edits."""
    spark = documents.sparkSession
    corpus = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    given = materialize(eval_items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(_items, "item_id bigint, w array<string>"), "p7-items", FEW_ROWS)
    size = given.agg(F.sum(F.size("w")).alias("n"), F.max(F.size("w")).alias("longest")).first()
    found = []
    if size.n and size.n <= most_words:
        found = [_block(corpus, given)]
    elif size.n:
        n_blocks = 2 * size.n // max(most_words, size.longest) + 1  # half full, as items fall into blocks by hash
        block = F.pmod(F.xxhash64("item_id", "w"), F.lit(n_blocks))
        found = [_block(corpus, given.where(block == b)) for b in range(n_blocks)]
    out = None
    for part in found:
        if part is not None:
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, run int, edits int")
    return out.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.min("edits").alias("edits"))
