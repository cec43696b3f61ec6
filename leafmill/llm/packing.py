"""Texts of different length put into containers of fixed capacity with little unused space.

Shortest-pack-first over the length histogram: lengths are placed longest first, always into the group of packs that is
shortest so far, and whole counts of packs change group at a time, so the work depends on the number of different lengths
and not on the number of texts. The result is a list of packing
patterns with counts. Texts are then joined back by rank: the k-th text of a length takes the k-th place that the
patterns have for this length.

Ranks need no sort over all texts of one length: every input partition counts its texts by length, the counts are summed
up to offsets, and a text's rank is its partition's offset plus its place in the partition.

Cases: a text longer than the capacity is cut into full pieces and a rest that is placed like a text; an empty or null
text takes no room and is assigned to container 0 with zero tokens; equal texts are different items; an empty table
gives no rows; a capacity below 1 is an error; ids may be null or repeated (a text is its row).
"""

from __future__ import annotations

import base64
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


@lru_cache(4)
def _encoding(path: str):
    import sys

    import tiktoken

    sys.path.insert(0, path.rsplit("/", 2)[0])
    try:
        from public_tokenizers import PATTERN  # the files' own description; without it the split is unknown
    finally:
        sys.path.pop(0)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, encoding) -> int:
    """Number of tokens of a whole text."""
    return len(encoding.encode_ordinary(text))


def with_tokens(documents: DataFrame, path: str = f"{TOKENIZER_DIR}/{TOKENIZER}", key: str = "doc_id") -> DataFrame:
    """``(doc_id, n_tokens, part)`` of ``documents(doc_id, text)``; ``part`` names the input partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in batches:
            counts = [count_tokens(t, encoding) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), batch.column(2)], ["doc_id", "n_tokens", "part"])

    given = documents.select(F.col(key).cast("bigint").alias("doc_id"), "text", F.spark_partition_id().alias("part"))
    return given.mapInArrow(run, "doc_id bigint, n_tokens bigint, part int")


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns ((lengths, longest first), how many packs) for a histogram of lengths from 1 to ``capacity``.

    Groups of packs with an equal pattern are kept by free room. A length goes to the shortest packs, those with the most
    room, one text to each; where the length does not fit even there, each text of it opens a pack of its own.
    """
    rooms: list[int] = []  # sorted rooms with open groups
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    done: list[tuple[tuple[int, ...], int]] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room == 0:
            done.append((pattern, n))
        else:
            if not groups.setdefault(room, []):
                insort(rooms, room)
            groups[room].append((pattern, n))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:
                put(capacity - length, (length,), left)
                break
            room = rooms[-1]
            pattern, n = groups[room].pop()
            if not groups[room]:
                rooms.pop()
            take = min(n, left)
            if n > take:
                put(room, pattern, n - take)
            put(room - length, (*pattern, length), take)
            left -= take
    return done + [g for room in rooms for g in groups[room]]


def places(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first container) of the patterns' places, sorted; ranks of a row go to containers in turn."""
    out: list[tuple[int, int, int]] = []
    used: dict[int, int] = {}
    base = 0
    for pattern, n in shortest_pack_first(histogram, capacity):
        for length in pattern:
            start = used.get(length, 0)
            out.append((length, start, base))
            used[length] = start + n
        base += n
    return np.array(sorted(out), np.int64).reshape(-1, 3)


def _assign(grids: list[np.ndarray]):
    """Containers of (pack, length, rank) by binary search in the places of each pack."""
    known = [np.unique(g[:, 0]) for g in grids]
    keys = [np.searchsorted(k, g[:, 0]) << 40 | g[:, 1] for k, g in zip(known, grids, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pack, length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pack", "n_tokens", "rank"))
            container = np.zeros(len(pack), np.int64)
            for p in np.unique(pack):
                here = np.flatnonzero((pack == p) & (length > 0))
                at = np.searchsorted(keys[p], np.searchsorted(known[p], length[here]) << 40 | rank[here], side="right") - 1
                container[here] = grids[p][at, 2] + rank[here] - grids[p][at, 1]
            yield pa.RecordBatch.from_arrays([batch.column("pack"), pa.array(container), *(batch.column(c) for c in ("doc_id", "piece", "n_tokens"))], ["pack", "container_id", "doc_id", "piece", "n_tokens"])

    return run


def pieces(lengths: DataFrame, capacities: list[int]) -> DataFrame:
    """Rests of all texts and the full pieces of those longer than a capacity: ``(pack, doc_id, piece, n_tokens, part)``."""
    each = lengths.select("doc_id", "part", F.col("n_tokens").cast("bigint").alias("n_tokens"), F.posexplode(F.array(*(F.lit(c).cast("bigint") for c in capacities))).alias("pack", "capacity"))
    full = F.floor(F.col("n_tokens") / F.col("capacity")).cast("int")
    marked = each.withColumn("n_full", full).withColumn("rest", F.col("n_tokens") - F.col("n_full") * F.col("capacity"))
    ends = marked.where("rest > 0 OR n_full = 0").select("pack", "doc_id", F.col("n_full").alias("piece"), F.col("rest").alias("n_tokens"), "part")
    whole = marked.where("n_full > 0").select("pack", "doc_id", F.explode(F.sequence(F.lit(0), F.col("n_full") - 1)).alias("piece"), F.col("capacity").alias("n_tokens"), "part")
    return ends.unionByName(whole)


def pack(lengths: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """``(pack_id, container_id, doc_id, piece, n_tokens)``: every text, or piece of one, in its container of each size.

    ``lengths(doc_id, n_tokens, part)`` must be stored, as its partitions are counted first; ``sizes`` are pairs of an id
    and a capacity. The histogram has at most ``capacity`` lengths for each size, so the driver's part is bounded whatever
    the corpus.
    """
    if any(c < 1 for _, c in sizes):
        raise ValueError("capacity below 1")
    if not sizes:
        return lengths.sparkSession.createDataFrame([], "pack_id int, container_id bigint, doc_id bigint, piece int, n_tokens bigint")
    items = pieces(lengths, [c for _, c in sizes])
    by_part = items.groupBy("pack", "n_tokens", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("pack", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("pack", "n_tokens", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    histograms: list[dict[int, int]] = [{} for _ in sizes]
    for r in by_part.where("n_tokens > 0").groupBy("pack", "n_tokens").agg(F.sum("n").alias("n")).collect():
        histograms[r.pack][r.n_tokens] = r.n
    grids = [places(h, c) for h, (_, c) in zip(histograms, sizes, strict=True)]
    inside = Window.partitionBy("pack", "n_tokens", "part").orderBy("doc_id", "piece")
    ranked = items.withColumn("k", F.row_number().over(inside) - 1).join(offsets, ["pack", "n_tokens", "part"])
    keyed = ranked.select("pack", "doc_id", "piece", "n_tokens", (F.col("k") + F.col("offset")).alias("rank"))
    placed = keyed.mapInArrow(_assign(grids), "pack int, container_id bigint, doc_id bigint, piece int, n_tokens bigint")
    names = F.array(*(F.lit(i).cast("int") for i, _ in sizes))
    return placed.select(F.get(names, F.col("pack")).alias("pack_id"), "container_id", "doc_id", "piece", "n_tokens")
