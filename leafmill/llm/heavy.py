"""Most frequent values among billions, in memory that does not grow with the data.

A count-sketch with signed hashes is kept for every prefix length of a 64-bit value hash (8, 16, 24 and 32 bits). Every
task folds its rows into the same fixed set of counters with numpy and sends only these; counters add up, so the merge
is a streaming sum by counter block. The driver receives the merged sketch (its size is set by ``width``, ``depth`` and
the number of fields, not by the data), descends from the heavy 8-bit prefixes to the heavy 32-bit ones, and a second
scan counts exactly the values whose hash has one of these prefixes.

Cases: null values are left out; an empty table or a field without values gives no row; a value repeated inside an
array counts every time; empty strings are values like others; ties at the threshold are all kept. Columns other than
``field`` and ``item_value`` are dropped before anything moves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.merge import add_up

LEVELS = (8, 16, 24, 32)
BLOCK = 1024
WIDEST = 1 << 20
_MIX = np.random.RandomState(20240817).randint(1, 2**63 - 1, size=(16, 4), dtype=np.int64).astype(np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class SketchShape:
    """``depth`` rows of ``width`` (a power of two) counters at each prefix level."""

    width: int = 8192
    depth: int = 5

    @property
    def bits(self) -> int:
        return self.width.bit_length() - 1


def _slots(prefix: np.ndarray, level: int, row: int, shape: SketchShape) -> tuple[np.ndarray, np.ndarray]:
    """Counter index and sign of each prefix in one sketch row: two multiply-shift hashes of (prefix, level)."""
    a, b, c, d = _MIX[row]
    x = (prefix << np.uint64(6)) ^ np.uint64(level)
    x = (x ^ (x >> np.uint64(29))) * a + b
    bucket = (x ^ (x >> np.uint64(32))) * c >> np.uint64(64 - shape.bits)
    sign = ((x ^ (x >> np.uint64(31))) * d >> np.uint64(63)).astype(np.int64) * 2 - 1
    return bucket.astype(np.int64), sign


def _fold(shape: SketchShape):
    schema = pa.schema([("field", pa.string()), ("part", pa.int32()), ("counters", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[np.ndarray, list[int]]] = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            hashes = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            codes = names.indices.to_numpy(zero_copy_only=False)
            for code, name in enumerate(names.dictionary.to_pylist()):
                mine = hashes[codes == code]
                if name not in kept:
                    kept[name] = (np.zeros((len(LEVELS), shape.depth, shape.width), np.int64), [0])
                sketch, seen = kept[name]
                seen[0] += len(mine)
                for i, level in enumerate(LEVELS):
                    prefix = mine >> np.uint64(64 - level)
                    for row in range(shape.depth):
                        bucket, sign = _slots(prefix, level, row, shape)
                        sketch[i, row] += np.bincount(bucket, weights=sign, minlength=shape.width).astype(np.int64)
        for name, (sketch, seen) in kept.items():
            blocks = [seen, *sketch.reshape(-1, BLOCK).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(blocks)), pa.array(range(-1, len(blocks) - 1), pa.int32()), pa.array(blocks, pa.list_(pa.int64()))], schema=schema)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum equal blocks as they stream in: memory is one sketch, however many tasks sent theirs."""
    total: dict[tuple[str, int], np.ndarray] = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        for name, part, counters in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            block = counters.values.to_numpy()
            if (name, part) in total:
                total[name, part] += block
            else:
                total[name, part] = block.copy()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total]), pa.array([k[1] for k in total], pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], schema=schema)


@dataclass
class FieldSketch:
    """The merged sketch of one field, on the driver."""

    total: int
    counters: np.ndarray
    shape: SketchShape

    def _median(self, level: int, prefix: np.ndarray, counters: np.ndarray) -> np.ndarray:
        each = []
        for row in range(self.shape.depth):
            bucket, sign = _slots(prefix, level, row, self.shape)
            each.append(counters[row][bucket] * sign)
        return np.median(np.array(each), axis=0)

    def estimate(self, level: int, prefix: np.ndarray) -> np.ndarray:
        """Approximate number of rows under each prefix of ``level`` bits: the median over the sketch rows."""
        return self._median(level, prefix, self.counters[LEVELS.index(level)])

    def slack(self, level: int, counters: np.ndarray | None = None) -> float:
        """Three standard errors of an estimate, from the second moment the sketch itself measures."""
        squares = ((self.counters[LEVELS.index(level)] if counters is None else counters).astype(np.float64) ** 2).sum(axis=1)
        return 3.0 * float(np.sqrt(np.median(squares) / self.shape.width))

    def heavy(self, share: float) -> np.ndarray | None:
        """32-bit prefixes that may hold at least ``share`` of the rows, found by descending heavy prefixes only.

        At each level the certainly heavy prefixes are taken out of the sketch, so that they do not blur the others. None
        if the sketch is too narrow to tell ``share`` from half of it.
        """
        wanted = share * self.total
        nodes = np.arange(256, dtype=np.uint64)
        for i, level in enumerate(LEVELS):
            if i:
                nodes = (nodes[:, None] << np.uint64(8) | np.arange(256, dtype=np.uint64)[None, :]).ravel()
            rest = self.counters[i].astype(np.float64)
            sure = np.zeros(len(nodes), bool)
            for _ in range(3):
                more = ~sure & (self._median(level, nodes, rest) >= wanted)
                amounts = self._median(level, nodes[more], rest)
                for row in range(self.shape.depth):
                    bucket, sign = _slots(nodes[more], level, row, self.shape)
                    np.subtract.at(rest[row], bucket, sign * amounts)
                sure |= more
            slack = self.slack(level, rest)
            if slack > 0.5 * wanted and self.shape.width < WIDEST:
                return None
            nodes = nodes[sure | (self._median(level, nodes, rest) >= max(0.5, wanted - slack))]
        return nodes


def sketch_fields(values: DataFrame, shape: SketchShape | None = None) -> dict[str, FieldSketch]:
    """First scan: the merged sketch of every field of ``values(field, item_value)``."""
    shape = shape or SketchShape()
    hashed = values.where("item_value IS NOT NULL AND field IS NOT NULL").select("field", F.xxhash64("item_value").alias("h"))
    parts = hashed.mapInArrow(_fold(shape), "field string, part int, counters array<bigint>")
    merged = add_up(parts, _merge, ["field", "part"], min(64, len(LEVELS) * shape.depth))
    found: dict[str, dict[int, list[int]]] = {}
    for row in merged.collect():  # of fixed size
        found.setdefault(row.field, {})[row.part] = row.counters
    size = (len(LEVELS), shape.depth, shape.width)
    return {f: FieldSketch(p[-1][0], np.array([p[k] for k in range(len(p) - 1)], np.int64).reshape(size), shape) for f, p in found.items()}


def heavy_values(values: DataFrame, share: float = 0.01, shape: SketchShape | None = None) -> DataFrame:
    """Rows ``(field, item_value, item_count, estimate, field_total)`` of values holding at least ``share`` of a field.

    ``item_count`` is exact (second scan), ``estimate`` is the sketch's.
    """
    spark = values.sparkSession
    wanted, rows = [], []
    shape = shape or SketchShape()
    found = {name: (sketch, sketch.heavy(share)) for name, sketch in sketch_fields(values, shape).items()}
    while any(prefixes is None for _, prefixes in found.values()):  # too narrow for these data: scan again, wider
        shape = SketchShape(shape.width * 8, shape.depth)
        again = values.where(F.col("field").isin([name for name, (_, prefixes) in found.items() if prefixes is None]))
        found |= {name: (sketch, sketch.heavy(share)) for name, sketch in sketch_fields(again, shape).items()}
    for name, (sketch, prefixes) in sorted(found.items()):
        rows += [(name, int(p), float(e), sketch.total) for p, e in zip(prefixes, sketch.estimate(LEVELS[-1], prefixes), strict=True)]
        if len(prefixes):
            wanted.append((F.col("field") == name) & F.col("prefix").isin([int(p) for p in prefixes]))
    out = "field string, item_value string, item_count bigint, estimate double, field_total bigint"
    if not wanted:
        return spark.createDataFrame([], out)
    test = wanted[0]
    for w in wanted[1:]:
        test = test | w
    kept = values.where("item_value IS NOT NULL").select("field", "item_value", F.shiftrightunsigned(F.xxhash64("item_value"), 32).alias("prefix")).where(test)
    counted = kept.groupBy("field", "prefix", "item_value").agg(F.count("*").alias("item_count"))
    known = spark.createDataFrame(rows, "field string, prefix bigint, estimate double, field_total bigint")
    return counted.join(F.broadcast(known), ["field", "prefix"]).where(F.col("item_count") >= share * F.col("field_total")).select("field", "item_value", "item_count", "estimate", "field_total")


def web_values(spark, sf_dir: str) -> DataFrame:
    """Every stored link URL, frame URL and script source as ``(field, item_value)``; deliveries and elements all count."""
    from leafmill.core import table

    links = table(spark, sf_dir, "page_links").select(F.lit("Link.url").alias("field"), F.col("url").alias("item_value"))
    res = table(spark, sf_dir, "page_resources")
    frames = res.select(F.lit("Resources.frames").alias("field"), F.explode("frames").alias("item_value"))
    scripts = res.select(F.lit("Script.src").alias("field"), F.explode("scripts.src").alias("item_value"))
    return links.unionByName(frames).unionByName(scripts)
