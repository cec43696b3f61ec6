"""Deeply nested records as flat tables that keep every parent-child link.

Objects are canonicalised and hashed bottom-up (a Merkle identity): an object's id is the hash of its own scalar members
and of the ids of the objects in it, so equal subtrees share one id wherever they stand. ``flatten`` yields one bridge
row per occurrence (owner, path, parent path, member, ordinal, object id, parent's object id) together with the object's
canonical body; ``objects`` stores each identity once and ``members`` its scalar members.

Cases: null or empty ``items`` and ``invalid`` give no row; an array element that is null or no JSON gives no object; an
element of ``invalid`` always gives one row, also when it or its members are null; a list at the top gives
``items[i][k]``; of a member named twice in one object the last counts, as JSON readers do; text that looks like JSON
inside a string stays a string; depth is limited by memory only; an empty object is an object. Records delivered twice
(equal id and content) count once; records that share an id but differ in content are all kept. Other columns are
dropped first, so that names cannot clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.core import materialize, once, table

OCCURRENCE = "owner_id bigint, path string, parent_path string, member string, ordinal int, depth int, object_id string, parent_object_id string, body string"
_SPACE = re.compile(r"[ \t\n\r]*")
_PLAIN = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")


def _parse_deep(text: str):
    """JSON of any depth without recursion; used where the built-in reader gives up."""
    stack: list[tuple[object, object]] = []  # (container, key waiting for its value)
    at, root, done = 0, None, False

    def put(value) -> None:
        nonlocal root, done
        if not stack:
            root, done = value, True
        elif isinstance(stack[-1][0], list):
            stack[-1][0].append(value)
        else:
            stack[-1][0][stack[-1][1]] = value

    def name(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError("member name expected")
        key, at = json.decoder.scanstring(text, at + 1)
        at = _SPACE.match(text, at).end()
        if text[at : at + 1] != ":":
            raise ValueError("colon expected")
        return key, at + 1

    while not done:
        at = _SPACE.match(text, at).end()
        head = text[at : at + 1]
        if head in ("{", "["):
            value: object = {} if head == "{" else []
            put(value)
            done = False
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] != ("}" if head == "{" else "]"):
                key = None
                if head == "{":
                    key, at = name(at)
                stack.append((value, key))
                continue
            at += 1
        elif head == '"':
            value, at = json.decoder.scanstring(text, at + 1)
            put(value)
        elif m := _PLAIN.match(text, at):
            put(json.loads(m[0]))
            at = m.end()
        else:
            raise ValueError("value expected")
        while stack:
            at = _SPACE.match(text, at).end()
            box, _ = stack[-1]
            mark = text[at : at + 1]
            if mark == ",":
                at = _SPACE.match(text, at + 1).end()
                if isinstance(box, dict):
                    key, at = name(at)
                    stack[-1] = (box, key)
                break
            if mark != ("}" if isinstance(box, dict) else "]"):
                raise ValueError("end expected")
            stack.pop()
            at += 1
        done = not stack
    if _SPACE.match(text, at).end() != len(text):
        raise ValueError("text after the value")
    return root


def _read(text: str | None):
    if text is None:
        return None
    try:
        return json.loads(text)
    except RecursionError:
        try:
            return _parse_deep(text)
        except ValueError:
            return None
    except ValueError:
        return None


def _identity(body: str) -> str:
    return blake2b(body.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def occurrences(root, path: str) -> list[tuple]:
    """All objects under ``root``: (path, parent path, member, ordinal, depth, id, parent's id, body), parents first."""
    found: list[list] = []  # path, parent index, member, ordinal, depth, object
    todo = [(root, path, -1, "", 0, 0)]
    while todo:
        value, at, parent, member, ordinal, depth = todo.pop()
        if isinstance(value, dict):
            found.append([at, parent, member, ordinal, depth, value])
            me = len(found) - 1
            todo.extend((v, f"{at}.{k}", me, k, 0, depth + 1) for k, v in reversed(value.items()) if isinstance(v, (dict, list)))
        elif isinstance(value, list):
            todo.extend((v, f"{at}[{k}]", parent, member, k, depth) for k, v in reversed(list(enumerate(value))) if isinstance(v, (dict, list)))
    ids: list[str] = [""] * len(found)
    bodies: list[str] = [""] * len(found)
    by_object = {}
    for i in range(len(found) - 1, -1, -1):  # children come after their parent, so this is bottom-up
        value = found[i][5]
        bodies[i] = json.dumps(_with_ids(value, by_object), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        ids[i] = by_object[id(value)] = _identity(bodies[i])
    return [(f[0], found[f[1]][0] if f[1] >= 0 else "", f[2], f[3], f[4], ids[i], ids[f[1]] if f[1] >= 0 else None, bodies[i]) for i, f in enumerate(found)]


def _with_ids(value: dict, by_object: dict[int, str]) -> dict:
    """The object with every object in it replaced by its id; lists in lists are walked without recursion."""
    out = {}
    for key, member in value.items():
        if isinstance(member, dict):
            out[key] = {"": by_object[id(member)]}
        elif isinstance(member, list):
            top: list = []
            todo = [(member, top)]
            while todo:
                source, target = todo.pop()
                for x in source:
                    if isinstance(x, dict):
                        target.append({"": by_object[id(x)]})
                    elif isinstance(x, list):
                        target.append(inner := [])
                        todo.append((x, inner))
                    else:
                        target.append(x)
            out[key] = top
        else:
            out[key] = member
    return out


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("owner_id", pa.int64()), ("path", pa.string()), ("parent_path", pa.string()), ("member", pa.string()), ("ordinal", pa.int32()), ("depth", pa.int32()), ("object_id", pa.string()), ("parent_object_id", pa.string()), ("body", pa.string())])
    told: set[str] = set()  # identities whose body the task has given

    def body_once(row: tuple) -> tuple:
        if row[6] in told:
            return (*row[:8], None)
        told.add(row[6])
        return row

    for batch in batches:
        if len(told) > 200_000:
            told.clear()
        rows: list[tuple] = []
        for owner, items, invalid in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for i, text in enumerate(items or ()):
                rows += [body_once((owner, *o[:3], i if o[4] == 0 and not o[1] else o[3], *o[4:])) for o in occurrences(_read(text), f"items[{i}]")]
            for i, block in enumerate(invalid or ()):
                body = json.dumps(block, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
                rows.append(body_once((owner, f"invalid[{i}]", "", "", i, 0, _identity("invalid" + body), None, body)))
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def flatten(records: DataFrame, owner: str = "sd_id") -> DataFrame:
    """One bridge row per object occurrence in ``records(owner, items, invalid)``; see ``OCCURRENCE``.

    A task gives the body of an object with its first occurrence only, so bodies do not move with every occurrence.
    """
    content = F.md5(F.to_json(F.struct("items", "invalid")).cast("binary"))
    kept = once(records, F.coalesce(F.col(owner).cast("string"), F.lit("")), content).select(F.col(owner).cast("bigint").alias("owner_id"), "items", "invalid")
    return kept.mapInArrow(_flatten, OCCURRENCE)


def objects(bridge: DataFrame) -> DataFrame:
    """Every distinct object once: its id, canonical body, own type and number of occurrences."""
    found = bridge.groupBy("object_id").agg(F.first("body", True).alias("body"), F.count("*").alias("n_occurrences"))
    return found.select("object_id", "body", F.get_json_object("body", "$.@type").alias("object_type"), "n_occurrences")


_MEMBERS = "object_id string, member string, ordinal int, value string, value_type string, child_id string"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("object_id", pa.string()), ("member", pa.string()), ("ordinal", pa.int32()), ("value", pa.string()), ("value_type", pa.string()), ("child_id", pa.string())])
    kinds = {bool: "boolean", int: "number", float: "number", str: "string", type(None): "null"}
    for batch in batches:
        rows: list[tuple] = []
        for key, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for name, value in (_read(body) or {}).items():
                flat, todo = [], [value]
                while todo:
                    x = todo.pop()
                    todo.extend(reversed(x)) if isinstance(x, list) else flat.append(x)
                for k, x in enumerate(flat):
                    if isinstance(x, dict):
                        rows.append((key, name, k, None, "object", x.get("")))
                    else:
                        rows.append((key, name, k, x if isinstance(x, str) else None if x is None else json.dumps(x), kinds[type(x)], None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def members(stored: DataFrame) -> DataFrame:
    """The members of each stored object, lists flattened in order; an object member is given by its id."""
    return stored.select("object_id", "body").mapInArrow(_members, _MEMBERS)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten(table(spark, sf_dir, "page_items")).select(F.col("owner_id").alias("sd_id"), "path", "parent_path")


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(flatten(table(spark, sf_dir, "page_items"))).select("object_id", "object_type", "n_occurrences")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten(table(spark, sf_dir, "page_items")).where("parent_object_id IS NOT NULL").groupBy("parent_object_id", "object_id", "member", "ordinal").agg(F.count("*").alias("n_links"))


def _scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(objects(flatten(table(spark, sf_dir, "page_items"))))


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of objects by type, counted from the objects that are stored once."""
    stored = objects(flatten(table(spark, sf_dir, "page_items")))
    broken = F.get_json_object("body", "$.index").isNotNull() & F.col("object_type").isNull()
    return stored.groupBy(F.when(broken, "invalid").otherwise(F.col("object_type")).alias("object_type")).agg(F.sum("n_occurrences").alias("n_occurrences"))


def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often an object stands in another one, by the member that holds it."""
    return flatten(table(spark, sf_dir, "page_items")).where("parent_object_id IS NOT NULL").groupBy("member").agg(F.count("*").alias("n_links"))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars by member, counted from the members of objects stored once and how often each object occurs."""
    stored = materialize(objects(flatten(table(spark, sf_dir, "page_items"))), "p5-objects")
    scalars = members(stored).where("value_type <> 'object'").groupBy("object_id", "member").agg(F.count("*").alias("n"))
    return scalars.join(stored.select("object_id", "n_occurrences"), "object_id").groupBy("member").agg(F.sum(F.col("n") * F.col("n_occurrences")).alias("n_values"))


QUERIES = {"p5_found": found, "p5_objects": _objects, "p5_links": _links, "p5_members": _scalars, "p5_occurrences": _occurrences, "p5_children": _children, "p5_values": _values}

_TREE = r"""
WITH r AS (SELECT DISTINCT sd_id, items, invalid FROM page_items),
n AS (SELECT sd_id, unnest(items) AS node, generate_subscripts(items, 1) - 1 AS i FROM r),
o AS (SELECT n.sd_id, 'items[' || n.i || ']' || replace(substr(t.fullkey, 2), '"', '') AS path
      FROM n, json_tree(n.node) t WHERE t.type = 'OBJECT')
SELECT sd_id, path, CASE WHEN regexp_full_match(path, 'items(\[[0-9]+\])+') THEN ''
  ELSE regexp_replace(path, '\.[^.\[]*(\[[0-9]+\])*$', '') END AS parent_path FROM o
UNION ALL
SELECT sd_id, 'invalid[' || i || ']', '' FROM (SELECT sd_id, unnest(generate_series(0, len(invalid) - 1)) AS i FROM r WHERE len(invalid) > 0) q
"""
_NODES = r"""
WITH r AS (SELECT DISTINCT sd_id, items, invalid FROM page_items),
n AS (SELECT sd_id, unnest(items) AS node FROM r)
"""
SQL = {
    "p5_found": _TREE,
    "p5_occurrences": _NODES + """, o AS (SELECT json_extract_string(t.value, '$."@type"') AS object_type FROM n, json_tree(n.node) t WHERE t.type = 'OBJECT')
SELECT object_type, count(*) AS n_occurrences FROM o GROUP BY object_type
UNION ALL SELECT 'invalid', sum(len(invalid))::BIGINT FROM r WHERE len(invalid) > 0 HAVING sum(len(invalid)) > 0""",
    "p5_children": _NODES + r""", o AS (SELECT regexp_extract(replace(t.fullkey, '"', ''), '\.([^.\[]+)(?:\[\d+\])*$', 1) AS member FROM n, json_tree(n.node) t WHERE t.type = 'OBJECT')
SELECT member, count(*) AS n_links FROM o WHERE member <> '' GROUP BY member""",
    "p5_values": _NODES + r""", o AS (SELECT regexp_extract(replace(t.fullkey, '"', ''), '\.([^.\[]+)(?:\[\d+\])*$', 1) AS member FROM n, json_tree(n.node) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')
  UNION ALL SELECT unnest(['index', 'error']) FROM (SELECT unnest(invalid) FROM r) q)
SELECT member, count(*)::BIGINT AS n_values FROM o WHERE member <> '' GROUP BY member""",
}
