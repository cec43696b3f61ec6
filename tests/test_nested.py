import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.operators import nested

ITEMS = "sd_id bigint, items array<string>, invalid array<struct<index:int,error:string>>, path string, owner_id int"


def brute(value, path, parent=""):
    """Every object below a value by plain recursion."""
    out = []
    if isinstance(value, dict):
        out.append((path, parent))
        for k, v in value.items():
            out += brute(v, f"{path}.{k}", path)
    elif isinstance(value, list):
        for k, v in enumerate(value):
            out += brute(v, f"{path}[{k}]", parent)
    return out


json_values = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("abé{\"", max_size=4), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text("ab@", min_size=1, max_size=2), c, max_size=3), max_leaves=12)


@settings(max_examples=80, deadline=None)
@given(json_values)
def test_occurrences_equal_recursion(value):
    assert sorted(o[:2] for o in nested.occurrences(value, "items[0]")) == sorted(brute(value, "items[0]"))


@settings(max_examples=80, deadline=None)
@given(json_values)
def test_own_reader_equals_the_built_in_one(value):
    assert nested._parse_deep(json.dumps(value, indent=1)) == value


def test_equal_subtrees_share_an_identity():
    found = nested.occurrences({"a": {"x": 1, "y": [2, {"z": 3}]}, "b": [{"y": [2, {"z": 3}], "x": 1}]}, "items[0]")
    by_path = {o[0]: o[5] for o in found}
    assert by_path["items[0].a"] == by_path["items[0].b[0]"] and by_path["items[0].a.y[1]"] == by_path["items[0].b[0].y[1]"]
    assert len(set(by_path.values())) == 3


def test_edges(spark):
    deep = '{"a":' * 3000 + "1" + "}" * 3000
    rows = [
        (1, ['{"a": {}, "b": "{\\"no\\":1}", "c": null}'], [(0, "bad"), (None, None), None], "x", 1),
        (1, ['{"a": {}, "b": "{\\"no\\":1}", "c": null}'], [(0, "bad"), (None, None), None], "x", 1),
        (2, None, None, None, None), (3, [], [], "", 2), (4, [None, "", "no json", '[{"k": [[{}]]}]'], None, "y", 3), (None, ["{}"], None, "z", 4), (5, ['{"a": {"x": 1}, "a": {"y": 2}}'], None, "", 5),
    ]
    got = sorted((r.owner_id if r.owner_id is not None else -1, r.path, r.parent_path) for r in nested.flatten(spark.createDataFrame(rows, ITEMS)).collect())
    assert got == sorted([
        (1, "items[0]", ""), (1, "items[0].a", "items[0]"), (1, "invalid[0]", ""), (1, "invalid[1]", ""), (1, "invalid[2]", ""),
        (4, "items[3][0]", ""), (4, "items[3][0].k[0][0]", "items[3][0]"), (-1, "items[0]", ""), (5, "items[0]", ""), (5, "items[0].a", "items[0]"),
    ])
    assert nested.flatten(spark.createDataFrame([], ITEMS)).count() == 0
    assert nested.flatten(spark.createDataFrame([(9, [deep], None, "", 1)], ITEMS)).count() == 3000


def test_stored_objects_and_members(spark):
    bridge = nested.flatten(spark.createDataFrame([(1, ['{"@type":"A","o":{"v":1}}'], None, "", 1), (2, ['{"o":{"v":1},"l":[true,[2.5,"t"]]}'], None, "", 1)], ITEMS))
    stored = nested.objects(bridge)
    assert stored.count() == 3 and stored.where("n_occurrences = 2").count() == 1
    members = {(r.member, r.ordinal, r.value, r.value_type) for r in nested.members(stored).where("member IN ('l', 'v')").collect()}
    assert members == {("l", 0, "true", "boolean"), ("l", 1, "2.5", "number"), ("l", 2, "t", "string"), ("v", 0, "1", "number")}
    links = bridge.where(F.col("parent_object_id").isNotNull()).join(stored, "object_id")
    assert links.count() == 2
