"""Leaves of nested values and their comparison against a recursion."""

import json

from kinetrace.functions import trees


def plain(value, path="$"):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from plain(v, f"{path}.{k}" if k.isidentifier() else f'{path}."{k}"')
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from plain(v, f"{path}[{i}]")
    else:
        yield path, value


TREES = [
    {"a": 1, "b": [1, {"c": None, "d": 'x"y'}, [[]]], "e": {}, "f": [], "g": 1.5, "h": True, "i.j": {"k": [0, -2]}},
    [1, [2, [3, [4, {"deep": "er"}]]]], 5, "text", None, {},
]


def test_leaves(spark):
    rows = [(i, json.dumps(t)) for i, t in enumerate(TREES)] + [(90, None), (91, "{no json"), (92, "")]
    got = {(r["id"], r["path"]): r["value"] for r in trees.leaves(spark.createDataFrame(rows, "id long, j string"), ["id"], "j").collect()}
    want = {(i, p): None if v is None else v if isinstance(v, str) else json.dumps(v) for i, t in enumerate(TREES) for p, v in plain(t)}
    assert got == want


def test_differences(spark):
    left = [(1, '{"a": {"x": 1.0, "y": [1, 2]}, "s": "u"}'), (2, '{"only": 1}'), (None, '{"n": 1}')]
    right = [(1, '{"a": {"x": 1.000001, "y": [1, 3, 4]}, "s": 5}'), (3, '[true]'), (None, '{"n": 1}')]
    l, r = (spark.createDataFrame(x, "id long, j string") for x in (left, right))
    got = sorted((tuple(x) for x in trees.tree_differences(l, r, ["id"], "j").collect()), key=str)
    assert got == [
        (1, "$.a.y[1]", "2", "3", "differs"), (1, "$.a.y[2]", None, "4", "missing left"), (1, "$.s", "u", "5", "differs"),
        (2, "$.only", "1", None, "missing right"), (3, "$[0]", None, "true", "missing left"),
    ]
    assert trees.tree_differences(l, l, ["id"], "j").collect() == []
