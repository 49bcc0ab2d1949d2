"""Keys of JSON at any depth."""

import json

import pytest

from veriloom.operators.contracts import ContractError
from veriloom.operators.nested import check_manifests, forbidden_keys, walk_keys


def walk(value, path="", depth=0):
    out = []
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        if isinstance(value, dict):
            own = f"{path}.{k}" if path else k
            out.append((own, depth + 1, k))
            out += walk(v, own, depth + 1)
        else:
            out += walk(v, f"{path}[{k}]", depth)
    return out


VALUES = [
    {"a": 1, "b": {"c": [1, {"d": None, "e": [[{"f": {}}], []]}]}, " Hidden_Label ": {"private_label": [0]}},
    [{"x": {"x": {"x": "x"}}}, 3, "s"], 5, "text", None, {}, [], {"é k": True},
]


def test_walk_against_recursion(spark):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(VALUES)] + [(99, None)], "i int, j string").repartition(3)
    got = sorted(tuple(r) for r in walk_keys(df, "j", ["i"]).collect())
    assert got == sorted((i, *k) for i, v in enumerate(VALUES) for k in walk(v))
    assert sorted(r.path for r in forbidden_keys(df, "j", ["i"]).collect()) == [" Hidden_Label ", " Hidden_Label .private_label"]
    assert walk_keys(df.limit(0), "j", ["i"]).count() == 0
    quoted = spark.createDataFrame([(0, '{"a.b": {"c[0]": 1, "q\\"": 2}}')], "i int, j string")
    assert sorted(r.path for r in walk_keys(quoted, "j", ["i"]).collect()) == ['"a.b"', '"a.b"."c[0]"', '"a.b"."q\\""']
    with pytest.raises(ContractError):
        walk_keys(df.withColumnRenamed("i", "path"), "j", ["path"])
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        walk_keys(spark.createDataFrame([(0, "{no")], "i int, j string"), "j", ["i"]).collect()


def test_manifests(spark):
    declared = {"contains_private_rows": False, "source_partition": "train", "n": 3}
    good = {"contains_private_rows": False, "source_partition": "train", "n": 3, "deep": [{"k": 1}]}
    rows = [good, good | {"contains_private_rows": "false"}, {k: v for k, v in good.items() if k != "n"}, good | {"deep": [[{"Private_Label": 0}]]}, good | {"source_partition": "test"}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(rows)], "i int, j string")
    got = sorted(tuple(r) for r in check_manifests(df, "j", ["i"], declared).collect())
    assert got == [(1, "declaration", "contains_private_rows"), (2, "declaration", "n"), (3, "forbidden key", "deep[0][0].Private_Label"), (4, "declaration", "source_partition")]
