"""Canonical JSON of nested columns against Python's, and medians and top labels by counted ranges."""

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.functions.hashing import canonical, canonical_json, canonical_row
from veriloom.operators.ranking import label_top, medians

TEXTS = ["", "a", 'q"uo\\te', "\x00\x01\x0b\x1f\x1e\x7f", "\b\f\n\r\t", "é😀 ", "\\u000B", "\\\\u001F\x1f", "/", "<&>"]
NUMBERS = [0.0, -0.0, 0.1, 1e-7, 1e16, 1e15, 123456789.125, 5e-324, 1.7976931348623157e308, 2 / 3, 1e23, 5.6843418860808015e-14, -1.5e-5, 100.0, 0.00012]


def test_against_python(spark):
    inner = T.StructType([T.StructField("z", T.StringType()), T.StructField("é", T.ArrayType(T.LongType())), T.StructField("a", T.BooleanType())])
    schema = T.StructType([
        T.StructField("t", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("xs", T.ArrayType(T.DoubleType())), T.StructField("s", inner),
        T.StructField("ss", T.ArrayType(inner)), T.StructField("m", T.MapType(T.StringType(), T.LongType())), T.StructField("B.c", T.ArrayType(T.ArrayType(T.StringType()))),
    ])
    rng = random.Random(4)
    pick = lambda f: None if rng.random() < 0.15 else f()
    one = lambda: {"z": pick(lambda: rng.choice(TEXTS)), "é": pick(lambda: [pick(lambda: rng.randint(-(2**62), 2**62)) for _ in range(rng.randint(0, 3))]), "a": pick(lambda: rng.random() < 0.5)}
    rows = []
    for i in range(120):
        rows.append({
            "t": pick(lambda: rng.choice(TEXTS)), "n": pick(lambda: rng.randint(-9, 9)), "x": NUMBERS[i] if i < len(NUMBERS) else pick(lambda: rng.uniform(-1, 1) * 10 ** rng.randint(-30, 30)), "xs": pick(lambda: [pick(lambda: rng.random()) for _ in range(rng.randint(0, 4))]),
            "s": pick(one), "ss": pick(lambda: [pick(one) for _ in range(rng.randint(0, 3))]), "m": pick(lambda: {rng.choice(TEXTS): pick(lambda: rng.randint(0, 9)) for _ in range(rng.randint(0, 4))}),
            "B.c": pick(lambda: [pick(lambda: [pick(lambda: rng.choice(TEXTS)) for _ in range(2)]) for _ in range(2)]),
        })
    df = spark.createDataFrame(rows, schema)
    got = df.select(canonical_row(df).alias("j")).collect()
    assert [r.j for r in got] == [canonical_json(r) for r in rows]
    assert json.loads(got[0].j) == rows[0]


def test_what_has_no_form(spark):
    df = spark.createDataFrame([(float("nan"),)], "x double")
    with pytest.raises(Exception, match="Out of range"):
        df.select(canonical_row(df)).collect()
    for kind in ("array<array<double>>", "timestamp", "map<int,int>", "decimal(3,1)"):
        with pytest.raises(TypeError):
            canonical(F.lit(None).cast(kind), T._parse_datatype_string(kind))


def test_medians(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randint(0, 20) / 4, 7.0])) for _ in range(500)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    want = {g: statistics.median([v for h, v in rows if h == g and v is not None]) for g in ("a", "b", None, "one")}
    assert {r.g: r.m for r in medians(df, ["g"], "v", "m").collect()} == want
    assert medians(df, [], "v", "m").first().m == statistics.median([v for _, v in rows if v is not None])


@pytest.mark.parametrize("k", [1, 7, 399, 400, 1000])
def test_label_top(spark, k):
    rng = random.Random(k)
    rows = [(f"t{i:03d}", rng.choice([None, 0.5, float(rng.randint(0, 30))])) for i in range(400)]
    top = {t for t, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))[:k]}
    got = label_top(spark.createDataFrame(rows, "t string, s double").repartition(5), k, "s", "t", "y").collect()
    assert {r.t for r in got if r.y} == top and len(got) == 400
