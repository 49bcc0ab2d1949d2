"""Appends that are tried again, and the store of responses with several writers."""

import pytest
from pyspark.sql import functions as F

from veriloom.operators.contracts import ContractError
from veriloom.sources import files, store
from veriloom.streaming import durable


def test_append_batch_once(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.range(10)
    assert durable.read_appended(spark, path, rows.schema).count() == 0

    def fail(batch):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        durable.append_batch(rows, 0, path, "q", fail)
    assert durable.read_appended(spark, path, rows.schema).count() == 0  # written, not committed
    assert durable.append_batch(rows.limit(7), 0, path, "q") and not durable.append_batch(rows, 0, path, "q")
    assert durable.append_batch(rows, 0, path, "other") and durable.append_batch(rows.limit(0), 1, path, "q")
    assert [tuple(r) for r in durable.commits(spark, path).orderBy("query", "batch").collect()] == [("other", 0, 10), ("q", 0, 7), ("q", 1, 0)]
    assert sorted(r.id for r in durable.read_appended(spark, path, rows.schema).where("query = 'q'").collect()) == list(range(7))
    with pytest.raises(ContractError):
        durable.append_batch(rows, 0, path, "../q")


def test_new_files_have_one_writer(spark, tmp_path):
    path = str(tmp_path / "log" / "a.json")
    assert files.write_new(spark, path, "é") and not files.write_new(spark, path, "b")
    assert files.read_text(spark, path) == "é" and files.names(spark, str(tmp_path / "log")) == [".a.json.crc", "a.json"] or files.names(spark, str(tmp_path / "log")) == ["a.json"]
    assert files.names(spark, str(tmp_path / "none")) == []


def respond(call, seen):
    def f(asked):
        seen.append(sorted(r.request for r in asked.collect()))
        return asked.select("key", F.concat(F.lit(f"{call}:"), "request").alias("response"))

    return f


def test_store_computes_each_key_once(spark, tmp_path):
    folder, seen = str(tmp_path / "s"), []
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "i int, q string")
    b = spark.createDataFrame([(5, "y"), (6, "z"), (7, "z")], "i int, q string")
    got, at = store.complete(a, folder, F.col("q"), respond("a", seen))
    assert at == 1 and [(r.i, r.response) for r in got.orderBy("i").collect()] == [(1, "a:x"), (2, "a:x"), (3, "a:y"), (4, None)]
    pinned = store.read(spark, folder, at)
    got, at = store.complete(b, folder, F.col("q"), respond("b", seen))
    assert at == 2 and [(r.i, r.response) for r in got.orderBy("i").collect()] == [(5, "a:y"), (6, "b:z"), (7, "b:z")]
    assert seen == [["x", "y"], ["z"]] and pinned.count() == 2 and store.read(spark, folder, at).count() == 3
    _, again = store.complete(a.limit(0), folder, F.col("q"), respond("c", seen))
    _, same = store.complete(a, folder, F.col("q"), respond("c", seen))
    assert again == same == 2 and len(seen) == 2


def test_writers_at_one_version(spark, tmp_path):
    """Both read version 0; the second to commit keeps the first's responses and adds only its own keys."""
    folder = str(tmp_path / "s")
    rows = lambda who, keys: spark.createDataFrame([(k, who) for k in keys], "key string, response string")
    assert store.put(rows("a", ["k1", "k2"]), folder, 0) == 1
    assert store.put(rows("b", ["k2", "k3"]), folder, 0) == 2
    assert store.put(rows("c", ["k1"]), folder, 0) == 1  # the first commit has it; nothing is added
    got = {r.key: r.response for r in store.read(spark, folder, store.version(spark, folder)).collect()}
    assert got == {"k1": "a", "k2": "a", "k3": "b"} and store.read(spark, folder, 2).count() == 3
    assert len(files.names(spark, f"{folder}/segments")) == 2


def test_store_fails_closed(spark, tmp_path):
    a = spark.createDataFrame([("x",), ("yy",)], "q string")
    folder = str(tmp_path / "s")
    with pytest.raises(ContractError, match="cap"):
        store.complete(a, folder, F.col("q"), respond("a", []), cost=F.length("q"), cap=2.5)
    with pytest.raises(ContractError, match="no response"):
        store.complete(a, folder, F.col("q"), lambda asked: asked.where("request = 'x'").select("key", F.lit("r").alias("response")))
    assert store.version(spark, folder) == 0
    _, at = store.complete(a, folder, F.col("q"), respond("a", []), cost=F.length("q"), cap=3.0)
    assert at == 1


def test_inventory_without_some_files(spark, tmp_path):
    from veriloom.sources.readers import inventory

    for name in ("a.txt", "cache/a.txt", "b/.hidden/x.txt", "b/c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    got = lambda *without: sorted(r.path.split(str(tmp_path) + "/")[1] for r in inventory(spark, str(tmp_path), without=without).collect())
    assert got() == ["a.txt", "b/c.txt", "cache/a.txt"] and got("^cache/") == ["a.txt", "b/c.txt"] and got("^cache/", "c[.]txt$") == ["a.txt"]
