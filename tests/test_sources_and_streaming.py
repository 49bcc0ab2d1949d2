import glob
import json

import pytest
from pyspark.sql import functions as F

from veriloom.functions.hashing import canonical_struct
from veriloom.operators.contracts import ContractError, bind_self_hash, require
from veriloom.session import table
from veriloom.sources import readers, sinks
from veriloom.streaming.events import event_stream, run_available, windowed_counts

SF = "/root/testdata/sf0.001"


def test_json_lines(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"a": 1, "b": [1, 2]}\n\n{"a": 2, "b": []}\n')
    assert readers.read_json_lines(spark, str(good), "a int, b array<int>").count() == 2
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception):
        readers.read_json_lines(spark, str(bad), "a int").collect()


def test_inference_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('Unnamed: 0,id,name,description,category\n0,7,"a ""b""","two\nlines",x\n1,3.0,c,,y\n')
    rows = readers.read_inference_csv(spark, str(path), ("x", "y")).orderBy("ordinal").collect()
    assert [(r.id, r.name, r.description) for r in rows] == [(7, 'a "b"', "two\nlines"), (3, "c", None)]
    for broken in ("1.5,n,d,x", "1,n,d,z", "1,n,d,x\n1,n,d,x"):
        path.write_text(f"id,name,description,category\n{broken}\n")
        with pytest.raises(ContractError):
            readers.read_inference_csv(spark, str(path), ("x", "y"))


def test_self_hashed_json_and_bound_files(spark, tmp_path):
    payload = bind_self_hash({"schema_version": "x", "n": 3})
    sinks.write_json_atomic(tmp_path / "m.json", payload)
    assert readers.read_self_hashed(tmp_path / "m.json") == payload
    (tmp_path / "m.json").write_text(json.dumps(payload | {"n": 4}))
    with pytest.raises(ContractError):
        readers.read_self_hashed(tmp_path / "m.json")
    (tmp_path / "data.bin").write_bytes(b"abc")
    row = readers.inventory(spark, str(tmp_path), "*.bin").first()
    reference = {"path": "data.bin", "bytes": row.bytes, "sha256": row.sha256}
    assert readers.bound_file(spark, str(tmp_path), reference).endswith("data.bin")
    for wrong in ({"bytes": 4}, {"path": "../data.bin"}, {"path": "/data.bin"}):
        with pytest.raises(ContractError):
            readers.bound_file(spark, str(tmp_path), reference | wrong)


def scores(spark):
    arms = F.explode(F.array(F.lit("control"), F.lit("candidate")))
    tags = F.explode(F.array(F.lit("t025"), F.lit("t050"), F.lit("t100")))
    rows = spark.range(50).select("id", (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 5).cast("int").alias("fold"), arms.alias("arm"))
    return rows.select("*", tags.alias("tag"), F.lit(0.5).alias("score"), F.lit(1).cast("byte").alias("prediction"))


def test_out_of_fold_audit(spark, tmp_path):
    good, roster = scores(spark), scores(spark).select("id", "label").distinct()
    good.write.partitionBy("arm", "fold", "tag").parquet(str(tmp_path / "good"))
    assert readers.read_out_of_fold(spark, str(tmp_path / "good"), roster).count() == 300
    faults = {
        "missing": good.where("not (arm = 'control' and fold = 2 and tag = 't050')"),
        "twice": good.union(good.where("id = 3").withColumn("fold", F.lit(4))),
        "label": good.withColumn("label", F.when(F.col("id") == 1, 0).otherwise(F.col("label"))),
        "lost": good.where("id <> 5"),
    }
    for name, frame in faults.items():
        frame.write.partitionBy("arm", "fold", "tag").parquet(str(tmp_path / name))
        with pytest.raises(ContractError):
            readers.read_out_of_fold(spark, str(tmp_path / name), roster)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (1, "a,\"q\""), (0, "c")], "ordinal int, v string")
    sinks.write_ordered_csv(rows, str(tmp_path / "csv"))
    text = "".join(open(f).read() for f in glob.glob(str(tmp_path / "csv/*.csv")))
    assert text.split("\n")[0] == "v" and text.split("\n")[1] == "c" and text.split("\n")[3] == "b"
    sinks.write_once(rows, str(tmp_path / "once"))
    with pytest.raises(Exception):
        sinks.write_once(rows, str(tmp_path / "once"))
    sinks.publish(rows, str(tmp_path / "ok"), lambda d: require(d, v=F.col("v").isNotNull()))
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 3
    with pytest.raises(ContractError):
        sinks.publish(rows, str(tmp_path / "bad"), lambda d: require(d, v=F.col("v") == "b"))
    assert not (tmp_path / "bad").exists()
    sinks.write_json_lines(rows, canonical_struct(v=F.col("v"), a=F.col("ordinal")), str(tmp_path / "lines"))
    assert '{"a":2,"v":"b"}' in [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()]
    sinks.append_events(rows, str(tmp_path / "log"))
    sinks.append_events(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6
    with pytest.raises(ValueError):
        sinks.write_json_atomic(tmp_path / "x.json", float("nan"))


def test_replay(spark):
    requests = spark.createDataFrame([("a",), ("b",)], "q string")
    cache = requests.where("q = 'a'").select(F.sha2("q", 256).alias("key"), F.lit("yes").alias("response"))
    assert {r.q: r.response for r in sinks.replay(requests, cache, F.col("q")).collect()} == {"a": "yes", "b": None}


def test_projected_scan_is_pruned(spark):
    plan = readers.read_projected(spark, f"{SF}/documents.parquet", ("doc_id", "lang"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_stream_equals_batch(spark, tmp_path):
    events = table(spark, SF, "events")
    stream = windowed_counts(event_stream(spark, SF, events.schema))
    streamed = run_available(stream, "event_counts", str(tmp_path / "checkpoint"))
    assert streamed.exceptAll(windowed_counts(events)).count() == 0 and streamed.count() == windowed_counts(events).count()
