import copy
import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veriloom.operators import contracts, pairs, policy, synthetic
from veriloom.plans.dry_run import dry_run

SIDE = "struct<name:string,description:string,decisive_span:string>"
PAIRS = f"pair_id string, positive {SIDE}, negative {SIDE}, boundary string, style_frame_id string, changed_slot string, changed_field string, invariant_fact_frame string, positive_first boolean"
REVIEWS = "pair_id string, label_a int, label_b int, evidence_a string, evidence_b string, pair_usable boolean, reject_reason string"
AUDITS = "pair_id string, boundary string, style_frame_id string, pass boolean, checks map<string,boolean>"
CARDS = "pair_id string, pair_position int, organizer_label int, name string, description string, decisive_span string, fully_synthetic boolean, source_id long, source_component string"


def bundle(n=12):
    out = {"pairs": [], "reviews": [], "audits": [], "cards": []}
    for i in range(n):
        pid, frame = f"p{i:03d}", f"f{i % 4}"
        sides = [(f"box {i}", f"comes with fuel can {i} inside the box", f"with fuel can {i}"), (f"box {i}", f"comes quite empty {i} inside the box", f"quite empty {i}")]
        first = i % 2 == 0
        out["pairs"].append([pid, sides[0], sides[1], f"b{i % 2}", frame, "slot", "description", "frame", first])
        shown = [(1, sides[0][2]), (0, sides[1][2])]
        if int(hashlib.sha256(pid.encode()).hexdigest(), 16) % 2:
            shown.reverse()
        out["reviews"].append([pid, shown[0][0], shown[1][0], shown[0][1].upper(), shown[1][1], i != 3, "NONE" if i != 3 else "odd"])
        out["audits"].append([pid, f"b{i % 2}", frame, True, {"a": True}])
        for label in (0, 1):
            out["cards"].append([pid, 0 if (label == 1) == first else 1, label, *sides[1 - label], True, None, None])
    return out


def check(spark, b, protected=(("real card", "nothing alike"),)):
    frames = [spark.createDataFrame([tuple(r) for r in b[k]], s) for k, s in (("pairs", PAIRS), ("reviews", REVIEWS), ("audits", AUDITS), ("cards", CARDS))]
    return synthetic.check_pairs(*frames, spark.createDataFrame(list(protected), "name string, description string"))


def test_good_pairs(spark):
    checked = check(spark, bundle())
    assert all(not r.violations for r in checked.collect())
    found = synthetic.aggregate_gates(checked, 12, 4, 5)
    assert found == {"pairs": 12, "boundaries": 2, "style_frames": 4, "max_pairs_per_style_frame": 3, "blind_direction_correct": 12, "blind_usable": 11}
    for gate in ((13, 4, 5), (12, 5, 5), (12, 4, 2)):
        with pytest.raises(contracts.ContractError):
            synthetic.aggregate_gates(checked, *gate)


def test_faults_are_named(spark):
    def broken(mutate, protected=(("real card", "nothing alike"),)):
        b = copy.deepcopy(bundle())
        mutate(b)
        return {r.pair_id: set(r.violations) for r in check(spark, b, protected).collect()}

    assert "audit_passed" in broken(lambda b: b["audits"][0].__setitem__(4, {"a": False}))["p000"]
    assert "blind_direction" in broken(lambda b: b["reviews"][1].__setitem__(1, 1 - b["reviews"][1][1]))["p001"]
    assert "usability_stated" in broken(lambda b: b["reviews"][2].__setitem__(6, "odd"))["p002"]
    assert "cards_agree" in broken(lambda b: b["cards"][8].__setitem__(3, "other"))["p004"]
    assert "cards_synthetic" in broken(lambda b: b["cards"][8].__setitem__(7, 77))["p004"]
    assert "cards_in_order" in broken(lambda b: b["pairs"][5].__setitem__(8, True))["p005"]
    assert "fields_filled" in broken(lambda b: b["pairs"][6].__setitem__(5, " "))["p006"]
    assert "no_exact_copy" in broken(lambda b: None, [("Box 7", "comes  WITH fuel can 7 inside the box")])["p007"]
    long_ = " ".join(f"w{i}" for i in range(14))
    def lengthen(b):
        b["pairs"][8][1] = (b["pairs"][8][1][0], b["pairs"][8][1][1] + " " + long_, b["pairs"][8][1][2])
    assert "no_shared_span" in broken(lengthen, [("x", "y " + long_ + " z")])["p008"]
    assert {"unique_id", "surfaces_unique"} <= broken(lambda b: b["pairs"].append(b["pairs"][9]))["p009"]
    b = bundle()
    frames = [spark.createDataFrame([tuple(r) for r in b["pairs"]], PAIRS), spark.createDataFrame([tuple(r) for r in b["reviews"][1:]], REVIEWS)]
    assert [r.pair_id for r in synthetic.roster_mismatch(*frames).collect()] == ["p000"]


def test_structural_checks(spark):
    rows = spark.createDataFrame([("set with gas inside", "set with nothing inside", "gas", "nothing", "plain box"), ("set gas gas", "set with nothing", "gas", "nothing", "plain label AB-12345")], "a string, b string, sa string, sb string, fixed string")
    side = lambda t, s: {"name": F.col("fixed"), "description": F.col(t), "span": F.col(s)}
    checks = [r[0] for r in rows.select(policy.structural_checks(side("a", "sa"), side("b", "sb"), F.lit("description"))).collect()]
    assert all(checks[0].values()) and len(checks[0]) == 9
    assert {k for k, v in checks[1].items() if not v} == {"positive_slot_binds_once", "masking_slot_makes_identical", "no_meta_vocabulary", "no_sku_like_string"}


def test_dry_run(spark):
    frame = pd.DataFrame({"id": range(200), "fold": [i // 40 for i in range(200)], "label": [int(i % 40 < 5) for i in range(200)]})
    frame["blind_uid"] = [f"u{i}" for i in frame.id]
    frame["component_key"] = [f"c{i}" for i in frame.id]
    rows = spark.createDataFrame(frame).withColumns({"name": F.lit("n"), "description": F.lit("d")})
    schema = "pair_id string, positive_id long, negative_id long, boundary_code string, review_status string, eligible_query_folds array<int>, mass_key string, query_fold int"
    records = [(f"p{f}{k}", f * 40 + k, f * 40 + 10 + k, "b", "ACCEPT", [x for x in range(5) if x != f], f"m{f}{k}", f) for f in range(4) for k in range(3)]
    resolved = pairs.resolve_endpoints(spark.createDataFrame(records, schema), rows)
    report = dry_run(rows, resolved, resolved, folds=(0, 4))
    contracts.verify_self_hash(report)
    assert report["folds"]["0"]["train"] == 120 and report["folds"]["4"]["train"] == 160
    assert report["folds"]["0"]["candidate"]["query"] > 0 == report["folds"]["0"]["control"]["query"]
    with pytest.raises(contracts.ContractError):
        dry_run(rows.withColumn("component_key", F.lit("one")), resolved, resolved, folds=(0,))


def test_outputs_shares_and_freezing(spark):
    source = spark.createDataFrame([(1,), (2,)], "id long")
    good = spark.createDataFrame([(1, "ab"), (2, "b")], "id long, result string")
    contracts.check_output(source, good, "^[ab]+$")
    for bad in (good.limit(1), good.union(good), good.withColumn("result", F.lit("c")), good.withColumnRenamed("result", "r")):
        with pytest.raises(contracts.ContractError):
            contracts.check_output(source, bad, "^[ab]+$")
    contracts.require_shares(spark.createDataFrame([(0.5,), (0.5,)], "w double"), "w")
    with pytest.raises(contracts.ContractError):
        contracts.require_shares(spark.createDataFrame([(0.5,), (0.6,)], "w double"), "w")
    merged = contracts.overlay(good, spark.createDataFrame([(2, "z"), (3, "q")], "id long, result string"), "id")
    assert {(r.id, r.result) for r in merged.collect()} == {(1, "ab"), (2, "z"), (3, "q")}
    files = spark.createDataFrame([("x", 1, "h")], "path string, bytes long, sha256 string")
    recipe = contracts.freeze({"seed": 42}, files)
    contracts.check_frozen(recipe, files)
    with pytest.raises(contracts.ContractError):
        contracts.check_frozen(recipe, files.withColumn("sha256", F.lit("g")))
    with pytest.raises(contracts.ContractError):
        contracts.check_frozen(recipe | {"seed": 43}, files)
