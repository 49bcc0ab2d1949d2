import pytest
from pyspark.sql import functions as F

from veriloom.operators import artifacts, contracts
from veriloom.operators.contracts import ContractError, bind_self_hash

FILES = "path string, bytes long, sha256 string"
TAGS = ("early", "middle", "last")


def test_receipts(spark):
    held = artifacts.receipt("box@sha256:" + "a" * 64, True, hardware="one")
    contracts.verify_self_hash(held)
    files = spark.createDataFrame([("w", 3, "x")], FILES)
    checkpoint = bind_self_hash({"receipt_sha256": held["self_sha256"], "files": [{"path": "w", "bytes": 3, "sha256": "x"}]})
    artifacts.check_receipt(held, checkpoint, files)
    other = spark.createDataFrame([("w", 3, "y")], FILES)
    for broken in (lambda: artifacts.check_receipt(held, checkpoint, other), lambda: artifacts.check_receipt(bind_self_hash(held | {"image": "z"}), checkpoint, files),
                   lambda: artifacts.receipt("box:latest", True), lambda: artifacts.receipt("box@sha256:1", False)):
        with pytest.raises(ContractError):
            broken()
    assert artifacts.environment(["pyspark", "no-such-package"])["packages"]["no-such-package"] is None


def manifests(**change):
    rows = []
    for arm in ("control", "candidate"):
        for fold in range(3):
            for tag in TAGS:
                path = f"{arm}/{fold}/{tag}"
                row = {"path": path, "arm": arm, "fold": fold, "tag": tag, "status": "COMPLETE", "train_folds": [f for f in (0, 1) if f != fold], "labels_used": False, "predictions_sha256": f"h{path}", "fit_sha256": f"{arm}{fold}"}
                rows.append(row | (change if path == "control/1/middle" else {}))
    return rows


def test_predictions(spark):
    kind = "path string, arm string, fold int, tag string, status string, train_folds array<int>, labels_used boolean, predictions_sha256 string, fit_sha256 string"
    frame = lambda rows: spark.createDataFrame([tuple(r[k.split()[0]] for k in kind.split(", ")) for r in rows], kind)
    files = frame(manifests()).select("path", F.lit(1).alias("bytes"), F.col("predictions_sha256").alias("sha256"))
    fits = artifacts.check_predictions(frame(manifests()), files, range(3), TAGS)
    assert {(r.arm, r.fold): r.fit_sha256 for r in fits.collect()} == {(a, f): f"{a}{f}" for a in ("control", "candidate") for f in range(3)}
    for change in ({"status": "PARTIAL"}, {"train_folds": [0, 1]}, {"labels_used": True}, {"predictions_sha256": "other"}, {"fit_sha256": "another"}, {"tag": "early"}, {"arm": "third"}):
        with pytest.raises(ContractError):
            artifacts.check_predictions(frame(manifests(**change)), files, range(3), TAGS)
    with pytest.raises(ContractError):
        artifacts.check_predictions(frame(manifests()[1:]), files, range(3), TAGS)


def test_reviews(spark):
    kind = "pair_id string, label_a int, label_b int, same_product_frame boolean, single_causal_boundary boolean, pair_usable boolean, observed_slot string, evidence_a string, evidence_b string, reject_reason string"
    good = ("p", 1, 0, True, True, True, "s", "a", "b", "NONE")
    pairs = spark.createDataFrame([("p",)], "pair_id string")
    assert artifacts.check_reviews(spark.createDataFrame([good], kind), pairs).count() == 1
    for i, value in ((0, "q"), (1, 2), (2, None), (5, None), (7, "  "), (9, None)):
        with pytest.raises(ContractError):
            artifacts.check_reviews(spark.createDataFrame([(*good[:i], value, *good[i + 1 :])], kind), pairs)
    with pytest.raises(ContractError):
        artifacts.check_reviews(spark.createDataFrame([good, good], kind), pairs)
    reasons = spark.createDataFrame([("b",), ("a",), ("b",)], "why string")
    assert list(artifacts.histogram(reasons, "why").items()) == [("a", 1), ("b", 2)]


def test_bundle(spark):
    fit = {"status": "FIT_COMPLETE", "full_fit": True, "query_fold": None, "checkpoints": [{"tag": t} for t in TAGS], "seed": 42}
    parts = {
        "control": fit | {"arm": "control", "query_weight": 0}, "candidate": fit | {"arm": "candidate", "query_weight": 3},
        "selector": {"status": "COMPLETE", "all_inputs_out_of_fold": True, "features": 71, "rule_features": False}, "code": {"status": "COMPLETE", **dict.fromkeys(artifacts.EXCLUDED, False)},
    }
    files = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], FILES)

    def build(**change):
        made = {k: bind_self_hash(v | change.get(k, {})) for k, v in parts.items()}
        return artifacts.bundle(**made, files=files, tags=TAGS, may_differ=["query_weight"])

    first = build()
    contracts.verify_self_hash(first)
    assert first == build() and first["files"] == 2
    for change in ({"control": {"seed": 1}}, {"candidate": {"status": "RUNNING"}}, {"selector": {"features": 70}}, {"code": {"contains_rows": True}}, {"control": {"checkpoints": []}}):
        with pytest.raises(ContractError):
            build(**change)
    digest = artifacts.policy_digest({"a": "x"})
    assert digest == artifacts.policy_digest({"a": "x"}) != artifacts.policy_digest({"a": "y"})
