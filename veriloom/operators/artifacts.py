"""What a run leaves behind: fingerprints, receipts, fits and their predictions, reviews, and the bundle that binds them."""

from __future__ import annotations

import importlib.metadata
import platform
import sys
from collections.abc import Iterable, Mapping, Sequence
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.functions.hashing import canonical_sha256
from veriloom.operators import policy_tables
from veriloom.operators.contracts import ContractError, bind_self_hash, check_provenance, require, require_unique, roster_difference, verify_self_hash

PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy")
#: What an archive states that it does not hold.
EXCLUDED = ("contains_rows", "contains_labels", "contains_weights", "contains_predictions", "contains_credentials")


def environment(packages: Iterable[str] = PACKAGES) -> dict[str, Any]:
    """Interpreter, platform and package versions, now. It differs from run to run: keep it out of what is hashed to be stable."""

    def version(name: str) -> str | None:
        try:
            return importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            return None

    return {"at": datetime.now(UTC).isoformat(), "python": sys.version, "platform": platform.platform(), "machine": platform.machine(), "packages": {n: version(n) for n in packages}}


def receipt(image: str, network_disabled: bool, **stated: Any) -> dict[str, Any]:
    """A self-hashed statement of where a fit ran: an image by its immutable name, and without a network."""
    if "@sha256:" not in image or not network_disabled:
        raise ContractError("a receipt needs an image by digest and no network")
    return bind_self_hash({"status": "PASS", "image": image, "network_disabled": True, "packages": environment()["packages"], **stated})


def check_receipt(held: Mapping[str, Any], checkpoint: Mapping[str, Any], files: DataFrame) -> None:
    """Raises unless the receipt holds, the checkpoint names it, and the checkpoint's files (path, bytes, sha256) are as it says."""
    verify_self_hash(held)
    verify_self_hash(checkpoint)
    if held.get("status") != "PASS" or checkpoint.get("receipt_sha256") != held["self_sha256"]:
        raise ContractError("the checkpoint is not of this receipt")
    now = {r["path"]: (r["bytes"], r["sha256"]) for r in files.collect()}
    stated = {f["path"]: (f["bytes"], f["sha256"]) for f in checkpoint["files"]}
    if now != stated:
        raise ContractError(f"files differ from the checkpoint's: {sorted(set(now.items()) ^ set(stated.items()))}")


def check_predictions(manifests: DataFrame, files: DataFrame, folds: Sequence[int], tags: Sequence[str], arms: Sequence[str] = ("control", "candidate")) -> DataFrame:
    """(arm, fold, fit_sha256): the one fit behind all predictions of an arm and fold.

    manifests: path, arm, fold, tag, status, train_folds, labels_used, predictions_sha256, fit_sha256, one for each of
    arms x folds x tags. The greatest fold is the last test: its predictions are of a fit on all others; those of any other fold
    are of a fit on the rest without the last. files (path, sha256) must be what the manifests state.
    """
    last = max(folds)
    rest = F.array(*[F.lit(int(f)) for f in sorted(folds) if f != last])
    trained = F.when(F.col("fold") == last, rest).otherwise(F.array_remove(rest, F.col("fold")))
    joined = manifests.join(files.select("path", F.col("sha256").alias("observed")), "path", "left")
    require(
        joined, complete=F.col("status") == "COMPLETE", other_folds=F.array_sort("train_folds") == trained, no_labels_used=~F.col("labels_used"), known_tag=F.col("tag").isin(*tags), known_arm=F.col("arm").isin(*arms),
        file_as_stated=F.col("observed") == F.col("predictions_sha256"),
    )
    require_unique(manifests, "arm", "fold", "tag")
    if (n := manifests.count()) != len(arms) * len(folds) * len(tags):
        raise ContractError(f"{n} manifests instead of {len(arms) * len(folds) * len(tags)}")
    fits = manifests.groupBy("arm", "fold").agg(F.count_distinct("fit_sha256").alias("fits"), F.min("fit_sha256").alias("fit_sha256"))
    return require(fits, one_fit=F.col("fits") == 1).drop("fits")


def check_reviews(reviews: DataFrame, pairs: DataFrame) -> DataFrame:
    """The reviews, by pair id, if there is one complete one for each pair: labels of 0 and 1, whole booleans, no blank answer."""
    require_unique(reviews, "pair_id")
    if not roster_difference(pairs, reviews, "pair_id").isEmpty():
        raise ContractError("reviews and pairs have different ids")
    filled = {c: F.trim(F.coalesce(c, F.lit(""))) != "" for c in ("observed_slot", "evidence_a", "evidence_b", "reject_reason")}
    decided = {c: F.col(c).isNotNull() for c in ("same_product_frame", "single_causal_boundary", "pair_usable")}
    return require(reviews, label_a=F.col("label_a").isin(0, 1), label_b=F.col("label_b").isin(0, 1), **filled, **decided)


def histogram(rows: DataFrame, reason: str) -> dict[str, int]:
    """How many rows give each reason (there are few), in the order of the reasons."""
    return {r[0]: r[1] for r in rows.groupBy(reason).agg(F.count("*")).orderBy(reason).collect()}


def policy_digest(prompts: Mapping[str, str]) -> str:
    """One hash of all that decides a comment's text: prompts, phrases, bases and markers."""
    keyed = lambda which: {f"{c}|{v}": list(policy_tables.allowed(c, v, which)) for c, v in policy_tables.ALLOWED}
    phrases = {w: {b: policy_tables.phrase(b, w) for b in policy_tables.PHRASES} for w in ("A", "B")}
    return canonical_sha256({"prompts": dict(prompts), "phrases": phrases, "allowed": {w: keyed(w) for w in ("A", "B")}, "markers": {k: list(v) for k, v in policy_tables.MARKERS.items()}})


def bundle(control: Mapping[str, Any], candidate: Mapping[str, Any], selector: Mapping[str, Any], code: Mapping[str, Any], files: DataFrame, tags: Sequence[str], may_differ: Iterable[str], features: int = 71) -> dict[str, Any]:
    """A self-hashed manifest over two full fits, the selector and the code that made them, with an inventory of their files.

    All four verify their own hashes. The fits are complete, have every checkpoint, and state the same but for `may_differ`; the
    selector saw only out-of-fold inputs; the code states that it holds none of EXCLUDED.
    """
    for part in (control, candidate, selector, code):
        verify_self_hash(part)
    for arm, fit in (("control", control), ("candidate", candidate)):
        check_provenance(fit, {"arm": arm, "status": "FIT_COMPLETE", "full_fit": True, "query_fold": None})
        if [c["tag"] for c in fit["checkpoints"]] != list(tags):
            raise ContractError(f"the {arm} fit lacks checkpoints")
    free = {*may_differ, "arm", "checkpoints", "self_sha256"}
    if drift := sorted(k for k in {*control, *candidate} - free if control.get(k) != candidate.get(k)):
        raise ContractError(f"the fits differ in {drift}")
    check_provenance(selector, {"status": "COMPLETE", "all_inputs_out_of_fold": True, "features": features, "rule_features": False})
    check_provenance(code, {"status": "COMPLETE", **dict.fromkeys(EXCLUDED, False)})
    held = sorted((r["path"], r["bytes"], r["sha256"]) for r in files.collect())
    hashes = {name: part["self_sha256"] for name, part in (("control", control), ("candidate", candidate), ("selector", selector), ("code", code))}
    return bind_self_hash({"status": "COMPLETE", "differ_in": sorted(may_differ), "parts": hashes, "inventory_sha256": canonical_sha256([list(h) for h in held]), "files": len(held), **dict.fromkeys(EXCLUDED, False)})
