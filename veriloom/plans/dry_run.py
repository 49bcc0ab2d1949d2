"""End-to-end acceptance without a model: splits, pair selection and both arms' schedules for every query fold."""

from __future__ import annotations

from collections import defaultdict
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.functions.hashing import canonical_sha256
from veriloom.operators import pairs as P
from veriloom.operators import schedule
from veriloom.operators.contracts import ContractError, bind_self_hash


def _orders(train: DataFrame, real: DataFrame, query: DataFrame, candidate: bool, batch: int, seed: str) -> dict[str, Any]:
    """Hashes of one arm's orders. Pair tables are hundreds of rows and are drawn on the driver; rows are not."""
    n = train.count()
    plan = schedule.plan_draws(n, batch, 4, 4, 2, candidate, 0.03)
    ordered = schedule.stratified_order(train, batch, seed)
    # The epoch's order as one hash of (position, uid) hashes, summed, so that no task holds all of it.
    digest = ordered.agg(F.sum(F.xxhash64("position", "blind_uid").cast("decimal(38,0)")), F.count("*")).first()
    groups: dict[str, list[int]] = defaultdict(list)
    for i, r in enumerate(real.orderBy("pair_id").select("positive_component_key").collect()):
        groups[r[0]].append(i)
    drawn = schedule.group_cycle_draws(groups, plan["real"] if groups else 0, f"{seed}:real")
    weights = [r[0] for r in P.reuse_mass(query).orderBy("pair_id").select("normalized_pair_weight").collect()]
    asked = schedule.weighted_draws(weights, plan["query"] if weights else 0, f"{seed}:query")
    return plan | {
        "ce_sha256": canonical_sha256([str(digest[0]), digest[1]]), "real_sha256": canonical_sha256(drawn), "synthetic_sha256": canonical_sha256([]),
        "query_sha256": canonical_sha256(asked), "query": len(asked), "real": len(drawn),
    }


def dry_run(rows: DataFrame, real: DataFrame, query: DataFrame, batch: int = 32, seed: str = "42", folds: tuple[int, ...] = (0, 1, 2, 3, 4)) -> dict[str, Any]:
    """A self-hashed report. rows: id, blind_uid, label, fold, component_key; real and query: resolved pairs. A component on
    both sides of a split, or arms that differ in more than the query pairs, stop it."""
    report: dict[str, Any] = {"folds": {}}
    for fold in folds:
        split = P.fold_split(rows, fold)
        if P.shared_components(split).limit(1).count():
            raise ContractError(f"fold {fold} shares components with its training rows")
        train = split.where("role = 'train'").select("id", "blind_uid", "label")
        mine = P.for_query_fold(real, fold)
        asked = P.first_of_mass(query.where(F.col("query_fold") == fold))
        arms = {arm: _orders(train, mine, asked, arm == "candidate", batch, seed) for arm in ("control", "candidate")}
        broken = [k for k in schedule.same_arms(arms["control"], arms["candidate"]) if k != "query"]
        if broken or arms["control"]["query"]:
            raise ContractError(f"arms of fold {fold} differ in {broken or 'query'}")
        report["folds"][str(fold)] = arms | {"train": train.count(), "query": split.where("role = 'query'").count(), "real_pairs": mine.count(), "query_pairs": asked.count()}
    return bind_self_hash(report)
