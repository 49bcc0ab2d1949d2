"""The score-feature matrix: 39 base columns, 71 with a second arm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.operators.metrics import row_stats
from veriloom.operators.ranking import pct_ranks, zscores

#: The five score sources, and the three of the second arm.
BASES = ("b1", "char", "lora025", "lora050", "lora100")
TRAJECTORY = ("lora025", "lora050", "lora100")
DELTAS = (("lora050", "lora025", "lora_delta_050_025"), ("lora100", "lora050", "lora_delta_100_050"), ("lora100", "lora025", "lora_delta_100_025"))
META = ("id", "blind_uid", "component_key", "fold", "label")


def _normalised(df: DataFrame, sources: dict[str, str], fold: str) -> DataFrame:
    """Rank and z-score within the fold of each score. Ranks are made of (id, fold, score) alone; no task holds a fold."""
    ranks = pct_ranks(df.select("id", fold, *sources.values()), "id", [fold], {f"{n}_rank": s for n, s in sources.items()})
    return zscores(df, [fold], {f"{n}_z": s for n, s in sources.items()}).join(ranks, "id")


def base_features(rows: DataFrame, signals: DataFrame) -> DataFrame:
    """META and the 39 base features. rows: META, component_size, image_count, name, description; signals: id and
    {base}_score, {base}_prediction of every base. Rows without signals go."""
    df = _normalised(rows.join(signals, "id"), {b: f"{b}_score" for b in BASES}, "fold")
    out: dict[str, Column] = {}
    for b in BASES:
        out |= {f"{b}_score": F.col(f"{b}_score"), f"{b}_rank": F.col(f"{b}_rank"), f"{b}_z": F.col(f"{b}_z"), f"{b}_prediction": F.col(f"{b}_prediction")}
    out["vote_count"] = sum((F.col(f"{b}_prediction") for b in BASES), F.lit(0))
    for kind in ("z", "rank"):
        out |= row_stats([F.col(f"{b}_{kind}") for b in BASES], kind)
    for left, right, name in DELTAS:
        out[f"{name}_score"] = F.col(f"{left}_z") - F.col(f"{right}_z")
        out[f"{name}_rank"] = F.col(f"{left}_rank") - F.col(f"{right}_rank")
    out["component_log1p"] = F.log1p(F.col("component_size").cast("double"))
    out["image_count"] = F.col("image_count").cast("double")
    out["name_chars_log1p"] = F.log1p(F.length(F.coalesce("name", F.lit(""))).cast("double"))
    out["description_chars_log1p"] = F.log1p(F.length(F.coalesce("description", F.lit(""))).cast("double"))
    return df.select(*META, *[c.alias(n) for n, c in out.items()])


def augmented_features(rows: DataFrame, control: DataFrame, candidate: DataFrame) -> DataFrame:
    """The base features and 32 of the candidate arm: its scores, and their distance from the control's."""
    renamed = candidate.select("id", *[F.col(f"{t}_{k}").alias(f"cand_{t}_{k}") for t in TRAJECTORY for k in ("score", "prediction")])
    base = base_features(rows, control)
    df = _normalised(base.join(renamed, "id"), {f"cand_{t}": f"cand_{t}_score" for t in TRAJECTORY}, "fold")
    out: dict[str, Column] = {}
    for t in TRAJECTORY:
        p = f"round7_{t}"
        for k in ("score", "rank", "z", "prediction"):
            out[f"{p}_{k}"] = F.col(f"cand_{t}_{k}")
        for k in ("score", "rank", "z"):
            out[f"{p}_delta_{k}"] = F.col(f"cand_{t}_{k}") - F.col(f"{t}_{k}")
        out[f"{p}_disagrees_control"] = (F.col(f"cand_{t}_prediction") != F.col(f"{t}_prediction")).cast("byte")
    out["round7_vote_count"] = sum((out[f"round7_{t}_prediction"] for t in TRAJECTORY), F.lit(0))
    out["round7_control_disagreement_count"] = sum((out[f"round7_{t}_disagrees_control"] for t in TRAJECTORY), F.lit(0))
    for kind in ("rank", "z"):
        stats = row_stats([out[f"round7_{t}_delta_{kind}"] for t in TRAJECTORY], f"round7_delta_{kind}")
        out |= {k: v for k, v in stats.items() if not k.endswith("_std")}
    return df.select(*base.columns, *[c.alias(n) for n, c in out.items()])


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in META]


def feature_contract(df: DataFrame, expected: int) -> None:
    """Raises unless there are `expected` distinct features, none a rule's, and every value is finite."""
    names = feature_columns(df)
    if len(names) != expected or len(set(names)) != expected or any(n.startswith("rule_") for n in names):
        raise ValueError(f"feature columns drift: {len(names)} instead of {expected}")
    bad = F.lit(False)
    for n in names:
        x = F.col(n).cast("double")
        bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    if n_bad := df.where(bad).count():
        raise ValueError(f"{n_bad} rows hold values that are not finite")
