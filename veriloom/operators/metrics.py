"""Binary metrics, comparisons of predictors, and the promotion gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.operators.ranking import running_totals


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def binary_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp and f1 (0 where undefined), in one pass."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp")
    )
    return counts.withColumn("f1", _f1(F.col("tp"), F.col("fp"), F.col("fn")))


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum over distinct scores, from high to low, of the recall gained times the precision reached. Scores are
    placed by range partitions, so no task holds all of them."""
    ties = df.groupBy(*by, F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("tp"))
    running = running_totals(ties, by, F.desc("s"), {"cn": "n", "ctp": "tp"})
    return running.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(F.col("tp") * F.col("ctp") / F.col("cn")), F.sum("tp").cast("double")), F.lit(0.0)).alias("ap"))


def rescues_harms(df: DataFrame, label: str, control: str, candidate: str) -> DataFrame:
    """Rows that only the candidate gets right, and that only the control does."""
    right = lambda c: F.col(c) == F.col(label)
    return df.agg(F.count_if(right(candidate) & ~right(control)).alias("rescues"), F.count_if(right(control) & ~right(candidate)).alias("harms"))


def promotion_gate(df: DataFrame, label: str, control: str, candidate: str, scores: tuple[str, str], ap_loss: float = 0.01) -> DataFrame:
    """One row with both arms' metrics, their differences and GO or STOP. GO needs a higher F1, more rescues than harms,
    and an average precision that falls by at most `ap_loss`."""
    a = binary_metrics(df, label, control).select(F.col("f1").alias("f1_control"))
    b = binary_metrics(df, label, candidate).select(F.col("f1").alias("f1_candidate"))
    c = average_precision(df, label, scores[0]).select(F.col("ap").alias("ap_control"))
    d = average_precision(df, label, scores[1]).select(F.col("ap").alias("ap_candidate"))
    row = a.join(b).join(c).join(d).join(rescues_harms(df, label, control, candidate))
    row = row.withColumns({"delta_f1": F.col("f1_candidate") - F.col("f1_control"), "delta_ap": F.col("ap_candidate") - F.col("ap_control")})
    go = (F.col("delta_f1") > 0) & (F.col("rescues") > F.col("harms")) & (F.col("delta_ap") >= -ap_loss)
    return row.withColumn("verdict", F.when(go, "GO").otherwise("STOP"))


def row_stats(columns: Sequence[Column], prefix: str) -> dict[str, Column]:
    """Mean, sample standard deviation, min and max across columns of a row."""
    n = len(columns)
    mean = sum(columns[1:], columns[0]) / F.lit(float(n))
    squares = [(c - mean) * (c - mean) for c in columns]
    spread = F.sqrt(sum(squares[1:], squares[0]) / F.lit(float(max(1, n - 1))))
    return {f"{prefix}_mean": mean, f"{prefix}_std": spread, f"{prefix}_min": F.least(*columns), f"{prefix}_max": F.greatest(*columns)}
