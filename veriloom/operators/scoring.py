"""External scorers behind one protocol, with a deterministic stand-in, and trained linear experts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC
from pyspark.ml.feature import HashingTF, IDF, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions.hashing import expit
from veriloom.operators.contracts import ContractError, require_unique, roster_difference
from veriloom.session import materialised

#: Texts in, scores out; called once per batch on an executor.
Scorer = Callable[[Sequence[str]], Sequence[float]]


def mock_scorer(namespace: str) -> Scorer:
    """Scores in [-1, 1] fixed by the text's hash. Never to be reported as a model's."""

    def score(texts: Sequence[str]) -> list[float]:
        digests = (hashlib.sha256(f"{namespace}\0{t}".encode()).hexdigest()[:16] for t in texts)
        return [int(d, 16) / (16**16 - 1) * 2 - 1 for d in digests]

    return score


def apply_scorer(df: DataFrame, text: str, scorer: Scorer, out: str = "score", batch: int = 64) -> DataFrame:
    """Adds the scorer's value to every row. Within a partition rows are scored by length, so batches pad little."""
    source = df.sortWithinPartitions(F.length(text))
    schema = df.schema.add(out, "double")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            scores = [s for i in range(0, len(texts), batch) for s in scorer(texts[i : i + batch])]
            yield frame.assign(**{out: scores})

    return source.mapInPandas(run, schema)


def linear_expert(rows: DataFrame, terms: Column, label: str, weight: str, features: int = 1 << 18, iterations: int = 50) -> PipelineModel:
    """TF-IDF over hashed terms and a linear support-vector machine with row weights."""
    stages = [HashingTF(inputCol="__terms", outputCol="__tf", numFeatures=features), IDF(inputCol="__tf", outputCol="__x", minDocFreq=2)]
    svc = LinearSVC(featuresCol="__x", labelCol="__y", weightCol=weight, maxIter=iterations, regParam=1e-3)
    shaped = rows.withColumn("__terms", terms).withColumn("__y", F.col(label).cast("double"))
    return Pipeline(stages=[*stages, svc]).fit(shaped)


def expert_scores(model: PipelineModel, rows: DataFrame, terms: Column, out: str) -> DataFrame:
    """Adds {out}_margin, {out}_score (its sigmoid) and {out}_prediction."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(rows.withColumn("__terms", terms))
    margin = vector_to_array("rawPrediction")[1]
    return scored.select(*rows.columns, margin.alias(f"{out}_margin"), expit(margin).alias(f"{out}_score"), (margin >= 0).cast("int").alias(f"{out}_prediction"))


def out_of_fold(rows: DataFrame, folds: Iterable[int], fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], fold: str = "fold", id_: str = "id") -> DataFrame:
    """Each fold scored by a model fitted on the others. Folds that share an id, rows of no such fold, and rows that are not
    scored exactly once are errors."""
    require_unique(rows, id_)
    out, folds = None, list(folds)
    for k in folds:
        part = fit(rows.where(F.col(fold) != k))(rows.where(F.col(fold) == k))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no folds")
    out = materialised(out)
    require_unique(out, id_)
    if lost := roster_difference(rows, out, id_).count():
        raise ContractError(f"{lost} rows are not scored once by a fold of {folds}")
    return out


#: The selector's trees, depth and step.
TREES, DEPTH, STEP = 800, 4, 0.03


def selector(rows: DataFrame, features: Sequence[str], label: str, weight: str, trees: int = TREES, depth: int = DEPTH, step: float = STEP) -> PipelineModel:
    """Gradient-boosted trees over a feature matrix. Trees are grown one after the other, so fewer of them, with a larger
    step, are what tests and trials should ask for."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="__x"), GBTClassifier(featuresCol="__x", labelCol=label, weightCol=weight, maxIter=trees, maxDepth=depth, stepSize=step, seed=1)]
    return Pipeline(stages=stages).fit(rows)
