"""Out-of-fold scores by arm, fold and tag, one file a part, each bound to a manifest by its hash and checked in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions.hashing import canonical_struct
from veriloom.operators.contracts import ContractError

PART = ("arm", "fold", "tag")

#: What a manifest of scores states besides its part, rows and hashes.
SCHEMA_VERSION, STATUS, POLICY = "oof_predictions.1", "COMPLETE", "outer_train_prevalence_rank"

_MANIFEST = "arm string, fold int, tag string, train_folds string, fit string, n_rows long, predictions_sha256 string, schema_version string, status string, policy string, self_sha256 string"
_STATED = ("arm", "fold", "tag", "train_folds", "fit", "n_rows", "predictions_sha256", "schema_version", "status", "policy")


def train_folds(fold: Column, folds: int = 5) -> Column:
    """The folds that a part's model was fitted on, as text: all but the last, which is never trained on, and its own."""
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 2)), lambda f: f != fold)
    return F.array_join(F.transform(others, lambda f: f.cast("string")), ",")


def _self_hash() -> Column:
    return F.sha2(canonical_struct(**{c: F.col(c) for c in _STATED}), 256)


def _part_of(path: Column) -> dict[str, Column]:
    """The part that a file's folders name."""
    return {c: F.regexp_extract(path, f"/{c}=([^/]+)/", 1).cast("int" if c == "fold" else "string") for c in PART}


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, predictions_sha256, part) of the score files under a folder; a task hashes a file whole."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{folder}/scores")
    return found.select("path", F.sha2("content", 256).alias("predictions_sha256")).withColumns(_part_of(F.col("path")))


def write_bound(scores: DataFrame, folder: str, fit: Column, folds: int = 5) -> str:
    """Writes scores (arm, fold, tag, id, label, score, prediction) as one file a part, and a manifest a part, bound by its own
    hash. `fit` names the model that a row's score comes from, the same in all tags of an arm and fold."""
    spark = scores.sparkSession
    rows = scores.withColumn("fit", fit)
    rows.drop("fit").repartition(*PART).write.partitionBy(*PART).parquet(f"{folder}/scores")
    parts = rows.groupBy(*PART).agg(F.count("*").alias("n_rows"), F.min("fit").alias("fit"))
    stated = _files(spark, folder).join(parts, list(PART)).withColumns(
        {"train_folds": train_folds(F.col("fold"), folds), "schema_version": F.lit(SCHEMA_VERSION), "status": F.lit(STATUS), "policy": F.lit(POLICY)}
    )
    stated.select(*_STATED, _self_hash().alias("self_sha256")).write.json(f"{folder}/manifests")
    return folder


def audit(spark: SparkSession, folder: str, roster: DataFrame, folds: int = 5) -> DataFrame:
    """(arm, fold, tag, path, n_rows, positives, problem) of every part that has a file or a manifest; problem is null where all
    holds, else the first of: no manifest, no file, two files, manifest, hash, rows, repeated ids, roster, labels, values, fits.

    Scores are read once, each row with the file that it came from; the same files are hashed, and both meet the
    manifests by part. The roster (id, fold, label) must be, fold by fold, what each part scores. `fits`: the tags of an arm and
    fold come from different models.
    """
    schema = "id long, label int, score double, prediction int"
    scanned = spark.read.schema(f"{schema}, arm string, fold int, tag string").option("basePath", f"{folder}/scores").parquet(f"{folder}/scores")
    truth = roster.select("id", F.col("fold").alias("of_fold"), F.col("label").cast("int").alias("truth"))
    rows = scanned.join(truth, "id", "left")
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf")) & F.col("prediction").isin(0, 1)
    bad = lambda c: F.count_if(~F.coalesce(c, F.lit(False)))
    seen = rows.groupBy(*PART, "id").agg(
        F.count("*").alias("n"), F.sum("label").alias("p"), bad(F.col("of_fold") == F.col("fold")).alias("strange"), bad(F.col("label") == F.col("truth")).alias("unlike"), bad(finite).alias("invalid"),
    ).groupBy(*PART).agg(
        F.sum("n").alias("n_rows"), F.sum("p").alias("positives"), F.count("id").alias("ids"), F.sum("strange").alias("strange"), F.sum("unlike").alias("unlike"), F.sum("invalid").alias("invalid"),
    )
    sizes = roster.groupBy("fold").agg(F.count("*").alias("expected"))
    files = _files(spark, folder).groupBy(*PART).agg(F.min("path").alias("path"), F.count("*").alias("files"), F.min("predictions_sha256").alias("found_sha256"))
    manifests = spark.read.schema(_MANIFEST).json(f"{folder}/manifests")
    holds = [_self_hash() == F.col("self_sha256"), F.col("schema_version") == SCHEMA_VERSION, F.col("status") == STATUS, F.col("policy") == POLICY, F.col("train_folds") == train_folds(F.col("fold"), folds)]
    manifests = manifests.withColumn("holds", reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in holds]))
    told = manifests.groupBy(*PART).agg(F.count("*").alias("told"), F.min("holds").alias("holds"), F.min("predictions_sha256").alias("told_sha256"), F.min("n_rows").alias("told_rows"), F.min("fit").alias("fit"))
    fits = told.groupBy("arm", "fold").agg((F.count_distinct("fit") > 1).alias("mixed"))
    both = files.join(told, list(PART), "full").join(seen, list(PART), "left").join(sizes, "fold", "left").join(fits, ["arm", "fold"], "left")
    checks = {
        "no manifest": F.col("told").isNull(), "no file": F.col("files").isNull(), "two files": F.col("files") > 1, "manifest": ~F.col("holds") | (F.col("told") > 1),
        "hash": F.col("found_sha256") != F.col("told_sha256"), "rows": F.col("n_rows").isNull() | (F.col("n_rows") != F.col("told_rows")), "repeated ids": F.col("n_rows") != F.col("ids"),
        "roster": (F.col("strange") > 0) | ~F.col("ids").eqNullSafe(F.col("expected")), "labels": F.col("unlike") > 0, "values": F.col("invalid") > 0, "fits": F.col("mixed"),
    }
    problem = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()])
    return both.select(*PART, "path", "n_rows", "positives", problem.alias("problem"))


def read_bound(spark: SparkSession, folder: str, roster: DataFrame, arms: int = 2, folds: int = 5, tags: int = 3) -> DataFrame:
    """The scores, if there are all parts and `audit` finds nothing."""
    found = audit(spark, folder, roster, folds)
    n, wrong = found.agg(F.count("*"), F.count("problem")).first()
    if wrong:
        first = found.where("problem is not null").orderBy(*PART).first()
        raise ContractError(f"{wrong} of {n} parts: {first['path'] or tuple(first[c] for c in PART)}: {first['problem']}")
    if n != arms * folds * tags:
        raise ContractError(f"{n} parts instead of {arms * folds * tags}")
    return spark.read.option("basePath", f"{folder}/scores").parquet(f"{folder}/scores")
