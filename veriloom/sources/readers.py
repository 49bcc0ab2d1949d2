"""Sources: projected Parquet, strict JSON lines and CSV, self-hashed JSON, bound files, inventories, partitioned scores."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.functions.text import clean_text
from veriloom.operators.contracts import ContractError, require, require_columns, require_unique, roster_difference, verify_self_hash
from veriloom.sources.delimited import read_csv
from veriloom.sources.files import qualified


def read_projected(spark: SparkSession, path: str, columns: Iterable[str], forbidden: str | None = None) -> DataFrame:
    """The named columns of a Parquet table; others are never read."""
    return require_columns(spark.read.parquet(path), columns, forbidden)


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Objects, one a line; blank lines are skipped, and a line that is no object of the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_inference_csv(spark: SparkSession, path: str, categories: Iterable[str], split_bytes: int | None = None) -> DataFrame:
    """id, name, description, category and the row's ordinal, 0, 1, ... over all files. Ids must be whole, present and unique;
    categories, once cleaned, known. An unnamed index column is never looked at. Files are read by ranges of bytes (`delimited`)."""
    rows = require_columns(read_csv(spark, path, split_bytes), ("ordinal", "id", "name", "description", "category"))
    rows = rows.withColumn("category", clean_text(F.col("category")))
    number = F.expr("try_cast(id AS double)")
    require(rows, id_is_whole=number.isNotNull() & (F.floor(number) == number), category_is_known=F.col("category").isin(*categories))
    return require_unique(rows.withColumn("id", number.cast("long")), "id")


def read_self_hashed(path: str | Path) -> dict[str, Any]:
    """A JSON object whose self_sha256 holds."""
    payload = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(payload, dict):
        raise ContractError(f"{path} is not an object")
    verify_self_hash(payload)
    return payload


def inventory(spark: SparkSession, folder: str, pattern: str = "*", without: Iterable[str] = ()) -> DataFrame:
    """(path, bytes, sha256) of the files under a folder, hashed by the tasks. `without`: regular expressions; files whose path
    below the folder one of them is found in are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    below = F.substr("path", F.lit(len(qualified(spark, folder)) + 2))
    for expression in without:
        files = files.where(~below.rlike(expression))
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def bound_file(spark: SparkSession, root: str, reference: dict[str, Any]) -> str:
    """The path of a file under root, if its name stays inside and its size and hash are those stated."""
    name = str(reference["path"])
    if name.startswith("/") or ".." in name.split("/") or ":" in name:
        raise ContractError(f"{name} leaves its folder")
    found = spark.read.format("binaryFile").load(f"{root}/{name}").select("length", F.sha2("content", 256)).first()
    if found is None or (found[0], found[1]) != (reference["bytes"], reference["sha256"]):
        raise ContractError(f"{name} is not the file that was bound")
    return f"{root}/{name}"


def read_out_of_fold(spark: SparkSession, path: str, roster: DataFrame, arms: int = 2, folds: int = 5, tags: int = 3) -> DataFrame:
    """Scores partitioned by arm, fold and tag, checked against the roster (id, label) in every part."""
    scores = spark.read.parquet(path)
    parts = scores.groupBy("arm", "fold", "tag").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))
    require(parts, ids_are_unique=F.col("n") == F.col("ids"))
    if (n := parts.count()) != arms * folds * tags:
        raise ContractError(f"{n} parts instead of {arms * folds * tags}")
    per_arm = scores.groupBy("arm", "tag", "id").agg(F.count("*").alias("n"), F.min("label").alias("label"))
    require(per_arm, scored_once=F.col("n") == 1)
    for side in (roster_difference(roster, scores, "id"), per_arm.join(roster.withColumnRenamed("label", "truth"), "id").where("label <> truth")):
        if side.limit(1).count():
            raise ContractError("scores and roster differ")
    return scores
