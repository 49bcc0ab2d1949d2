"""Sinks: write-once and validated Parquet, canonical JSON lines, atomic JSON, event logs, keyed caches."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.operators.contracts import ContractError
from veriloom.sources import delimited


def write_once(df: DataFrame, path: str) -> str:
    """Parquet at a path that must not exist."""
    df.write.mode("errorifexists").parquet(path)
    return path


def publish(df: DataFrame, path: str, validate: Callable[[DataFrame], Any]) -> str:
    """Writes beside `path`, validates what was written, and only then renames it into place."""
    spark = df.sparkSession
    staging = f"{path}.staging"
    df.write.mode("overwrite").parquet(staging)
    validate(spark.read.parquet(staging))
    jvm = spark.sparkContext._jvm
    target, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(staging)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(target) or not system.rename(source, target):
        raise ContractError(f"{path} exists or cannot be published")
    return path


def write_ordered_csv(df: DataFrame, path: str, ordinal: str = "ordinal") -> str:
    """A folder with one CSV file, rows by ordinal, which many tasks write (`delimited.write_ordered_csv`)."""
    delimited.write_ordered_csv(df, f"{path}/part-00000.csv", ordinal)
    return path


def write_json_lines(df: DataFrame, line: Column, path: str) -> str:
    """One canonical JSON object a line."""
    df.select(line.alias("value")).write.text(path)
    return path


def append_events(df: DataFrame, path: str) -> str:
    df.write.mode("append").json(path)
    return path


def write_json_atomic(path: str | Path, value: Any) -> None:
    """Sorted, indented JSON without NaN; the file is complete or not there."""
    path = Path(path)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=path.parent, prefix=f".{path.name}.", delete=False) as handle:
        json.dump(value, handle, ensure_ascii=False, sort_keys=True, indent=2, allow_nan=False)
        handle.write("\n")
        handle.flush()
        os.fsync(handle.fileno())
    os.replace(handle.name, path)


def replay(requests: DataFrame, cache: DataFrame, request: Column, out: str = "response") -> DataFrame:
    """Each request with its cached response, found by the hash of its canonical form; null where none is held."""
    keyed = cache.select(F.col("key").alias("__key"), F.col("response").alias(out))
    return requests.withColumn("__key", F.sha2(request, 256)).join(keyed, "__key", "left").drop("__key")
