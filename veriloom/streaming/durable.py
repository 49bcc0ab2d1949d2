"""Appends that survive retries: every micro-batch is written once, however often it is tried."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veriloom.operators.contracts import ContractError
from veriloom.sources import files

_LOG = "query string, batch long, n_rows long"


def _marker(path: str, query: str, batch: int) -> str:
    return f"{path}/log/{query}.{batch:012d}.json"


def append_batch(rows: DataFrame, batch: int, path: str, query: str, before_commit: Callable[[int], None] | None = None) -> bool:
    """Adds a batch to the table at `path` unless its (query, batch) is there already; whether it was added.

    The batch's own folder is overwritten, so what a failed try has left goes; then a line is added to the commit log, one file a
    batch that can be made once only. Readers see batches that the log names, so a batch is there whole or not at all.
    `before_commit` is called between the two.
    """
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_-]*", query):
        raise ContractError(f"{query!r} is no name of a query")
    spark = rows.sparkSession
    if files.exists(spark, _marker(path, query, batch)):
        return False
    target = f"{path}/batches/query={query}/batch={batch}"
    rows.write.mode("overwrite").parquet(target)
    if before_commit:
        before_commit(batch)
    n = spark.read.schema(rows.schema).parquet(target).count()
    return files.write_new(spark, _marker(path, query, batch), json.dumps({"query": query, "batch": batch, "n_rows": n}))


def append_stream(stream: DataFrame, path: str, query: str, checkpoint: str, before_commit: Callable[[int], None] | None = None) -> StreamingQuery:
    """A stream whose batches go to `append_batch`, over what is there now; run it again for more. A query keeps its
    name and checkpoint together: by them a repeated batch is known."""

    def sink(rows: DataFrame, batch: int) -> None:
        append_batch(rows, batch, path, query, before_commit)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(query, batch, n_rows) of the batches that count."""
    if not files.names(spark, f"{path}/log"):
        return spark.createDataFrame([], _LOG)
    return spark.read.schema(_LOG).json(f"{path}/log")


def read_appended(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of the batches that the log names, with query and batch; folders of others are never read."""
    held = spark.read.schema(schema).option("basePath", f"{path}/batches")
    log = commits(spark, path)
    if log.isEmpty():
        return spark.createDataFrame([], schema).select("*", F.lit("").alias("query"), F.lit(0).cast("long").alias("batch"))
    rows = held.parquet(f"{path}/batches").withColumn("batch", F.col("batch").cast("long"))
    return rows.join(log.select("query", "batch"), ["query", "batch"], "left_semi")
