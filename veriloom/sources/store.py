"""A store of responses by the hash of their request: read at a version, added to by commits that one writer wins."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.operators.contracts import ContractError
from veriloom.session import materialised, remove
from veriloom.sources import files

_ROWS = "key string, response string"


def request_key(request: Column) -> Column:
    """The key of a request in its canonical form."""
    return F.sha2(request, 256)


def version(spark: SparkSession, folder: str) -> int:
    """The store's newest version: the number of its commits."""
    return sum(n.endswith(".json") for n in files.names(spark, f"{folder}/log"))


def _segment(spark: SparkSession, folder: str, n: int) -> str:
    return f"{folder}/segments/segment={json.loads(files.read_text(spark, f'{folder}/log/{n:012d}.json'))['segment']}"


def read(spark: SparkSession, folder: str, at: int, since: int = 0) -> DataFrame:
    """(key, response) of a version, or of the commits after `since`; later commits change nothing that was read."""
    paths = [_segment(spark, folder, n) for n in range(since, at)]
    if not paths:
        return spark.createDataFrame([], _ROWS)
    return spark.read.schema(_ROWS).option("basePath", f"{folder}/segments").parquet(*paths).select("key", "response")


def put(responses: DataFrame, folder: str, at: int) -> int:
    """Adds (key, response) rows, one a key, whose keys are not in version `at`; the version that has them all.

    Rows are written as a segment by the first two digits of their keys, and the segment becomes the next commit. If
    another writer has made that commit, its keys are dropped from ours and the one after it is tried: of two responses to
    one request the first committed stays, and no key is there twice. Segments that were not committed are removed.
    """
    spark = responses.sparkSession
    rows = materialised(responses.select("key", "response"))
    while not rows.isEmpty():
        name = uuid.uuid4().hex
        target = f"{folder}/segments/segment={name}"
        bucket = F.substring("key", 1, 2)
        rows.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(target)
        if files.write_new(spark, f"{folder}/log/{at:012d}.json", json.dumps({"segment": name})):
            return at + 1
        remove(spark, target)
        rows = materialised(rows.join(read(spark, folder, at + 1, at), "key", "left_anti"))
        at += 1
    return at


def complete(requests: DataFrame, folder: str, request: Column, respond: Callable[[DataFrame], DataFrame], out: str = "response", cost: Column | None = None, cap: float | None = None) -> tuple[DataFrame, int]:
    """requests with `out`, the response to each, and the version of the store that holds them.

    Requests of one key are one. Those that the store has not are given to `respond`, (key, request) to (key, response), once,
    and what comes back is written before it is used, so that lost executors ask for nothing twice; responses are then read
    from the store. A null request has no response. With `cap`, the cost of what is missing is summed first, and if it is
    more nothing is asked. A request that `respond` leaves out is an error.
    """
    spark = requests.sparkSession
    at = version(spark, folder)
    key, own = "__key", requests.withColumn("__request", request)
    own = own.withColumn(key, request_key(F.col("__request")))
    asked = own.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col("__request").alias("request"), (cost if cost is not None else F.lit(0.0)).cast("double").alias("cost"))
    asked = asked.groupBy("key").agg(F.min("request").alias("request"), F.max("cost").alias("cost"))
    missing = materialised(asked.join(read(spark, folder, at), "key", "left_anti"))
    if cap is not None and (total := missing.agg(F.sum("cost")).first()[0] or 0.0) > cap:
        raise ContractError(f"the missing responses cost {total}, over the cap of {cap}")
    if not missing.isEmpty():
        answered = materialised(respond(missing.select("key", "request")))
        if lost := missing.join(answered, "key", "left_anti").count():
            raise ContractError(f"{lost} requests have no response")
        at = put(answered, folder, at)
    held = read(spark, folder, at).select(F.col("key").alias(key), F.col("response").alias(out))
    return own.join(held, key, "left").drop(key, "__request"), at
