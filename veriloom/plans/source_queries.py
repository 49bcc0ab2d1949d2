"""Queries over sources and sinks: what is written from the tables and read back must be the tables' own rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.plans.query import query
from veriloom.session import checkpoint_dir, table
from veriloom.sources import delimited, store
from veriloom.streaming import durable
from veriloom.streaming.events import event_stream


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of text that one task writes to a file, or reads as a range of one.
FILE_BYTES, RANGE_BYTES = 64 << 20, 32 << 20


def _n_files(total: int) -> int:
    """Files for so many bytes of text: more of them for more text, so that no task's share grows with the table."""
    return max(3, -(-total // FILE_BYTES))


def _range_bytes(total: int) -> int:
    """Bytes of a range: a sixteenth of small tables, so that they are cut too, and no more than RANGE_BYTES."""
    return min(RANGE_BYTES, max(4096, total // 16))


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.select("ordinal", F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("text_sha256"))


_ORDERED = """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, doc_id, lang, source, length(text) AS chars, sha256(text) AS text_sha256 FROM documents"""


@query(_ORDERED)
def split_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as quoted CSV files, three at least and of about FILE_BYTES of text at most, read by ranges of bytes."""
    docs, folder = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), _folder(spark, "csv")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    delimited.write_csv(docs, folder, _n_files(total), "doc_id")
    return _hashed(delimited.read_csv(spark, folder, split_bytes=_range_bytes(total)))


@query(_ORDERED)
def ordered_csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one CSV file in the order of their ids, joined from many tasks' files, and read by ranges."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    path = delimited.write_ordered_csv(docs.withColumn("ordinal", F.col("doc_id")), f"{_folder(spark, 'ordered')}/documents.csv")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return _hashed(delimited.read_csv(spark, path, split_bytes=_range_bytes(total)))


class _Once:
    """Fails the first time that a batch comes to it."""

    def __init__(self, batch: int) -> None:
        self.batch = batch

    def __call__(self, batch: int) -> None:
        if batch == self.batch:
            self.batch = -1
            raise RuntimeError("lost after the batch was written")


@query("""
SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids, round(sum(value), 2) AS total, 4::BIGINT AS n_batches, (SELECT count(*) FROM events) AS n_logged FROM events GROUP BY event_type""")
def durable_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed in four batches into a table, where a batch is lost between its writing and its commit, tried again,
    and once more when it is there."""
    events, folder = table(spark, sf_dir, "events"), _folder(spark, "append")
    events.repartition(4, "event_id").write.parquet(f"{folder}/source/events.parquet")
    schema, fails = events.schema, _Once(1)
    stream = event_stream(spark, f"{folder}/source/events.parquet", schema, pattern="*.parquet")
    for _ in range(2):
        running = durable.append_stream(stream, f"{folder}/table", "events", f"{folder}/state", fails)
        try:
            running.awaitTermination()
        except Exception as e:
            if "lost after the batch" not in str(e):
                raise
    rows = durable.read_appended(spark, f"{folder}/table", schema)
    durable.append_batch(rows.where("batch = 2").drop("query", "batch"), 2, f"{folder}/table", "events")
    log = durable.commits(spark, f"{folder}/table").agg(F.count("*").alias("n_batches"), F.sum("n_rows").alias("n_logged"))
    out = durable.read_appended(spark, f"{folder}/table", schema).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.round(F.sum("value"), 2).alias("total"))
    n_batches, n_logged = log.first()
    return out.select("*", F.lit(n_batches).alias("n_batches"), F.lit(n_logged).alias("n_logged"))


@query(r"""
WITH r AS (SELECT conv_id, turn, role, sha256(role || chr(0) || coalesce(text, '')) AS key FROM conversations)
SELECT conv_id, turn, key, CASE WHEN key IN (SELECT key FROM r WHERE role = 'user') THEN '1|' ELSE '2|' END || substr(key, 1, 16) AS response,
  (SELECT count(DISTINCT key) FROM r) AS n_stored FROM r""")
def response_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of requests, users' turns and then all turns: the second finds the first's responses in the store. A response
    names the call that computed it and the request's hash; no model is asked."""
    turns, folder = table(spark, sf_dir, "conversations"), _folder(spark, "store")
    request = F.concat("role", F.lit("\0"), F.coalesce("text", F.lit("")))
    respond = lambda call: lambda asked: asked.select("key", F.concat(F.lit(f"{call}|"), F.substring("key", 1, 16)).alias("response"))
    store.complete(turns.where("role = 'user'"), folder, request, respond(1))
    answered, at = store.complete(turns, folder, request, respond(2))
    stored = store.read(spark, folder, at).count()
    return answered.select("conv_id", "turn", store.request_key(request).alias("key"), "response", F.lit(stored).alias("n_stored"))
