"""Corpus preparation: quality, near duplicates, benchmark decontamination, mixing, sharding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm import decontamination, jaccard, mixing, quality, sharding
from veriloom.session import checkpoint_dir, remove, table


def _held(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns that a stage looks at, and the others beside them, safe from names that the stage adds."""
    others = [F.col(c) for c in docs.columns if c not in columns] or [F.lit(True).alias("none")]
    return docs.select(*columns, F.struct(*others).alias("__row"))


def _back(rows: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """The columns of docs again, after `_held`."""
    return rows.select(*[F.col(c) if c in columns else F.col("__row").getField(c).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Null and empty texts are judged by their site alone; repeated rows
    share a fate; a null source or language is a site of its own; texts are judged whole, whatever their length; an empty
    table stays empty."""
    looked_at = ("doc_id", "source", "lang", "text")
    kept = quality.classify(_held(docs, *looked_at), table(spark, sf_dir, "labels")).where("keep")
    return _back(kept, docs, *looked_at)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles, similarity 0.8 or more, connect: that of the smallest
    id, null ids last. Texts that are null or have no words link with nothing and stay; of repeated rows one stays; texts
    are compared whole, whatever their length; an empty table stays empty."""
    return jaccard.keep_one(docs, k=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with the benchmark; null and empty texts share none, repeated rows
    share a fate; texts are searched whole, whatever their length; an empty table stays empty."""
    return decontamination.without_hits(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; copies are rows of their own. Null sources are one source; texts
    without words take none of the mix's words but can be taken; repeated rows count as rows of their own; a text of any
    length is taken whole or not; an empty table stays empty."""
    looked_at = ("doc_id", "source", "text")
    taken = mixing.mix_sources(_held(docs, *looked_at), keep=("text", "__row"))
    copies = taken.where("copies > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), "copies")))
    return _back(copies, docs, *looked_at)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard, by id alone (null ids share one, repeated rows theirs), whatever their texts; columns of
    the names that are added are replaced; an empty table stays empty."""
    added = ("size", "law", "shard", "grown_shard")
    return sharding.shard(docs).select(*[c for c in docs.columns if c not in added], *added)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The first stage fits a classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each written to the shared folder as Parquet and read again by the next. A stage's
    files go when the next one's are whole; the last one's stay, as the result reads them."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
