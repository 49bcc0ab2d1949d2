"""The queries of this subpackage over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm import collocations, decontamination, html_text, jaccard, licenses, manifest, mixing, quality, records, sharding, suffix_dedup, topk, warc
from veriloom.session import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = rows.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "law", "shard", "grown_shard")
    return sharding.with_slots(rows, ties=("text_crc32", "size")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.classify(documents, labels, columns=("doc_id", "source", "lang"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = records.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return records.digests(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of the rows as they were, held against rows of which a seventh has its n_chars raised by one."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    rows, root = manifest.manifest(table(spark, sf_dir, "documents"), fields, present=tuple(tampered if f == "n_chars" else F.col(f) for f in fields))
    folded = manifest.fold(F.col("present"), F.col("path"))
    rows = rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", F.lit(root).alias("root"), F.sha2(manifest.siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_suffix_dedup, op2_sharding, op3_mixing, op4_topk, op5_licenses, op6_decontamination, op7_html_text, op8_warc, op9_quality, op10_jaccard,
        op11_collocations, op12_records, op13_manifest, pipeline,
    )
    return {f.__name__: f for f in found}


_TOPK_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

_BASE32_SQL = "".join(
    f"|| substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(h, {1 + 10 * (i // 8)}, 10))::BIGINT >> {35 - 5 * (i % 8)}) & 31 AS INT), 1) "
    for i in range(32)
)
_WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, '' {_BASE32_SQL} AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to FROM m"""


def _jaccard_sql(k: int = 4, num: int = 85, den: int = 100) -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < {k} THEN [array_to_string(t, ' ')]
      ELSE list_distinct([array_to_string(t[i:i+{k - 1}], ' ') FOR i IN range(1, len(t) - {k} + 2)]) END AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * c >= {num} * (x.n_shingles + y.n_shingles - c)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT n.doc_id, n.n_shingles, c.component_id FROM n JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)"""


_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CONTAMINATION_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM benchmark),
w AS (SELECT DISTINCT item, least(10, len(t)) AS size, unnest([array_to_string(t[i:i + least(10, len(t)) - 1], ' ') FOR i IN range(1, len(t) - least(10, len(t)) + 2)]) AS x FROM b WHERE len(t) > 0),
sizes AS (SELECT DISTINCT size FROM w),
p AS (SELECT doc_id, size, unnest(range(1, len(t) - size + 2)) AS i, unnest([array_to_string(t[i:i + size - 1], ' ') FOR i IN range(1, len(t) - size + 2)]) AS x FROM d, sizes WHERE len(t) >= size),
h AS (SELECT doc_id, i, size, item FROM p JOIN w USING (size, x)),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, len(t)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_sharding": sharding.shard_sql(), "op3_mixing": mixing.mixing_sql(), "op4_topk": _TOPK_SQL, "op5_licenses": licenses.scan_sql(), "op6_decontamination": _CONTAMINATION_SQL,
        "op8_warc": _WARC_SQL, "op10_jaccard": _jaccard_sql(), "op11_collocations": collocations.collocations_sql(), "op13_manifest": manifest.manifest_sql(),
    }
