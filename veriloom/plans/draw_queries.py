"""Queries of draws that are expressions of their number, and of canonical JSON over nested rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions.hashing import canonical_row
from veriloom.operators import draws
from veriloom.plans.query import query
from veriloom.plans.text_queries import _hmac_sql
from veriloom.session import table


def _permuted_sql(name: str, source: str) -> str:
    """CTEs that give (id, v), `name`_done: the permutation of `source` (id, i, n, name), by recursion."""
    moved = lambda k, digit: "('0x' || substr(" + _hmac_sql("42", f"(name || chr(0) || '{k}' || chr(0) || {digit}::VARCHAR)") + ", 1, 12))::BIGINT"
    rounds = f"SELECT *, v // b AS l, v % b AS r FROM {name} WHERE NOT done"
    for k in range(draws.ROUNDS):
        change = f"(r + {moved(k, 'l')}) % b AS r" if k % 2 else f"(l + {moved(k, 'r')}) % a AS l"
        rounds = f"SELECT * REPLACE ({change}) FROM ({rounds})"
    bases = f"SELECT id, i, n, name, ceil(sqrt(n::DOUBLE))::BIGINT AS a FROM {source}"
    return f"""{name}(id, n, name, a, b, v, done) AS (SELECT id, n, name, a, (n + a - 1) // a, i, false FROM ({bases})
  UNION ALL SELECT id, n, name, a, b, l * b + r, l * b + r < n FROM ({rounds})),
{name}_done AS (SELECT id, v FROM {name} WHERE done)"""


@query(f"""
WITH RECURSIVE m AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS at FROM documents WHERE source IS NOT NULL),
s AS (SELECT source, count(*) AS size, row_number() OVER (ORDER BY source) - 1 AS number FROM m GROUP BY source),
d AS (SELECT j AS id, j // n AS cycle, j % n AS i, n, 'cycle' || chr(0) || (j // n) AS name FROM (SELECT count(*) AS n FROM s), range((SELECT count(*) FROM documents)) r(j)),
{_permuted_sql("p", "d")},
e AS (SELECT d.id, source, cycle % size AS i, size AS n, 'deck' || chr(0) || source || chr(0) || (cycle // size) AS name FROM d JOIN p_done USING (id) JOIN s ON s.number = p_done.v),
{_permuted_sql("q", "e")}
SELECT e.id AS draw, m.source, m.doc_id FROM e JOIN q_done USING (id) JOIN m ON m.source = e.source AND m.at = q_done.v""")
def group_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many draws as there are documents, the sources taking turns."""
    documents = table(spark, sf_dir, "documents")
    return draws.group_draws(documents, "source", "doc_id", documents.count(), "42")


@query(f"""
WITH RECURSIVE w AS (SELECT p_partkey, p_size::DOUBLE AS w, (SELECT count(*) FROM orders) AS needed FROM part), x AS (SELECT p_partkey, needed, w / (SELECT sum(w) FROM w) * needed AS x FROM w),
f AS (SELECT p_partkey, needed, floor(x)::BIGINT AS low, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, sha256(p_partkey::VARCHAR)) AS r FROM x),
c AS (SELECT p_partkey, needed, low + (r <= needed - (SELECT sum(low) FROM f))::BIGINT AS draws FROM f),
l AS (SELECT p_partkey, needed, draws, (sum(draws) OVER (ORDER BY p_partkey))::BIGINT - draws AS before FROM c),
d AS (SELECT unnest(range(before, before + draws)) AS id, p_partkey, needed AS n, 'order' AS name FROM l), i AS (SELECT id, id AS i, n, name FROM d),
{_permuted_sql("p", "i")}
SELECT v AS draw, p_partkey FROM d JOIN p_done USING (id)""")
def weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many draws of parts as there are orders, by size."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("w"))
    return draws.weighted_draws(parts, "p_partkey", "w", table(spark, sf_dir, "orders").count(), "42")


@query("""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
j AS (SELECT vec_id, '{"id":' || vec_id || ',"meta":{"first":' || v[1]::VARCHAR || ',"label":' || coalesce(to_json(label)::VARCHAR, 'null') || ',"none":null},"vector":[' || array_to_string(list_transform(v, lambda x: x::VARCHAR), ',') || ']}' AS j FROM e)
SELECT vec_id, length(j) AS chars, sha256(j) AS sha256 FROM j""")
def canonical_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of nested rows with lists of numbers."""
    rows = table(spark, sf_dir, "embeddings").withColumn("vector", F.col("embedding").cast("array<double>"))
    meta = F.struct("label", F.lit(None).cast("string").alias("none"), F.get("vector", F.lit(0)).alias("first"))
    nested = rows.select("vec_id", meta.alias("meta"), F.col("vec_id").alias("id"), "vector")
    out = nested.withColumn("j", canonical_row(nested, "meta", "id", "vector"))
    return out.select("vec_id", F.length("j").cast("long").alias("chars"), F.sha2("j", 256).alias("sha256"))
