"""Queries of folds, pairs and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriloom.operators import pairs as P
from veriloom.operators import schedule
from veriloom.plans.cards import LABELLED, PAIRS, labelled, pairs
from veriloom.plans.query import query
from veriloom.session import table

_COLUMNS = ("label", "fold", "component_key")


def _resolved(spark, sf_dir):
    return P.resolve_endpoints(pairs(spark, sf_dir), labelled(spark, sf_dir), _COLUMNS)


@query("WITH " + LABELLED + " SELECT id, fold, CASE WHEN fold = 1 THEN 'query' WHEN fold IN (0, 2, 3) THEN 'train' ELSE 'unused' END AS role FROM labelled")
def fold_split(spark, sf_dir):
    return P.fold_split(labelled(spark, sf_dir), 1).select("id", "fold", "role")


@query("WITH " + PAIRS + " SELECT pair_id, positive_id, negative_id, positive_label, negative_label, positive_fold, negative_fold, positive_component_key, negative_component_key FROM resolved")
def resolve_pairs(spark, sf_dir):
    return _resolved(spark, sf_dir).select("pair_id", "positive_id", "negative_id", *[f"{s}_{c}" for c in _COLUMNS for s in ("positive", "negative")])


@query("WITH " + PAIRS + " SELECT pair_id, boundary_code FROM pairs WHERE list_contains(eligible_query_folds, 2)")
def eligible_pairs(spark, sf_dir):
    return P.for_query_fold(pairs(spark, sf_dir), 2).select("pair_id", "boundary_code")


@query("WITH " + PAIRS + " SELECT pair_id, list_filter([0, 1, 2, 3, 4], lambda x: x <> positive_fold AND x <> negative_fold) AS eligible FROM resolved")
def eligible_folds(spark, sf_dir):
    rows = _resolved(spark, sf_dir)
    return rows.select("pair_id", P.eligible_folds(range(5), F.col("positive_fold"), F.col("negative_fold")).alias("eligible"))


@query("WITH " + PAIRS + " SELECT count(*) AS n, count(DISTINCT positive_component_key) AS positives, count(DISTINCT negative_component_key) AS negatives, count(DISTINCT boundary_code) AS boundaries, count(DISTINCT mass_key) AS mass_keys, count(*) FILTER (list_contains(eligible_query_folds, 0)) AS for_fold_0 FROM resolved")
def pair_inventory(spark, sf_dir):
    d = F.count_distinct
    return _resolved(spark, sf_dir).agg(
        F.count("*").alias("n"), d("positive_component_key").alias("positives"), d("negative_component_key").alias("negatives"), d("boundary_code").alias("boundaries"),
        d("mass_key").alias("mass_keys"), F.count_if(F.array_contains("eligible_query_folds", 0)).alias("for_fold_0"),
    )


@query("WITH " + PAIRS + " SELECT pair_id, mass_key, query_fold FROM (SELECT *, row_number() OVER (PARTITION BY mass_key ORDER BY query_fold, pair_id) AS r FROM pairs) WHERE r = 1")
def dedup_first(spark, sf_dir):
    return P.first_of_mass(pairs(spark, sf_dir)).select("pair_id", "mass_key", "query_fold")


@query("WITH " + PAIRS + ", m AS (SELECT pair_id, least(1.0::DOUBLE / count(*) OVER (PARTITION BY positive_component_key), 1.0::DOUBLE / count(*) OVER (PARTITION BY negative_component_key)) AS raw FROM resolved) SELECT pair_id, round(raw / sum(raw) OVER (), 9) AS mass FROM m")
def reuse_mass(spark, sf_dir):
    return P.reuse_mass(_resolved(spark, sf_dir)).select("pair_id", F.round("normalized_pair_weight", 9).alias("mass"))


@query("WITH " + PAIRS + """, f AS (SELECT *, count(*) OVER (PARTITION BY pair_id) AS ni, count(*) OVER (PARTITION BY positive_component_key, negative_component_key) AS nr FROM resolved)
SELECT pair_id, list_filter([CASE WHEN positive_fold = 4 OR negative_fold = 4 THEN 'allowed_folds' END, CASE WHEN positive_component_key = negative_component_key THEN 'different_components' END,
  CASE WHEN ni > 1 THEN 'unique_id' END, CASE WHEN nr > 1 THEN 'unique_relation' END], lambda x: x IS NOT NULL) AS violations FROM f""")
def real_pair_contract(spark, sf_dir):
    return P.check_real_pairs(_resolved(spark, sf_dir)).select("pair_id", "violations")


@query("WITH " + PAIRS + """, f AS (SELECT *, count(*) OVER (PARTITION BY pair_id) AS ni, count(*) OVER (PARTITION BY query_fold, mass_key) AS nm,
  min(positive_id || '|' || negative_id) OVER (PARTITION BY mass_key) = max(positive_id || '|' || negative_id) OVER (PARTITION BY mass_key) AS one FROM resolved)
SELECT pair_id, list_filter([CASE WHEN positive_component_key = negative_component_key THEN 'different_components' END, CASE WHEN len(eligible_query_folds) <> 1 THEN 'eligible_is_query' END,
  CASE WHEN query_fold > 3 THEN 'known_query' END, CASE WHEN NOT one THEN 'one_relation_per_mass' END, CASE WHEN ni > 1 THEN 'unique_id' END, CASE WHEN nm > 1 THEN 'unique_mass_in_query' END], lambda x: x IS NOT NULL) AS violations FROM f""")
def query_pair_contract(spark, sf_dir):
    return P.check_query_pairs(_resolved(spark, sf_dir)).select("pair_id", "violations")


def _stable_sql(namespace: str, value: str = "blind_uid") -> str:
    from veriloom.plans.text_queries import _hmac_sql

    return _hmac_sql("42", f"({namespace} || chr(0) || {value})")


@query(
    "WITH " + LABELLED + ", c AS (SELECT count(*) AS n, sum(label) AS p, ((count(*) + 31) // 32) AS blocks FROM labelled), "
    "slots AS (SELECT i // 32 AS block, i % 32 AS k, CASE WHEN i // 32 = blocks - 1 THEN n - (blocks - 1) * 32 ELSE 32 END AS size FROM c, range((SELECT n FROM c)) r(i)), "
    "pos AS (SELECT block, rank FROM (SELECT block, row_number() OVER (ORDER BY k / size::DOUBLE, block) - 1 AS rank FROM slots) WHERE rank < (SELECT p FROM c)), "
    "free AS (SELECT block, count(*) - coalesce(any_value(t.n), 0) AS free FROM slots LEFT JOIN (SELECT block, count(*) AS n FROM pos GROUP BY 1) t USING (block) GROUP BY 1), "
    "neg AS (SELECT block, unnest(range(f - free, f)) AS rank FROM (SELECT block, free, (sum(free) OVER (ORDER BY block))::BIGINT AS f FROM free)), "
    f"r AS (SELECT id, blind_uid, label, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN label = 1 THEN {_stable_sql(chr(39) + 'positive-order' + chr(39))} ELSE {_stable_sql(chr(39) + 'negative-order' + chr(39))} END) - 1 AS rank FROM labelled), "
    "placed AS (SELECT r.id, r.blind_uid, b.block FROM r JOIN (SELECT 1 AS label, * FROM pos UNION ALL SELECT 0, * FROM neg) b USING (label, rank)) "
    f"SELECT id, block, row_number() OVER (ORDER BY block, {_stable_sql(chr(39) + 'block-' + chr(39) + ' || block::VARCHAR')}) - 1 AS position FROM placed"
)
def stratified_order(spark, sf_dir):
    return schedule.stratified_order(labelled(spark, sf_dir).select("id", "blind_uid", "label"), 32, "42").select("id", "block", "position")


@query(
    "WITH w AS (SELECT c_mktsegment AS segment, sum(c_acctbal) AS w FROM customer WHERE c_acctbal > 0 GROUP BY 1), e AS (SELECT segment, w / sum(w) OVER () * 1001 AS x FROM w), "
    "f AS (SELECT segment, floor(x)::BIGINT AS low, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, sha256(segment)) AS r FROM e) SELECT segment, low + (r <= 1001 - (SELECT sum(low) FROM f))::BIGINT AS draws FROM f"
)
def apportion(spark, sf_dir):
    weights = table(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.sum("c_acctbal").alias("w"))
    return schedule.apportion(weights, "w", 1001, "segment").select("segment", "draws")


@query("""
WITH t AS (SELECT o_orderpriority AS priority, year(o_orderdate)::INT AS year, ((count(*) + 31) // 32)::BIGINT AS steps FROM orders GROUP BY ALL),
c AS (SELECT *, unnest([0.25::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS fraction FROM t), s AS (SELECT *, greatest(1, round_even(steps * fraction, 0))::BIGINT AS step FROM c)
SELECT priority, year, steps, fraction, step, (count(DISTINCT step) OVER (PARTITION BY priority, year) < 3) AS collides FROM s""")
def checkpoint_plan(spark, sf_dir):
    """Checkpoints of runs over the orders of each priority and year, in batches of 32, and whether two fall on one step."""
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year")).agg(F.ceil(F.count("*") / 32).cast("long").alias("steps"))
    return runs.select("*", schedule.checkpoints(F.col("steps")).alias("c")).select("priority", "year", "steps", F.explode("c.at").alias("at"), "c.collides").select("priority", "year", "steps", "at.fraction", "at.step", "collides")


@query("""
WITH b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i FROM (SELECT DISTINCT p_brand FROM part)), t AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS j FROM (SELECT DISTINCT p_type FROM part)),
s AS (SELECT p_size, row_number() OVER (ORDER BY p_size) - 1 AS k FROM (SELECT DISTINCT p_size FROM part))
SELECT (i * (SELECT count(*) FROM t) + j) * (SELECT count(*) FROM s) + k AS note, p_brand AS brand, p_type AS type, p_size::INT AS size FROM b, t, s""")
def cross_product(spark, sf_dir):
    """Variant notes: every brand with every type and size that parts have, numbered."""
    from veriloom.operators.synthetic import variants

    parts = table(spark, sf_dir, "part")
    return variants(parts.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("int").alias("size")), "note")


@query("WITH r AS (SELECT p_partkey, p_brand, (p_size % 4 + 1)::BIGINT AS n, (sum(p_size % 4 + 1) OVER (ORDER BY p_partkey) - (p_size % 4 + 1))::BIGINT AS before FROM part), e AS (SELECT p_partkey, p_brand, before, unnest(range(0, n)) AS variant FROM r) SELECT before + variant AS task, p_brand AS brand, variant::INT AS variant_index FROM e")
def expand_registry(spark, sf_dir):
    """Each row as often as its count, with a running task number."""
    from veriloom.operators.ranking import running_total

    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") % 4 + 1).cast("long").alias("n"))
    summed = running_total(rows, "p_partkey", "n", "upto")
    out = summed.select("p_brand", (F.col("upto") - F.col("n")).alias("before"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("variant"))
    return out.select((F.col("before") + F.col("variant")).alias("task"), F.col("p_brand").alias("brand"), F.col("variant").cast("int").alias("variant_index"))
