"""Queries of scans, joins, aggregations, set operations and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veriloom.operators.contracts import join_one_to_one, roster_difference
from veriloom.operators.ranking import batch_id, position_within
from veriloom.plans.cards import CARDS, LABELLED, cards, labelled
from veriloom.plans.query import query
from veriloom.session import table
from veriloom.sources.readers import read_projected


@query("SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS id_key, lang AS category, n_chars FROM documents WHERE n_chars >= 500")
def scan_project(spark, sf_dir):
    rows = read_projected(spark, f"{sf_dir}/documents.parquet", ("doc_id", "lang", "n_chars"), "(?i)^(private|hidden)_")
    return rows.where("n_chars >= 500").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("id_key"), F.col("lang").alias("category"), "n_chars")


@query("SELECT c_mktsegment AS segment, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS overdrawn, round(avg(c_acctbal), 6) AS mean_balance FROM customer GROUP BY 1")
def segment_profile(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("overdrawn"), F.round(F.avg("c_acctbal"), 6).alias("mean_balance")
    )


@query("WITH " + LABELLED + " SELECT count(*) AS n_rows, sum(label)::BIGINT AS positives, list_sort(list(DISTINCT fold)) AS folds, count(DISTINCT component_key) AS components FROM labelled")
def inventory(spark, sf_dir):
    return labelled(spark, sf_dir).agg(
        F.count("*").alias("n_rows"), F.sum("label").alias("positives"), F.sort_array(F.collect_set("fold")).alias("folds"), F.count_distinct("component_key").alias("components")
    )


@query("WITH c AS (SELECT source AS stratum, count(*) AS n FROM documents GROUP BY 1) SELECT stratum, n, max(n) OVER () AS most, min(n) OVER () AS least FROM c")
def stratum_counts(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("stratum")).agg(F.count("*").alias("n"))
    return counts.join(counts.agg(F.max("n").alias("most"), F.min("n").alias("least")))


@query("WITH " + CARDS + " SELECT id, component_key, count(*) OVER (PARTITION BY component_key) AS component_size FROM cards")
def component_size(spark, sf_dir):
    rows = cards(spark, sf_dir).select("id", "component_key")
    return rows.join(rows.groupBy("component_key").agg(F.count("*").alias("component_size")), "component_key").select("id", "component_key", "component_size")


@query("WITH " + CARDS + " SELECT component_key, count(DISTINCT id % 5) AS folds FROM cards GROUP BY 1 HAVING count(DISTINCT id % 5) > 1")
def component_fold_leak(spark, sf_dir):
    """Components that a fold by id, instead of by component, would split."""
    return cards(spark, sf_dir).groupBy("component_key").agg(F.count_distinct(F.col("id") % 5).alias("folds")).where("folds > 1")


@query("WITH " + CARDS + " SELECT category, count(*) AS n, count(*) - count(DISTINCT component_key) AS duplicates FROM cards GROUP BY 1")
def dup_count(spark, sf_dir):
    return cards(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("component_key")).alias("duplicates"))


@query("WITH " + CARDS + " SELECT c.id, c.category, l.quality, l.toxic FROM cards c JOIN labels l ON c.id = l.doc_id")
def one_to_one_join(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    rows = cards(spark, sf_dir).select("id", "category").join(labels.select("id"), "id", "left_semi")
    return join_one_to_one(rows, labels, "id")


@query("SELECT c_custkey, n_name, r_name, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3")
def star_join(spark, sf_dir):
    """Orders are summed by customer before the join, so the fact table is shuffled once, as partial sums."""
    spent = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("orders"), F.sum("o_totalprice").alias("spent"))
    who = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    who = who.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = who.join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "n_name", "r_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n")
    )


@query("SELECT doc_id AS id, 'left' AS missing_in FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en') UNION ALL SELECT doc_id, 'right' FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def roster_reconcile(spark, sf_dir):
    """Keys that only one of two rosters has: English documents against labelled ones."""
    documents = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"))
    return roster_difference(documents, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id")


@query("(SELECT o_custkey AS id FROM orders EXCEPT ALL SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def multiset_difference(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).exceptAll(table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("WITH " + CARDS + " SELECT 'stratum' AS split, component_key FROM (SELECT component_key FROM cards WHERE stratum = 'src0' INTERSECT SELECT component_key FROM cards WHERE stratum <> 'src0') UNION ALL SELECT 'fold', component_key FROM (SELECT component_key FROM cards WHERE fold = 0 INTERSECT SELECT component_key FROM cards WHERE fold <> 0)")
def component_intersection(spark, sf_dir):
    """Components on both sides of a split: copies cross strata, but must not cross folds."""
    rows = cards(spark, sf_dir).select("component_key", "stratum", "fold")
    both = lambda side: rows.where(side).select("component_key").intersect(rows.where(~side).select("component_key"))
    crossing = both(F.col("stratum") == "src0").select(F.lit("stratum").alias("split"), "component_key")
    return crossing.union(both(F.col("fold") == 0).select(F.lit("fold").alias("split"), "component_key"))


@query("SELECT doc_id AS id, lang AS category, CASE WHEN lang IN ('en', 'de') THEN 'a' ELSE 'b' END AS branch, CASE WHEN lang IN ('en', 'de') THEN n_chars ELSE -n_chars END AS score, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS category_position FROM documents")
def route_category(spark, sf_dir):
    """Two branches with their own scores, brought together again; each row numbered within its category."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), "n_chars")
    first = F.col("category").isin("en", "de")
    a = rows.where(first).select("id", "category", F.lit("a").alias("branch"), F.col("n_chars").alias("score"))
    b = rows.where(~first).select("id", "category", F.lit("b").alias("branch"), (-F.col("n_chars")).alias("score"))
    return position_within(a.unionByName(b), ["category"], ["id"], "category_position")


@query("SELECT conv_id, turn, CAST(floor((row_number() OVER (ORDER BY conv_id, turn) - 1) / 64) AS BIGINT) AS batch FROM conversations")
def batch_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn").withColumn("all", F.lit(0))
    return position_within(rows, ["all"], ["conv_id", "turn"], "at").select("conv_id", "turn", batch_id("at", 64).alias("batch"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id_key, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS place FROM documents")
def string_order(spark, sf_dir):
    """Order by the id as text: "10" before "2"."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id_key")).withColumn("all", F.lit(0))
    return position_within(rows, ["all"], ["id_key"], "place").drop("all")


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def top_per_group(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").withColumn("r", F.row_number().over(w)).where("r <= 3").select("p_brand", "p_partkey", "p_retailprice")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value FROM events GROUP BY 1")
def event_profile(spark, sf_dir):
    """Counts, users and values by type of event; the median comes from counted values."""
    from veriloom.operators.ranking import medians

    events = table(spark, sf_dir, "events")
    rows = events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean_value"))
    middle = medians(events, ["event_type"], "value", "median_value").select(F.col("event_type").alias("of"), F.round("median_value", 6).alias("median_value"))
    return rows.join(middle, F.col("event_type").eqNullSafe(F.col("of")), "left").drop("of")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    from veriloom.streaming.events import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events")).withColumn("start", F.to_timestamp_ntz(F.date_format("start", "yyyy-MM-dd HH:mm:ss")))


@query("SELECT doc_id AS id, coalesce(l.quality, 1 - doc_id % 2)::INT AS label FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) LEFT JOIN labels l USING (doc_id)")
def overlay_labels(spark, sf_dir):
    """Default labels for all documents, replaced by the recorded ones where there are any."""
    from veriloom.operators.contracts import overlay

    default = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (1 - F.col("doc_id") % 2).cast("int").alias("label"))
    return overlay(default, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label")), "id")
