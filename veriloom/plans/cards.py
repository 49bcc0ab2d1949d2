"""Adapter: cards, labels, folds and stand-in scores from the tables of a folder. An extension, as those tables have none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions.hashing import fold_of, mock_margin
from veriloom.functions.text import surface_key
from veriloom.operators.features import BASES, TRAJECTORY
from veriloom.operators.ranking import position_within
from veriloom.session import table


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One card a document: name is the first line, description the rest; exact copies share a component."""
    name = F.substring_index("text", "\n", 1)
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        name.alias("name"),
        F.substr("text", F.length(name) + 2).alias("description"),
        F.col("lang").alias("category"),
        F.col("source").alias("stratum"),
        (F.col("doc_id") % 7).cast("int").alias("image_count"),
        F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16).alias("blind_uid"),
    )
    rows = rows.withColumn("component_key", F.substring(F.sha2(surface_key("name", "description"), 256), 1, 16))
    return rows.withColumn("fold", fold_of(F.col("component_key")))


#: The same in SQL; queries go on after it.
CARDS = r"""
base AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS name, substr(text, length(split_part(text, chr(10), 1)) + 2) AS description,
  lang AS category, source AS stratum, (doc_id % 7)::INT AS image_count, substr(sha256(doc_id::VARCHAR), 1, 16) AS blind_uid FROM documents),
keyed AS (SELECT *, substr(sha256(trim(regexp_replace(lower(name || chr(10) || description), '\s+', ' ', 'g'))), 1, 16) AS component_key FROM base),
cards AS (SELECT *, (('0x' || substr(sha256(component_key), 1, 12))::BIGINT % 5)::INT AS fold FROM keyed)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with label (quality) and toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"), F.col("toxic").cast("int").alias("toxic"))
    return cards(spark, sf_dir).join(labels, "id")


LABELLED = CARDS + """,
labelled AS (SELECT c.*, l.quality::INT AS label, l.toxic::INT AS toxic FROM cards c JOIN labels l ON l.doc_id = c.id)"""


def score(base: str) -> Column:
    """A stand-in score that leans toward the label; never a model's."""
    return mock_margin(base, F.col("id")) + F.lit(0.6) * (2 * F.col("label") - 1)


def score_sql(base: str) -> str:
    return f"(((('0x' || substr(sha256('{base}' || chr(0) || id::VARCHAR), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551615.0::DOUBLE) * 2 - 1 + 0.6::DOUBLE * (2 * label - 1))"


def signals(rows: DataFrame, arm: str, bases: tuple[str, ...] = BASES) -> DataFrame:
    """(id, {base}_score, {base}_prediction)."""
    out = {f"{b}_score": score(f"{arm}:{b}") for b in bases}
    wide = rows.select("id", *[c.alias(n) for n, c in out.items()])
    return wide.withColumns({f"{b}_prediction": (F.col(f"{b}_score") > 0).cast("int") for b in bases})


def signals_sql(arm: str, bases: tuple[str, ...] = BASES, prefix: str = "") -> str:
    scores = ", ".join(f"{score_sql(f'{arm}:{b}')} AS {prefix}{b}_score" for b in bases)
    votes = ", ".join(f"({prefix}{b}_score > 0)::INT AS {prefix}{b}_prediction" for b in bases)
    return f"SELECT *, {votes} FROM (SELECT id, {scores} FROM labelled)"


def out_of_fold(rows: DataFrame, arms: tuple[str, ...] = ("control", "candidate"), tags: tuple[str, ...] = TRAJECTORY) -> DataFrame:
    """Long scores: arm, tag, fold, id, label, score, prediction."""
    options = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(t).alias("tag"), score(f"{a}:{t}").alias("score")) for a in arms for t in tags])
    long_ = rows.select("id", "fold", "label", F.explode(options).alias("o"))
    return long_.select("o.arm", "o.tag", "fold", "id", "label", "o.score", (F.col("o.score") > 0).cast("int").alias("prediction"))


OOF = ",\noof AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS arm, '{t}' AS tag, fold, id, label, {score_sql(f'{a}:{t}')} AS score, ({score_sql(f'{a}:{t}')} > 0)::INT AS prediction FROM labelled"
    for a in ("control", "candidate")
    for t in TRAJECTORY
) + ")"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast pairs of one fold: the i-th positive of a fold, by blind uid, with its i-th negative and that after."""
    rows = labelled(spark, sf_dir).select("id", "fold", "label", "blind_uid")
    ranked = position_within(rows, ["fold", "label"], ["blind_uid", "id"], "i").withColumn("i", F.col("i") + 1)
    p = ranked.where("label = 1").select(F.col("id").alias("positive_id"), "fold", "i", F.col("blind_uid").alias("pu"))
    n = ranked.where("label = 0").select(F.col("id").alias("negative_id"), "fold", F.explode(F.array(F.col("i"), F.col("i") + 1)).alias("i"), F.col("blind_uid").alias("nu"))
    both = p.join(n, ["fold", "i"])
    folds = F.array_except(F.array(*[F.lit(f) for f in range(5)]), F.array("fold"))
    return both.select(
        F.substring(F.sha2(F.concat("pu", F.lit("|"), "nu"), 256), 1, 12).alias("pair_id"), "positive_id", "negative_id",
        F.concat(F.lit("b"), (F.col("i") % 4).cast("string")).alias("boundary_code"), F.lit("ACCEPT").alias("review_status"),
        F.array_sort(folds).alias("eligible_query_folds"), F.col("fold").alias("query_fold"), F.substring("pu", 1, 2).alias("mass_key"),
    )


PAIRS = LABELLED + """,
ranked AS (SELECT id, fold, label, blind_uid, row_number() OVER (PARTITION BY fold, label ORDER BY blind_uid) AS i FROM labelled),
negatives AS (SELECT id AS negative_id, fold, unnest([i, i + 1]) AS i, blind_uid AS nu FROM ranked WHERE label = 0),
pairs AS (SELECT substr(sha256(p.blind_uid || '|' || n.nu), 1, 12) AS pair_id, p.id AS positive_id, n.negative_id, 'b' || (p.i % 4)::VARCHAR AS boundary_code,
  'ACCEPT' AS review_status, list_filter([0, 1, 2, 3, 4], lambda x: x <> p.fold) AS eligible_query_folds, p.fold AS query_fold, substr(p.blind_uid, 1, 2) AS mass_key
  FROM ranked p JOIN negatives n ON p.fold = n.fold AND p.i = n.i AND p.label = 1),
resolved AS (SELECT x.*, p.label AS positive_label, p.fold AS positive_fold, p.component_key AS positive_component_key,
  n.label AS negative_label, n.fold AS negative_fold, n.component_key AS negative_component_key
  FROM pairs x LEFT JOIN labelled p ON p.id = x.positive_id LEFT JOIN labelled n ON n.id = x.negative_id)"""
