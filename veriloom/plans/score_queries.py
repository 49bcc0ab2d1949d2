"""Queries of rank features, labels by quota, weights, metrics and the feature matrix, over stand-in scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriloom.functions import hashing
from veriloom.operators import features, metrics, ranking
from veriloom.operators.pairs import component_class_weights
from veriloom.plans.cards import LABELLED, OOF, labelled, out_of_fold, signals, signals_sql
from veriloom.plans.query import query
from veriloom.session import table

_TRAJ = features.TRAJECTORY


def _rank_sql(x: str, part: str = "fold") -> str:
    return f"((rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY {part}))"


def _z_sql(x: str, part: str = "fold") -> str:
    return f"(({x} - avg({x}) OVER (PARTITION BY {part})) / coalesce(nullif(stddev_samp({x}) OVER (PARTITION BY {part}), 0), 1))"


@query(f"SELECT p_partkey, round({_rank_sql('p_retailprice', 'p_brand')}, 9) AS pct, round({_z_sql('p_retailprice', 'p_brand')}, 6) AS z FROM part")
def pct_rank_fold(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    ranks = ranking.pct_ranks(rows, "p_partkey", ["p_brand"], {"pct": "p_retailprice"})
    return ranking.zscores(rows, ["p_brand"], {"z": "p_retailprice"}).join(ranks, "p_partkey").select("p_partkey", F.round("pct", 9).alias("pct"), F.round("z", 6).alias("z"))


@query("SELECT o_orderkey, round((rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::DOUBLE) / count(*) OVER (), 9) AS pct FROM orders")
def pct_rank_roster(spark, sf_dir):
    """Over the whole table: distinct prices are ranged and summed, no task sorts all orders."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ranking.pct_rank_whole(rows, "o_totalprice", "p").select("o_orderkey", F.round("p", 9).alias("pct"))


@query(f"SELECT o_orderkey, round({_z_sql('o_totalprice', 'o_orderpriority')}, 6) AS z FROM orders")
def zscore_fold(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ranking.zscores(rows, ["o_orderpriority"], {"z": "o_totalprice"}).select("o_orderkey", F.round("z", 6).alias("z"))


@query("SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders), 6) AS z FROM orders")
def zscore_roster(spark, sf_dir):
    return ranking.zscore_whole(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "z").select("o_orderkey", F.round("z", 6).alias("z"))


_SIG = "WITH " + LABELLED + f", s AS ({signals_sql('control')}), j AS (SELECT l.*, s.* EXCLUDE (id) FROM labelled l JOIN s USING (id))"


@query(_SIG + ", k AS (SELECT CAST(floor(count(*) * (SELECT avg(label) FROM labelled WHERE fold < 4) + 0.5) AS BIGINT) AS k FROM j) SELECT id, (row_number() OVER (ORDER BY b1_score DESC, sha256(blind_uid)) <= (SELECT k FROM k))::INT AS chosen FROM j")
def prevalence_rank(spark, sf_dir):
    """The share of positives is the training folds'; ties go by the hash of the blind id."""
    rows = labelled(spark, sf_dir)
    share, n = rows.agg(F.avg(F.when(F.col("fold") < 4, F.col("label"))), F.count("*")).first()
    scored = rows.join(signals(rows, "control"), "id").withColumn("tie", F.sha2("blind_uid", 256))
    return ranking.label_top(scored, ranking.prevalence(n, share or 0.0), "b1_score", "tie", "chosen").select("id", "chosen")


@query("WITH n AS (SELECT count(*) AS n FROM orders) SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= (SELECT least(n, (2 * n * 198 + 5502) // 11004) FROM n))::INT AS chosen FROM orders")
def quota_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ranking.label_top(rows, ranking.quota(rows.count()), "o_totalprice", "o_orderkey", "chosen").select("o_orderkey", "chosen")


_FIVE = [f"{b}_score" for b in features.BASES]


@query(_SIG + f" SELECT id, round(list_avg([{', '.join(_FIVE)}]), 9) AS s_mean, round(list_stddev_samp([{', '.join(_FIVE)}]), 9) AS s_std, round(least({', '.join(_FIVE)}), 9) AS s_min, round(greatest({', '.join(_FIVE)}), 9) AS s_max FROM j")
def row_stats(spark, sf_dir):
    wide = signals(labelled(spark, sf_dir), "control")
    return wide.select("id", *[F.round(c, 9).alias(n) for n, c in metrics.row_stats([F.col(c) for c in _FIVE], "s").items()])


@query("WITH " + LABELLED + ", c AS (SELECT label, component_key, count(*) AS n FROM labelled GROUP BY 1, 2), k AS (SELECT label, count(*) AS comps FROM c GROUP BY 1) SELECT id, round(0.5 * (SELECT count(*) FROM labelled) / (comps * n)::DOUBLE, 9) AS weight FROM labelled JOIN c USING (label, component_key) JOIN k USING (label)")
def class_component_weights(spark, sf_dir):
    return component_class_weights(labelled(spark, sf_dir)).select("id", F.round("weight", 9).alias("weight"))


@query(_SIG + " SELECT fold, count(*) AS n, sum(label)::BIGINT AS positives, sum(char_prediction)::BIGINT AS predicted FROM j GROUP BY 1")
def per_fold_report(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return rows.join(signals(rows, "control"), "id").groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.sum("char_prediction").alias("predicted"))


_CONFUSION = "count(*) FILTER (label = 0 AND {p} = 0) AS tn, count(*) FILTER (label = 0 AND {p} = 1) AS fp, count(*) FILTER (label = 1 AND {p} = 0) AS fn, count(*) FILTER (label = 1 AND {p} = 1) AS tp"


@query("WITH " + LABELLED + OOF + f" SELECT arm, tag, tn, fp, fn, tp, round(coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0)::DOUBLE, 9) AS f1 FROM (SELECT arm, tag, {_CONFUSION.format(p='prediction')} FROM oof GROUP BY 1, 2)")
def binary_metrics(spark, sf_dir):
    scores = out_of_fold(labelled(spark, sf_dir))
    return metrics.binary_metrics(scores, "label", "prediction", ["arm", "tag"]).withColumn("f1", F.round("f1", 9))


_AP = "SELECT arm, tag, round(coalesce(sum(tp * ctp / cn::DOUBLE) / nullif(sum(tp), 0), 0), 9) AS ap FROM (SELECT arm, tag, s, tp, sum(n) OVER w AS cn, sum(tp) OVER w AS ctp FROM (SELECT arm, tag, round(score, 1) AS s, count(*) AS n, sum(label) AS tp FROM oof GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY arm, tag ORDER BY s DESC)) GROUP BY 1, 2"


@query("WITH " + LABELLED + OOF + " " + _AP)
def average_precision(spark, sf_dir):
    """Scores are rounded to one digit first, so that ties matter."""
    scores = out_of_fold(labelled(spark, sf_dir)).withColumn("score", F.round("score", 1))
    return metrics.average_precision(scores, "label", "score", ["arm", "tag"]).withColumn("ap", F.round("ap", 9))


_ARMS = "WITH " + LABELLED + OOF + """, w AS (SELECT id, label, max(prediction) FILTER (arm = 'control') AS c, max(prediction) FILTER (arm = 'candidate') AS d, max(score) FILTER (arm = 'control') AS cs, max(score) FILTER (arm = 'candidate') AS ds
FROM oof WHERE tag = 'lora100' GROUP BY 1, 2)"""


def _arms(spark, sf_dir):
    scores = out_of_fold(labelled(spark, sf_dir), tags=("lora100",))
    of = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    return scores.groupBy("id", "label").agg(of("control", "prediction").alias("c"), of("candidate", "prediction").alias("d"), of("control", "score").alias("cs"), of("candidate", "score").alias("ds"))


@query(_ARMS + " SELECT count(*) FILTER (d = label AND c <> label) AS rescues, count(*) FILTER (c = label AND d <> label) AS harms FROM w")
def rescues_harms(spark, sf_dir):
    return metrics.rescues_harms(_arms(spark, sf_dir), "label", "c", "d")


def _ap_sql(x: str) -> str:
    return f"(SELECT coalesce(sum(tp * ctp / cn::DOUBLE) / nullif(sum(tp), 0), 0) FROM (SELECT tp, sum(n) OVER (ORDER BY s DESC) AS cn, sum(tp) OVER (ORDER BY s DESC) AS ctp FROM (SELECT {x} AS s, count(*) AS n, sum(label) AS tp FROM w GROUP BY 1)))"


def _f1_sql(x: str) -> str:
    return f"(SELECT coalesce(2.0 * count(*) FILTER (label = 1 AND {x} = 1) / nullif(2.0 * count(*) FILTER (label = 1 AND {x} = 1) + count(*) FILTER (label <> {x}), 0), 0)::DOUBLE FROM w)"


@query(
    _ARMS + f", g AS (SELECT {_f1_sql('c')} AS f1_control, {_f1_sql('d')} AS f1_candidate, {_ap_sql('cs')} AS ap_control, {_ap_sql('ds')} AS ap_candidate, count(*) FILTER (d = label AND c <> label) AS rescues, count(*) FILTER (c = label AND d <> label) AS harms FROM w) "
    "SELECT round(f1_control, 9) AS f1_control, round(f1_candidate, 9) AS f1_candidate, round(ap_control, 9) AS ap_control, round(ap_candidate, 9) AS ap_candidate, rescues, harms, round(f1_candidate - f1_control, 9) AS delta_f1, round(ap_candidate - ap_control, 9) AS delta_ap, "
    "CASE WHEN f1_candidate - f1_control > 0 AND rescues > harms AND ap_candidate - ap_control >= -0.01 THEN 'GO' ELSE 'STOP' END AS verdict FROM g"
)
def promotion_gate(spark, sf_dir):
    gate = metrics.promotion_gate(_arms(spark, sf_dir), "label", "c", "d", ("cs", "ds"))
    return gate.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in gate.dtypes])


_PIVOT = ", ".join(f"max({c}) FILTER (tag = '{t}') AS {t}_{c}" for t in _TRAJ for c in ("score", "prediction"))


@query("WITH " + LABELLED + OOF + f" SELECT id, {_PIVOT} FROM oof WHERE arm = 'candidate' GROUP BY id")
def pivot_signals(spark, sf_dir):
    """Three trajectories onto one row an id: one shuffle instead of a chain of joins."""
    scores = out_of_fold(labelled(spark, sf_dir), arms=("candidate",))
    return scores.groupBy("id").pivot("tag", list(_TRAJ)).agg(F.max("score").alias("score"), F.max("prediction").alias("prediction"))


@query("WITH m AS (SELECT conv_id, turn % 2 AS branch, turn // 2 AS row_position, length(text) AS margin FROM conversations) SELECT conv_id, row_position, max(margin) FILTER (branch = 0) AS strict, max(margin) FILTER (branch = 1) AS broad FROM m GROUP BY 1, 2 HAVING count(*) = count(DISTINCT branch)")
def pivot_margins(spark, sf_dir):
    """Two branches of margins, brought together by position; a position with a repeated branch is an error, and is left out here."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") % 2).alias("branch"), F.floor(F.col("turn") / 2).alias("row_position"), F.length("text").cast("long").alias("margin"))
    of = lambda b: F.max(F.when(F.col("branch") == b, F.col("margin")))
    return rows.groupBy("conv_id", "row_position").agg(of(0).alias("strict"), of(1).alias("broad"), F.count("*").alias("n"), F.count_distinct("branch").alias("b")).where("n = b").drop("n", "b")


def _meta(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    sizes = rows.groupBy("component_key").agg(F.count("*").alias("component_size"))
    return rows, rows.join(sizes, "component_key")


def _base_sql(r: str = "round({}, 6)") -> str:
    out = []
    for b in features.BASES:
        out += [f"{r.format(f'{b}_score')} AS {b}_score", f"{r.format(f'{b}_rank')} AS {b}_rank", f"{r.format(f'{b}_z')} AS {b}_z", f"{b}_prediction"]
    out.append(" + ".join(f"{b}_prediction" for b in features.BASES) + " AS vote_count")
    for k in ("z", "rank"):
        cols = ", ".join(f"{b}_{k}" for b in features.BASES)
        out += [f"{r.format(f'list_avg([{cols}])')} AS {k}_mean", f"{r.format(f'list_stddev_samp([{cols}])')} AS {k}_std", f"{r.format(f'least({cols})')} AS {k}_min", f"{r.format(f'greatest({cols})')} AS {k}_max"]
    for left, right, name in features.DELTAS:
        out += [f"{r.format(f'{left}_z - {right}_z')} AS {name}_score", f"{r.format(f'{left}_rank - {right}_rank')} AS {name}_rank"]
    out += [f"{r.format('ln(1.0::DOUBLE + component_size)')} AS component_log1p", "image_count::DOUBLE AS image_count", f"{r.format('ln(1.0::DOUBLE + length(name))')} AS name_chars_log1p", f"{r.format('ln(1.0::DOUBLE + length(description))')} AS description_chars_log1p"]
    return ", ".join(out)


_NORM = ", ".join(f"{_rank_sql(f'{b}_score')} AS {b}_rank, {_z_sql(f'{b}_score')} AS {b}_z" for b in features.BASES)
_MATRIX = _SIG + f", m AS (SELECT *, count(*) OVER (PARTITION BY component_key) AS component_size, {_NORM} FROM j)"


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(_MATRIX + f" SELECT id, blind_uid, component_key, fold, label, {_base_sql()} FROM m")
def feature_matrix_base(spark, sf_dir):
    rows, meta = _meta(spark, sf_dir)
    out = features.base_features(meta, signals(rows, "control"))
    return _rounded(out)


def _extra_sql() -> str:
    r = "round({}, 6)"
    out = []
    for t in _TRAJ:
        p = f"round7_{t}"
        out += [f"{r.format(f'cand_{t}_score')} AS {p}_score", f"{r.format(f'cand_{t}_rank')} AS {p}_rank", f"{r.format(f'cand_{t}_z')} AS {p}_z", f"cand_{t}_prediction AS {p}_prediction"]
        out += [f"{r.format(f'cand_{t}_{k} - {t}_{k}')} AS {p}_delta_{k}" for k in ("score", "rank", "z")]
        out.append(f"(cand_{t}_prediction <> {t}_prediction)::TINYINT AS {p}_disagrees_control")
    out.append(" + ".join(f"cand_{t}_prediction" for t in _TRAJ) + " AS round7_vote_count")
    out.append(" + ".join(f"(cand_{t}_prediction <> {t}_prediction)::INT" for t in _TRAJ) + " AS round7_control_disagreement_count")
    for k in ("rank", "z"):
        cols = ", ".join(f"cand_{t}_{k} - {t}_{k}" for t in _TRAJ)
        out += [f"{r.format(f'list_avg([{cols}])')} AS round7_delta_{k}_mean", f"{r.format(f'least({cols})')} AS round7_delta_{k}_min", f"{r.format(f'greatest({cols})')} AS round7_delta_{k}_max"]
    return ", ".join(out)


_CAND = ", ".join(f"{_rank_sql(f'cand_{t}_score')} AS cand_{t}_rank, {_z_sql(f'cand_{t}_score')} AS cand_{t}_z" for t in _TRAJ)


@query(_MATRIX + f", d AS ({signals_sql('candidate', _TRAJ, 'cand_')}), a AS (SELECT m.*, d.* EXCLUDE (id) FROM m JOIN d USING (id)), n AS (SELECT *, {_CAND} FROM a) SELECT id, blind_uid, component_key, fold, label, {_base_sql()}, {_extra_sql()} FROM n")
def feature_matrix_augmented(spark, sf_dir):
    rows, meta = _meta(spark, sf_dir)
    out = features.augmented_features(meta, signals(rows, "control"), signals(rows, "candidate", _TRAJ))
    return _rounded(out)


@query("SELECT vec_id AS step, round(CASE WHEN vec_id < 6 THEN vec_id / 6.0::DOUBLE ELSE greatest(0, 0.5 * (1 + cos(pi() * least(1, greatest(0, (vec_id - 6) / 494.0::DOUBLE))))) END, 9) AS multiplier FROM embeddings")
def lr_schedule(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("step"), F.round(hashing.warmup_multiplier(F.col("vec_id"), 500, 6), 9).alias("multiplier"))


@query("SELECT vec_id, round(ln(1 + exp(-abs(embedding[1]::DOUBLE - embedding[2]::DOUBLE))) + greatest(embedding[2]::DOUBLE - embedding[1]::DOUBLE, 0), 9) AS loss, round(1 / (1 + exp(-(embedding[1]::DOUBLE - embedding[2]::DOUBLE))), 9) AS win, embedding[1]::DOUBLE > embedding[2]::DOUBLE AS correct FROM embeddings")
def pairwise_loss(spark, sf_dir):
    margin = F.col("embedding")[0].cast("double") - F.col("embedding")[1].cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(hashing.softplus(-margin), 9).alias("loss"), F.round(hashing.expit(margin), 9).alias("win"), (margin > 0).alias("correct"))


@query("SELECT p_partkey, list_transform(range(0, p_size), lambda i: (i * (p_partkey + 99) // greatest(p_size - 1, 1))::INT) AS positions FROM part")
def even_sample(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", hashing.even_positions(F.col("p_partkey") + 100, F.col("p_size").cast("long")).alias("positions"))


@query("SELECT conv_id, sum(ceil(length(text) / 3.2))::BIGINT AS tokens, round(sum(ceil(length(text) / 3.2) * 0.0000015), 9) AS cost FROM conversations GROUP BY 1")
def cost_estimate(spark, sf_dir):
    tokens = F.ceil(F.length("text") / 3.2)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(tokens).cast("long").alias("tokens"), F.round(F.sum(tokens * 0.0000015), 9).alias("cost"))


@query("SELECT user_id, sum(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0))::BIGINT AS cost FROM events GROUP BY 1")
def cost_totals(spark, sf_dir):
    cost = F.coalesce(F.from_json("props", "k long")["k"], F.lit(0))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(cost).alias("cost"))
