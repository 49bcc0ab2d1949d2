import random
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriloom.functions.hashing import canonical_sha256
from veriloom.functions.text import padded_ngrams, spaced_words
from veriloom.operators import contracts, features, metrics, pairs, policy, policy_tables, ranking, schedule, scoring, similarity
from veriloom.operators.graph import connected_components


def test_position_within_spans_partitions(spark):
    rows = spark.range(2000).select((F.col("id") % 3 == 0).cast("int").alias("g"), (F.col("id") * 7919 % 1009).alias("v"), "id")
    got = ranking.position_within(rows, ["g"], ["v", "id"], "at").toPandas()
    got["want"] = got.sort_values(["v", "id"]).groupby("g").cumcount()
    assert (got["at"] == got["want"]).all() and len(got) == 2000


def test_position_of_null_groups_and_ties(spark):
    rows = spark.createDataFrame([(None, 1), (None, 1), ("a", 2)], "g string, v int")
    got = sorted((r.g or "", r.at) for r in ranking.position_within(rows, ["g"], ["v"], "at").collect())
    assert got == [("", 0), ("", 1), ("a", 0)]
    assert ranking.position_within(rows.limit(0), ["g"], ["v"], "at").count() == 0


def test_positions_and_totals_keep_clashing_columns(spark):
    names = ("__at", "__part", "__p", "__n", "__g0", "__shift", "__task", "__first", "__S0")
    rows = spark.range(60).select((F.col("id") % 2).alias("g"), "id", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for out in (ranking.position_within(rows, ["g"], ["id"], "at"), ranking.running_totals(rows, ["g"], "id", {"at": "id"})):
        assert out.columns == [*rows.columns, "at"]
        assert out.select(*names).distinct().collect() == [tuple(range(len(names)))]
    totals = {r.id: r.at for r in ranking.running_totals(rows, ["g"], F.desc("id"), {"at": "id"}).collect()}
    assert totals == {i: sum(j for j in range(i, 60, 2)) for i in range(60)}


def test_ranks_and_zscores_of_ties_and_single_rows(spark):
    frame = pd.DataFrame({"f": [0, 0, 0, 0, 1, 2, 2], "x": [3.0, 1.0, 3.0, 2.0, 9.0, 5.0, 5.0], "i": range(7)})
    rows = spark.createDataFrame(frame)
    got = ranking.zscores(rows, ["f"], {"z": "x"}).join(ranking.pct_ranks(rows, "i", ["f"], {"r": "x", "again": "x"}), "i").toPandas().sort_values("i")
    assert list(got.r) == list(got.again)
    assert list(got.r) == list(frame.groupby("f").x.rank(pct=True))
    deviation = frame.groupby("f").x.transform("std").fillna(1.0).replace(0, 1.0)
    assert got.z.values == pytest.approx(((frame.x - frame.groupby("f").x.transform("mean")) / deviation).values)
    whole = ranking.pct_rank_whole(rows, "x", "r").toPandas().sort_values("i")
    assert list(whole.r) == pytest.approx(list(frame.x.rank(pct=True)))


@pytest.mark.parametrize(("n", "k"), [(0, 0), (13, 0), (14, 1), (27, 1), (28, 1), (1000, 36), (1101, 40), (5502, 198)])
def test_quota(n, k):
    assert ranking.quota(n) == k


def test_label_top(spark):
    rows = spark.createDataFrame([(1, 0.5, "b"), (2, 0.5, "a"), (3, 0.9, "c"), (4, 0.1, "d")], "id int, s double, t string")
    for k, ids in ((0, []), (1, [3]), (2, [2, 3]), (3, [1, 2, 3]), (9, [1, 2, 3, 4])):
        assert sorted(r.id for r in ranking.label_top(rows, k, "s", "t", "y").where("y = 1").collect()) == ids
    assert ranking.prevalence(3, 0.5) == 2 and ranking.prevalence(5, 2.0) == 5


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components(spark, edges):
    root = list(range(26))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.component for r in connected_components(frame).collect()}
    assert got == {i: find(i) for e in edges for i in e}


def test_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(3).shuffle(order)
    frame = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "src long, dst long")
    assert {r.component for r in connected_components(frame).collect()} == {0}


def test_cosine_join_is_exact(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 9))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    vectors = similarity.tfidf(docs, "id", spaced_words("t"), padded_ngrams)
    frame = vectors.toPandas()
    by = {i: dict(zip(g.term, g.w, strict=True)) for i, g in frame.groupby("id")}
    expected = {(a, b) for a in by for b in by if a < b and sum(w * by[b].get(t, 0) for t, w in by[a].items()) + 1e-7 >= 0.9}
    assert {(r.left_id, r.right_id) for r in similarity.cosine_pairs(vectors, 0.9).collect()} == expected and expected
    # Blocks of a few vectors give the same pairs, and none of the pairs that share a term by chance leaves its task.
    assert {(r.left_id, r.right_id) for r in similarity.cosine_pairs(vectors, 0.9, block=3).collect()} == expected
    lonely = spark.createDataFrame([(1, "abc"), (2, "xyz")], "id long, t string")
    assert similarity.tfidf(lonely, "id", spaced_words("t"), padded_ngrams, min_df=3).count() == 0
    key = lambda v: sorted((r.id, r.df, round(r.w, 9)) for r in v.collect())
    whole = similarity.tfidf(docs, "id", spaced_words("t"), padded_ngrams, 1, None)
    assert key(whole) == key(similarity.tfidf(docs, "id", spaced_words("t"), padded_ngrams, 1, 10**6)) == key(similarity.tfidf(docs, "id", spaced_words("t"), padded_ngrams, 1, 10**4))


def cosine(a, b):
    return sum(w * b.get(t, 0) for t, w in a.items())


@pytest.mark.parametrize("texts", [["aa bb", "aa bc", "xx yy", "aa bb"], ["one", "two", "six"], ["same", "same"], ["abcd abce", "abcd wxyz", "klmn wxyz"], []])
def test_cross_group_similarity(spark, texts):
    """Against all pairs of rows; the greatest similarity is found below the threshold too, and copies count."""
    rows = [(i, t, f"g{i % 2}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "id long, t string, grp string")
    first = docs.groupBy("t").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    vectors = similarity.tfidf(first, "id", spaced_words("t"), padded_ngrams, 1, None, "copies")
    groups = docs.groupBy("t", "grp").agg(F.count("*").alias("copies")).join(first.select("t", "id"), "t")
    got = similarity.cross_group_similarity(vectors, groups, 0.94).first()
    by = {i: dict(zip(g.term, g.w, strict=True)) for i, g in vectors.toPandas().groupby("id")}
    at = {t: by.get(i, {}) for t, i in ((r.t, r.id) for r in first.collect())}
    sims = [1.0 if a[1] == b[1] else cosine(at[a[1]], at[b[1]]) for n, a in enumerate(rows) for b in rows[n + 1 :] if a[2] != b[2]]
    assert got.n_edges == sum(s >= 0.94 for s in sims) and got.max_sim == pytest.approx(max(sims, default=0.0))


def test_dense_pairs_of_a_hot_label(spark):
    rng = random.Random(8)
    rows = [(i, None if i == 7 else [0.0] * 4 if i == 9 else [rng.gauss(0, 1) for _ in range(4)], "hot" if i % 5 else "cold") for i in range(90)]
    got = {(r.left_id, r.right_id): r.sim for r in similarity.dense_pairs(spark.createDataFrame(rows, "id long, v array<float>, l string"), "id", "v", "l", 0.5, block=7).collect()}
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    good = [(i, unit(v), lab) for i, v, lab in rows if v and any(v)]
    want = {(a[0], b[0]): sum(x * y for x, y in zip(a[1], b[1], strict=True)) for n, a in enumerate(good) for b in good[n + 1 :] if a[2] == b[2]}
    want = {k: v for k, v in want.items() if v >= 0.5}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_evidence_of_empty_and_repeated_cards(spark):
    rows = [(1, None, None), (2, "", "  "), (3, ";", None), (4, "Газ. Газ. Спички и газ", "газ"), (5, "&lt;b&gt;", "<br>\0"), (6, "слово " * 60, None)]
    got = {}
    for r in policy.evidence(spark.createDataFrame(rows, "id int, name string, description string"), "id", ("name", "description"), ("газ",), 2, 40).orderBy("id", "evidence_id").collect():
        got.setdefault(r.id, []).append((r.evidence_id, r.evidence, r.hits))
    assert got[1] == got[2] == [(0, "Карточка товара", 0)] and got[3] == [(0, ";", 0)] and got[5] == [(0, "Карточка товара", 0)]
    assert got[4] == [(0, "Газ.", 1), (1, "Спички и газ", 1)]
    assert got[6] == [(0, " ".join(["слово"] * 6), 0)]


def test_shipped_rules_at_their_borders(spark):
    rows = [("Ролл", "отсутствует химическая пропитка", 1, 0), ("Ролл", "без химической основы, пропитан", 1, 1), ("Печь", "Работает на дровах", 1, 0), ("Печь газовая", "Работает на дровах", 1, 1),
            ("Плита и баллон 450 мл", "", 0, 1), ("Плитаи баллон 450 мл", "", 0, 0), ("Бруски", "парафин, пропитаны", 0, 1)]
    frame = spark.createDataFrame(rows, "name string, description string, label int, want int")
    got = frame.select("want", policy.rule_label("name", "description", F.col("label")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    sku = {"box AB123- x": True, "a-AB123 x": False, "AB-123": True, "AB12": False, "ABCDEF": False, "x AB1234": True}
    marked = spark.createDataFrame([(t,) for t in sku], "t string").select("t", F.col("t").rlike(policy.SKU).alias("y")).collect()
    edge = re.compile(r"\b(?=[A-ZА-Я0-9-]{6,}\b)(?=[A-ZА-Я0-9-]*\d)(?=[A-ZА-Я0-9-]*[A-ZА-Я])[A-ZА-Я0-9-]+\b")
    assert {r.t: r.y for r in marked} == {t: bool(edge.search(t)) for t in sku}


def test_metrics(spark):
    y, s = [1, 0, 1, 1, 0, 0], [0.9, 0.9, 0.7, 0.2, 0.2, 0.1]
    rows = spark.createDataFrame([(a, b, int(b > 0.5)) for a, b in zip(y, s, strict=True)], "y int, s double, p int")
    m = metrics.binary_metrics(rows, "y", "p").first()
    assert (m.tn, m.fp, m.fn, m.tp) == (2, 1, 1, 2) and m.f1 == pytest.approx(2 / 3)
    assert metrics.average_precision(rows, "y", "s").first().ap == pytest.approx(1 / 3 * 1 / 2 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)
    nothing = spark.createDataFrame([(0, 0.1, 0)], "y int, s double, p int")
    assert metrics.binary_metrics(nothing, "y", "p").first().f1 == 0.0 and metrics.average_precision(nothing, "y", "s").first().ap == 0.0


def test_gate(spark):
    rows = spark.createDataFrame([(1, 0, 1, 0.1, 0.9), (0, 0, 0, 0.2, 0.2), (1, 1, 1, 0.8, 0.8)], "y int, c int, d int, cs double, ds double")
    gate = metrics.promotion_gate(rows, "y", "c", "d", ("cs", "ds")).first()
    assert (gate.verdict, gate.rescues, gate.harms) == ("GO", 1, 0)
    assert metrics.promotion_gate(rows, "y", "d", "c", ("ds", "cs")).first().verdict == "STOP"


CARD = "id long, label int, fold int, component_key string, name string, description string"


def cards(spark):
    rows = [(f * 40 + i, int(i == 0), f, f"c{f}-{i}", f"n{i}", "d") for f in range(5) for i in range(6)]
    return spark.createDataFrame(rows, CARD)


def real(pair_id, p, n, fold, status="ACCEPT"):
    return (pair_id, p, n, "b0", status, [f for f in range(5) if f != fold])


PAIR = "pair_id string, positive_id long, negative_id long, boundary_code string, review_status string, eligible_query_folds array<int>"


def broken(spark, rows):
    checked = pairs.check_real_pairs(pairs.resolve_endpoints(spark.createDataFrame(rows, PAIR), cards(spark)))
    return {r.pair_id: r.violations for r in checked.collect()}


def test_real_pair_contract(spark):
    good = [real("a", 0, 1, 0), real("b", 40, 41, 1), real("c", 0, 3, 0)]
    assert set(map(tuple, broken(spark, good).values())) == {()}
    assert "direction" in broken(spark, [real("a", 1, 0, 0)])["a"]
    assert "allowed_folds" in broken(spark, [real("a", 160, 161, 4)])["a"]
    assert "accepted" in broken(spark, [real("a", 0, 1, 0, "REJECT")])["a"]
    assert "eligible_match" in broken(spark, [real("a", 0, 1, 1)])["a"]
    assert "endpoints_known" in broken(spark, [real("a", 0, 999, 0)])["a"]
    assert "unique_relation" in broken(spark, [real("a", 0, 1, 0), real("b", 0, 1, 0)])["b"]
    assert "same_fold" in broken(spark, [real("a", 0, 41, 0)])["a"]


def test_query_pair_contract_and_selection(spark):
    schema = PAIR + ", mass_key string, query_fold int"
    rows = [("a", 0, 1, "b", "ACCEPT", [0], "m1", 0), ("b", 0, 1, "b", "ACCEPT", [1], "m1", 1), ("c", 0, 2, "b", "ACCEPT", [1], "m2", 1)]
    resolved = pairs.resolve_endpoints(spark.createDataFrame(rows, schema), cards(spark))
    assert all(not r.violations for r in pairs.check_query_pairs(resolved).collect())
    assert sorted(r.pair_id for r in pairs.first_of_mass(resolved).collect()) == ["a", "c"]
    clash = pairs.resolve_endpoints(spark.createDataFrame([*rows, ("d", 0, 3, "b", "ACCEPT", [1], "m1", 1)], schema), cards(spark))
    found = {r.pair_id: r.violations for r in pairs.check_query_pairs(clash).collect()}
    assert {"one_relation_per_mass", "unique_mass_in_query"} <= set(found["d"]) and "one_relation_per_mass" in found["a"]
    mass = {r.pair_id: r.normalized_pair_weight for r in pairs.reuse_mass(resolved).collect()}
    assert sum(mass.values()) == pytest.approx(1) and mass["a"] == pytest.approx(1 / 3)


def test_folds(spark):
    split = pairs.fold_split(cards(spark), 1)
    assert {(r.fold, r.role) for r in split.collect()} == {(0, "train"), (1, "query"), (2, "train"), (3, "train"), (4, "unused")}
    assert pairs.shared_components(split).count() == 0
    assert {r.role for r in pairs.fold_split(cards(spark), None).collect()} == {"train"}
    leak = pairs.fold_split(cards(spark).withColumn("component_key", F.lit("x")), 1)
    assert pairs.shared_components(leak).count() == 1


def test_component_weights(spark):
    got = pairs.component_class_weights(cards(spark)).toPandas()
    assert got.weight.sum() == pytest.approx(30)
    assert got.groupby("label").weight.sum().tolist() == pytest.approx([15, 15])


def greedy_order(frame, batch, seed):
    """The schedule by placing one row after the other."""
    import hashlib
    import hmac

    rank = lambda ns, v: hmac.new(seed.encode(), f"{ns}\0{v}".encode(), hashlib.sha256).hexdigest()
    blocks = -(-len(frame) // batch)
    sizes = [min(batch, len(frame) - b * batch) for b in range(blocks)]
    held = [[] for _ in range(blocks)]
    ranked = {v: sorted(frame[frame.label == v].blind_uid, key=lambda u, n=n: rank(n, u)) for v, n in ((1, "positive-order"), (0, "negative-order"))}
    for u in ranked[1]:
        best = min((b for b in range(blocks) if len(held[b]) < sizes[b]), key=lambda b: (len(held[b]) / sizes[b], b))
        held[best].append(u)
    rest = iter(ranked[0])
    out = []
    for b in range(blocks):
        held[b] += [next(rest) for _ in range(sizes[b] - len(held[b]))]
        out += sorted(held[b], key=lambda u, b=b: rank(f"block-{b}", u))
    return out


@pytest.mark.parametrize(("n", "positives"), [(1, 0), (7, 7), (50, 9), (67, 40), (33, 2)])
def test_stratified_order(spark, n, positives):
    frame = pd.DataFrame({"blind_uid": [f"u{i:03d}" for i in range(n)], "label": [int(i < positives) for i in range(n)]})
    got = schedule.stratified_order(spark.createDataFrame(frame), 16, "42").toPandas().sort_values("position")
    assert got.position.tolist() == list(range(n))
    assert got.blind_uid.tolist() == greedy_order(frame, 16, "42")


def test_draws():
    groups = {"a": [1, 2], "b": [3], "c": [4, 5, 6]}
    order = schedule.group_cycle_draws(groups, 14, "s")
    assert order == schedule.group_cycle_draws(groups, 14, "s") and len(order) == 14
    named = {i: g for g, v in groups.items() for i in v}
    counts = Counter(named[i] for i in order)
    assert max(counts.values()) - min(counts.values()) <= 1
    drawn = Counter(schedule.weighted_draws([5, 3, 2], 11, "s"))
    assert sum(drawn.values()) == 11 and drawn[0] in (5, 6)
    assert schedule.group_cycle_draws(groups, 0, "s") == [] and schedule.weighted_draws([1.0], 0, "s") == []
    assert canonical_sha256([]).startswith("4f53cda18c2b")


def test_checkpoints(spark):
    assert {r.step: r.fraction for r in schedule.checkpoint_steps(spark, 172).collect()} == {43: 0.25, 86: 0.5, 172: 1.0}
    assert [r.step for r in schedule.checkpoint_steps(spark, 10).orderBy("step").collect()] == [2, 5, 10]
    for broken in ((1, (0.25, 0.5, 1.0)), (8, (0.25, 0.5)), (0, (1.0,))):
        with pytest.raises(ValueError):
            schedule.checkpoint_steps(spark, *broken)
    plan = schedule.plan_draws(5502, 32, 4, 4, 2, True, 0.03)
    assert (plan["steps"], plan["warmup"], plan["real"], plan["synthetic"], plan["query"]) == (172, 6, 688, 688, 344)
    assert schedule.same_arms({"ce_sha256": 1, "query": 0}, {"ce_sha256": 1, "query": 5}) == []
    assert schedule.same_arms({"ce_sha256": 1, "query": 0}, {"ce_sha256": 2, "query": 0}) == ["ce_sha256", "query"]


def test_feature_matrices(spark):
    rows = spark.range(200).select(
        "id", F.lit("u").alias("blind_uid"), F.lit("c").alias("component_key"), (F.col("id") % 5).cast("int").alias("fold"), (F.col("id") % 40 == 0).cast("int").alias("label"),
        F.lit(1).alias("component_size"), F.lit(2).alias("image_count"), F.lit("name").alias("name"), F.lit(None).cast("string").alias("description"),
    )
    control = rows.select("id", *[c for k, b in enumerate(features.BASES) for c in ((F.col("id") * (k + 1) / 17.0).alias(f"{b}_score"), ((F.col("id") + k) % 3 == 0).cast("int").alias(f"{b}_prediction"))])
    candidate = control.withColumns({f"{t}_score": F.col(f"{t}_score") + F.col("id") * 0.002 - 0.2 for t in features.TRAJECTORY})
    base = features.base_features(rows, control)
    features.feature_contract(base, 39)
    both = features.augmented_features(rows, control, candidate)
    features.feature_contract(both, 71)
    assert both.count() == 200
    with pytest.raises(ValueError):
        features.feature_contract(base.withColumn("b1_z", F.lit(float("nan"))), 39)


def test_policy(spark):
    rows = spark.createDataFrame(
        [("плита и баллон 450 мл", "", 0), ("бруски", "парафином глубоко пропитан", 0), ("печь", "работает на дровах", 1), ("печь газ", "работает на дровах", 1), ("ролл", "без химических", 1), (None, None, 1)],
        "n string, d string, f int",
    )
    got = [r[0] for r in rows.select(policy.rule_label("n", "d", F.col("f"))).collect()]
    assert got == [1, 1, 0, 1, 0, 1]
    texts = [("не является бад", True), ("не бад", True), ("не бадминтон", False), ("не является лекарством и бад", True), ("бад", False)]
    frame = spark.createDataFrame(texts, "t string, want boolean")
    assert all(r[0] == r[1] for r in frame.select(F.col("t").rlike(policy.NEGATION), "want").collect())


@pytest.mark.parametrize(("size", "own"), [(49, False), (50, True), (300, True), (301, False)])
def test_result_grammar(spark, size, own):
    rows = spark.createDataFrame([(1, "x" * size)], "y int, c string")
    result = rows.select(policy.format_result(F.col("y"), F.col("c"), {0: "n" * 60, 1: "p" * 60}).alias("r"))
    parsed = result.select(*[c.alias(k) for k, c in policy.parse_result(F.col("r")).items()]).first()
    assert parsed.valid and parsed.parsed_label == 1 and (parsed.comment == "x" * size) == own
    trailing = result.select(F.concat("r", F.lit("\n")).alias("r")).select(policy.parse_result(F.col("r"))["valid"]).first()[0]
    assert trailing is False


def test_contracts(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (2, 1)], "id int, label int")
    with pytest.raises(contracts.ContractError):
        contracts.require(rows, label_is_one=F.col("label") == 1)
    with pytest.raises(contracts.ContractError):
        contracts.require_unique(rows, "id")
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(rows, ["id", "x"])
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(rows, ["id"], "^lab")
    with pytest.raises(contracts.ContractError):
        contracts.join_one_to_one(rows.where("id = 1"), rows.where("id = 9"), "id")
    assert contracts.same_rows(rows, rows.orderBy(F.desc("id"))) and not contracts.same_rows(rows, rows.distinct())
    bound = contracts.bind_self_hash({"a": 1, "self_sha256": "old"})
    assert contracts.verify_self_hash(bound) is bound
    with pytest.raises(contracts.ContractError):
        contracts.verify_self_hash(bound | {"a": 2})
    with pytest.raises(contracts.ContractError):
        contracts.check_provenance({"a": [{"private_label": 1}]}, {})
    with pytest.raises(contracts.ContractError):
        contracts.check_provenance({"a": True}, {"a": False})
    contracts.check_pinned({"a": {"b": 1}}, {"a.b": 1})
    with pytest.raises(contracts.ContractError):
        contracts.dag_levels({"a": ["b"], "b": ["a"]})
    a = spark.createDataFrame([("x", 1, "h"), ("y", 1, "h")], "path string, bytes long, sha256 string")
    b = spark.createDataFrame([("x", 2, "g"), ("z", 1, "h")], "path string, bytes long, sha256 string")
    assert {(r.path, r.problem) for r in contracts.inventory_difference(a, b).collect()} == {("x", "changed"), ("y", "missing"), ("z", "unexpected")}


def test_scorers(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, None), (3, "abc")], "id int, t string")
    got = {r.id: r.score for r in scoring.apply_scorer(rows, "t", scoring.mock_scorer("ns"), batch=2).collect()}
    assert got[1] == got[3] and -1 <= got[2] <= 1
    docs = spark.createDataFrame([(i, i % 2, i % 5, "red box fuel" if i % 2 else "blue empty case", 1.0) for i in range(40)], "id int, y int, fold int, t string, w double")
    terms = F.split("t", " ")
    fit = lambda train: (lambda test: scoring.expert_scores(scoring.linear_expert(train, terms, "y", "w", 1 << 10, 10), test, terms, "e"))
    scored = scoring.out_of_fold(docs, range(5), fit)
    assert scored.count() == 40 and scored.where("e_prediction = y").count() == 40


def test_policy_tables(spark):
    t = policy_tables
    rows = spark.createDataFrame([(1, 0, "это бад к пище"), (1, 1, "просто supplement"), (2, 0, "спортивное питание и протеин"), (3, 0, "бадминтон")], "id int, evidence_id int, k string")
    bases = t.allowed(t.SUPPLEMENT, 1, "B")
    best = {r.id: (r.score, r.evidence_id, r.basis) for r in policy.best_evidence(rows, t.scores(F.col("k"), bases, "B")).collect()}
    assert best == {1: (6, 0, "explicit_bad_status")}
    sport = policy.best_evidence(rows, t.scores(F.col("k"), t.allowed(t.SUPPLEMENT, 0, "A"), "A")).where("id = 2").first()
    assert (sport.score, sport.basis) == (2, "sport_nutrition")
    kit = spark.createDataFrame([("газовый баллон и спички в комплекте",), ("только в комплекте",)], "k string")
    assert [r[0] for r in kit.select(t.scores(F.col("k"), ["included_flammable_content"], "B")["included_flammable_content"]).collect()] == [7, 0]
    assert set(t.MARKERS) == set(t.PHRASES) == {b for v in t.ALLOWED.values() for b in v}
    assert "mushroom_product" not in t.allowed(t.SUPPLEMENT, 0, "A") and t.phrase("sport_nutrition", "A") != t.phrase("sport_nutrition", "B")
    assert all(50 <= len(v) <= 300 for v in t.FALLBACK.values())


def test_counts_stay_in_their_rows(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (None, "a")], "id int, t string")
    words = F.split("t", " ")
    once = similarity.counts_by_id(docs, "id", F.filter(words, lambda w: w != ""))
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in once.collect()} == {(1, "a", 1), (1, "b", 2), (None, "a", 1)}
    twice = similarity.counts_by_id(docs.union(docs.where("id = 1 or id is null")), "id", words)
    assert {tuple(r) for r in twice.where("value <> ''").collect()} == {(1, "a", 2), (1, "b", 4), (None, "a", 2)}


def test_cross_group_similarity_in_two_passes(spark, monkeypatch):
    """The nearest pair is far below the threshold; texts of several groups meet all, though groups begin with the same text."""
    levels, near = [], similarity._near
    monkeypatch.setattr(similarity, "_near", lambda v, level, **kw: levels.append(level) or near(v, level, **kw))
    texts = [("ab cd", "x"), ("abcd efgh ijkl", "x"), ("abcd mnop qrst", "y"), ("uvwx klmn yzab", "y")]
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(texts)], "id long, t string, grp string")
    vectors = similarity.tfidf(docs, "id", spaced_words("t"), padded_ngrams, 1, None)
    by = {i: dict(zip(g.term, g.w, strict=True)) for i, g in vectors.toPandas().groupby("id")}
    got = similarity.cross_group_similarity(vectors, docs.select("id", "grp", F.lit(1).alias("copies")), 0.94).first()
    assert (got.n_edges, got.max_sim) == (0, pytest.approx(max(cosine(by[a], by[b]) for a in (0, 1) for b in (2, 3)))) and len(levels) <= 4
    both = docs.select("id", F.explode(F.when(F.col("id") == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array("grp"))).alias("grp"), F.lit(1).alias("copies"))
    assert similarity.cross_group_similarity(vectors, both, 0.1).first().n_edges == 1 + sum(cosine(by[a], by[b]) >= 0.1 for a, b in [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)])


def test_few_candidates_of_the_cosine_join(spark):
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in "klm" for b in "aeiou" for c in "rst"]
    texts = [" ".join(rng.choices(words, k=12)) for _ in range(300)]
    docs = spark.createDataFrame([(i, t + (" end" if i % 2 else "")) for i, t in enumerate(x for t in texts for x in (t, t))], "id long, t string")
    held = similarity._held(similarity.tfidf(docs, "id", spaced_words("t"), padded_ngrams)).withColumn("grp", F.lit(None).cast("long")).toArrow()
    lists = pa.Table.from_batches(similarity._prefixes(0.84)(held.to_batches()))
    tight, loose = (set(zip(*(x.tolist() for x in similarity._products(lists, lists, True, 0.06, least)), strict=True)) for least in (0.9 - 1e-5, -1.0))
    assert {(i, i + 1) for i in range(0, 600, 2)} <= tight <= loose and 3 * len(tight) < len(loose)


def test_many_candidates_are_verified_by_cells(spark, monkeypatch):
    rng = random.Random(7)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=5)) for _ in range(60)]
    vectors = similarity.tfidf(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", spaced_words("t"), padded_ngrams)
    key = lambda found: [(r.left_id, r.right_id, round(r.sim, 9)) for r in found.orderBy("left_id", "right_id").collect()]
    want = key(similarity.cosine_pairs(vectors, 0.9))
    monkeypatch.setattr(similarity, "FEW_PAIRS", 0)
    monkeypatch.setattr(similarity, "CELL", 500)
    assert key(similarity.cosine_pairs(vectors, 0.9)) == want and want
