"""Score files bound to manifests, and stages of a plan: each fault is named."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from veriloom.operators import dag, schedule
from veriloom.operators.contracts import ContractError
from veriloom.operators.synthetic import variants
from veriloom.sources import bound_scores, files


@pytest.fixture
def scores(spark):
    arms = F.explode(F.array(F.lit("control"), F.lit("candidate")))
    tags = F.explode(F.array(F.lit("t025"), F.lit("t050"), F.lit("t100")))
    rows = spark.range(60).select("id", (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 5).cast("int").alias("fold"), arms.alias("arm"))
    rows = rows.select("*", tags.alias("tag")).withColumn("score", F.rand(3) - 0.5)
    return rows.withColumn("prediction", (F.col("score") > 0).cast("int"))


def problems(spark, folder, roster):
    return {(r.arm, r.fold, r.tag): r.problem for r in bound_scores.audit(spark, folder, roster).where("problem is not null").collect()}


def test_bound_scores(spark, tmp_path, scores):
    folder, roster = str(tmp_path / "s"), scores.select("id", "fold", "label").distinct()
    bound_scores.write_bound(scores, folder, F.concat_ws("-", "arm", "fold"))
    assert problems(spark, folder, roster) == {} and bound_scores.audit(spark, folder, roster).count() == 30
    assert bound_scores.read_bound(spark, folder, roster).count() == 360
    held = [glob.glob(f"{folder}/scores/arm=control/fold=0/tag={t}/*.parquet")[0] for t in ("t025", "t050")]
    files.swap(spark, *held)
    swapped = {("control", 0, "t025"): "hash", ("control", 0, "t050"): "hash"}
    assert problems(spark, folder, roster) == swapped
    with pytest.raises(ContractError, match="fold=0/tag=t025.*hash"):
        bound_scores.read_bound(spark, folder, roster)
    files.swap(spark, *held)
    assert problems(spark, folder, roster) == {}
    one = ("candidate", 3, "t100")
    path = glob.glob(f"{folder}/manifests/*.json")[0]
    lines = {p: open(p).read().splitlines() for p in glob.glob(f"{folder}/manifests/*.json")}
    for p, ls in lines.items():  # a manifest that says something else than its hash
        out = [json.dumps(json.loads(x) | {"n_rows": 13}) if (json.loads(x)["arm"], json.loads(x)["fold"], json.loads(x)["tag"]) == one else x for x in ls]
        open(p, "w").write("\n".join(out) + "\n")
    for crc in glob.glob(f"{folder}/manifests/.*.crc"):
        __import__("os").remove(crc)
    assert problems(spark, folder, roster) == {one: "manifest"} and path


def test_faults_in_scores(spark, tmp_path, scores):
    roster = scores.select("id", "fold", "label").distinct()
    here = (F.col("arm") == "control") & (F.col("fold") == 1) & (F.col("tag") == "t050")
    part = ("control", 1, "t050")
    faults = {
        "roster": scores.where(~here | (F.col("id") != 1)),
        "labels": scores.withColumn("label", F.when(here & (F.col("id") == 1), 1 - F.col("label")).otherwise(F.col("label"))),
        "values": scores.withColumn("score", F.when(here & (F.col("id") == 1), F.lit(float("nan"))).otherwise(F.col("score"))),
        "repeated ids": scores.union(scores.where(here & (F.col("id") == 1))),
    }
    for name, frame in faults.items():
        folder = str(tmp_path / name)
        bound_scores.write_bound(frame, folder, F.concat_ws("-", "arm", "fold"))
        assert problems(spark, folder, roster) == {part: name}
    folder = str(tmp_path / "fits")
    bound_scores.write_bound(scores, folder, F.when(here, "other").otherwise(F.concat_ws("-", "arm", "fold")))
    assert problems(spark, folder, roster) == {("control", 1, t): "fits" for t in ("t025", "t050", "t100")}
    for f in glob.glob(f"{folder}/scores/arm=candidate/fold=4/tag=t025/*"):
        __import__("os").remove(f)
    assert problems(spark, folder, roster)[("candidate", 4, "t025")] == "no file"


def plain_levels(stages, edges):
    level = {}

    def of(s):
        if s not in level:
            level[s] = 1 + max((of(d) for d in edges.get(s, ())), default=-1)
        return level[s]

    blocked = {}

    def held(s):
        if s not in blocked:
            blocked[s] = any(stages[d] or held(d) for d in edges.get(s, ()))
        return blocked[s]

    return {s: (of(s), held(s)) for s in stages}


def test_levels(spark):
    rng = random.Random(5)
    stages = {f"s{i}": rng.random() < 0.1 for i in range(60)}
    edges = {f"s{i}": {f"s{rng.randrange(i)}" for _ in range(rng.randint(0, 3))} for i in range(1, 60)}
    rows = spark.createDataFrame([(s, stop or None) for s, stop in stages.items()] + [("s3", False)], "stage string, stop boolean")
    pairs = spark.createDataFrame([(s, d) for s, ds in edges.items() for d in ds] * 2, "stage string, depends_on string")
    assert {r.stage: (r.level, r.blocked) for r in dag.levels(rows, pairs).collect()} == plain_levels(stages, edges)
    assert dag.levels(rows.limit(0), pairs.limit(0)).count() == 0
    with pytest.raises(ContractError, match=r"\['s2', 's7', 's9'\]"):
        loop = spark.createDataFrame([("s2", "s9"), ("s9", "s7"), ("s7", "s2"), ("s10", "s9"), ("s9", "s1")], pairs.schema)
        dag.levels(rows, loop)
    with pytest.raises(ContractError, match="unknown"):
        dag.levels(rows, spark.createDataFrame([("s2", "nowhere")], pairs.schema))


def test_rounds_hold_only_what_is_left(spark, monkeypatch):
    written = []

    def counting(df, own=dag.materialised):
        out = own(df)
        written.append(out.count())
        return out

    chain = [(f"c{i}", f"c{i - 1}") for i in range(1, 8)]
    leaves = [(f"l{i}", "c7") for i in range(100)]
    pairs = spark.createDataFrame(chain + leaves, "stage string, depends_on string")
    rows = spark.createDataFrame([(f"c{i}", i == 7) for i in range(8)] + [(s, False) for s, _ in leaves], "stage string, stop boolean")
    monkeypatch.setattr(dag, "materialised", counting)
    got = {r.stage: (r.level, r.blocked) for r in dag.levels(rows, pairs).collect()}
    assert got == {f"c{i}": (i, False) for i in range(8)} | {s: (8, True) for s, _ in leaves}
    assert sum(written) < 5 * (len(chain) + len(leaves))  # not once a round


def test_checkpoints_and_variants(spark):
    rows = spark.createDataFrame([(172,), (10,), (2,), (1,)], "n long").select("n", schedule.checkpoints(F.col("n")).alias("c"))
    got = {r.n: ([x.step for x in r.c.at], r.c.collides) for r in rows.collect()}
    assert got == {172: ([43, 86, 172], False), 10: ([2, 5, 10], False), 2: ([1, 1, 2], True), 1: ([1, 1, 1], True)}
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 2), (None, 3)], "x string, y int")
    assert sorted(tuple(r) for r in variants(df, "n").collect()) == [(0, "a", 1), (1, "a", 2), (2, "a", 3), (3, "b", 1), (4, "b", 2), (5, "b", 3)]
    assert variants(df.limit(0), "n").count() == 0


def test_population_audit(spark):
    """Counts and deltas by loops; copies, masked copies and near texts of other frames are planted."""
    import re
    import statistics

    from veriloom.operators.synthetic import population_audit

    rng, rows = random.Random(4), []
    for i in range(40):
        span, changed = rng.choice(["with oil", "with gas and fire"]), rng.choice(["name", "description"])
        name, body = f"Box no. {i % 23}", "the big red box stands on the shelf in the hall " + "ab cd ef gh ij"[: i % 14]
        pos = {"name": name, "description": body, "decisive_span": span}
        pos[changed] += " " + span
        neg = {"name": name, "description": body, "decisive_span": "none"}
        neg[changed] += " empty" * (i % 3)
        rows.append((pos, neg, rng.choice(["b1", "b2", None]), rng.choice(["f1", "f2", None]), changed))
    rows += rows[:3]
    side = "struct<name:string,description:string,decisive_span:string>"
    df = spark.createDataFrame(rows, f"positive {side}, negative {side}, boundary string, style_frame_id string, changed_field string").repartition(3)
    got = {r.boundary: r for r in population_audit(df).collect()}
    norm = lambda t: re.sub("[^0-9a-zа-яё]+", " ", t.lower()).strip()
    cards = [norm(s["name"] + " " + s["description"]) for r in rows for s in r[:2]]
    other = {"name": "description", "description": "name"}
    masked = [norm(p[other[c]] + " " + p[c].replace(p["decisive_span"], "{{SLOT}}")) for p, _, _, _, c in rows]
    deltas = [len(p["name"] + p["description"]) - len(n["name"] + n["description"]) for p, n, *_ in rows]
    whole = got[None]
    assert whole.pairs == 43 and whole.duplicate_cards == len(cards) - len(set(cards)) and whole.duplicate_masked == len(masked) - len(set(masked))
    assert whole.mean_delta == pytest.approx(statistics.mean(deltas)) and whole.median_delta == statistics.median(deltas)
    for b in ("b1", "b2"):
        mine = [d for d, r in zip(deltas, rows, strict=True) if r[2] == b]
        assert got[b].pairs == len(mine) and got[b].mean_delta == pytest.approx(statistics.mean(mine)) and got[b].median_delta == statistics.median(mine)
    equal = sum(masked[i] == masked[j] and rows[i][3] != rows[j][3] for i in range(43) for j in range(i))
    assert whole.cross_frame_edges >= equal and 0.9 < whole.max_similarity <= 1.0
    none = population_audit(df.limit(0)).collect()
    assert len(none) == 1 and none[0].pairs == 0 and none[0].max_similarity == 0
