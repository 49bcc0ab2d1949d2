"""Experts over vocabularies of their own against dense fits of single folds."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veriloom.operators import experts
from veriloom.operators.contracts import ContractError


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    words = "red blue gas fire can oil soft toy doll book lamp fuel torch paper 9v x".split()
    out = []
    for i in range(60):
        y = int(rng.random() < 0.4)
        out.append((i, i % 5, y, f"c{i}", " ".join(rng.choice(words[2:8] if y and rng.random() < 0.7 else words) for _ in range(rng.randint(0, 9))) if i else None, 0.5 + rng.random()))
    return out, spark.createDataFrame(out, "id int, fold int, label int, component_key string, t string, s double").repartition(4)


def char_terms(text):
    out = Counter()
    for w in (text or "").lower().split():
        w = f" {w} "
        for n in (3, 4, 5):
            out.update(w[i : i + n] for i in range(max(1, len(w) - n + 1)))
            if len(w) <= n:
                break
    return out


def word_terms(text):
    w = [x for x in re.findall(r"\w+", (text or "").lower()) if len(x) >= 2]
    return Counter(w) + Counter(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))


def dense(held, q, blocks, balanced):
    """Scores of fold q by Newton's method over a dense matrix."""
    train = [r for r in held if r[1] not in (q, 4)]
    columns = []
    for terms, most in blocks:
        counts = {r[0]: terms(r[4]) for r in held}
        df, cf = Counter(), Counter()
        for r in train:
            df.update(counts[r[0]].keys())
            cf.update(counts[r[0]])
        known = sorted(sorted((t for t in df if df[t] >= 2), key=lambda t: (-cf[t], t))[:most])
        idf = {t: math.log((1 + len(train)) / (1 + df[t])) + 1 for t in known}
        block = np.array([[(1 + math.log(counts[r[0]][t])) * idf[t] if counts[r[0]][t] else 0.0 for t in known] for r in held])
        norm = np.sqrt((block**2).sum(axis=1, keepdims=True))
        columns.append(block / np.where(norm > 0, norm, 1))
    x = np.concatenate([*columns, np.ones((len(held), 1))], axis=1)
    mine = np.array([r[1] not in (q, 4) for r in held])
    y, s = np.array([2.0 * r[2] - 1 for r in held]), np.array([r[5] for r in held])
    if balanced:
        n, p = mine.sum(), (mine & (y > 0)).sum()
        s = s * n / 2 / np.where(y > 0, p, n - p)
    w = np.zeros(x.shape[1])
    for _ in range(200):
        short = np.maximum(0, 1 - y * (x @ w)) * mine
        gradient = w - 2 * (x.T @ (s * y * short))
        on = (short > 0) * s
        step = np.linalg.solve(np.eye(len(w)) + 2 * (x.T * on) @ x, gradient)
        w -= step
        if np.abs(step).max() < 1e-12:
            break
    return {r[0]: float(m) for r, m in zip(held, x @ w, strict=True) if r[1] == q}, [c.shape[1] for c in columns]


@pytest.mark.parametrize("balanced, most", [(False, (5000, 3000)), (True, (40, 10))])
def test_all_folds_against_dense_fits(spark, rows, balanced, most):
    held, df = rows
    blocks = [experts.Block(experts.char_terms, most[0]), experts.Block(experts.word_terms, most[1])]
    scored, told = experts.out_of_fold(df, "t", blocks, F.col("s"), balanced)
    got = {r.id: r.margin for r in scored.collect()}
    assert len(got) == 60
    for q in range(5):
        want, sizes = dense(held, q, [(char_terms, most[0]), (word_terms, most[1])], balanced)
        assert told[q]["terms"] == sizes and told[q]["rows"] == sum(r[1] not in (q, 4) for r in held)
        assert all(got[i] == pytest.approx(m, abs=2e-3) for i, m in want.items())
    signed = experts.by_sign(scored).collect()
    assert all(r.prediction == (r.margin >= 0) and r.score == pytest.approx(1 / (1 + math.exp(-r.margin))) for r in signed)
    ranked = experts.by_prevalence(scored, {q: t["positives"] / t["rows"] for q, t in told.items()}, "id").collect()
    for q in range(5):
        mine = sorted((r for r in ranked if r.fold == q), key=lambda r: (-r.margin, r.id))
        k = int(len(mine) * told[q]["positives"] / told[q]["rows"] + 0.5)
        assert [r.prediction for r in mine] == [1] * k + [0] * (len(mine) - k)


def test_contract(spark, rows):
    _, df = rows
    blocks = [experts.Block(experts.word_terms, 50)]
    with pytest.raises(ContractError, match="component"):
        experts.out_of_fold(df.withColumn("component_key", F.lit("one")), "t", blocks)
    with pytest.raises(ContractError, match="one class"):
        experts.out_of_fold(df.withColumn("label", F.lit(1)), "t", blocks)
    with pytest.raises(ContractError, match="scores of"):
        experts.out_of_fold(df.union(df.where("id = 3")), "t", blocks)


def test_rows_are_held_once_and_shuffle_nothing(spark, rows):
    """Not once a query fold: entries are those of the rows, whatever the number of folds; counting and numbering have no exchange."""
    _, df = rows
    held = df.select("id", "fold", "label", "s", F.col("t").alias("text"))
    made = experts._matrices(held, experts.B1)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace(held._jdf.queryExecution().executedPlan().toString(), "").replace("Exchange RoundRobin", "")
    trained = experts.train_folds(range(5))
    space = experts._space(made, experts.B1, trained, {q: 36 for q in trained})
    numbered = experts._numbered(made, space, 2).toArrow().to_batches()
    found = [experts._opened(b, i, 2, experts._Room()) for b in numbered for i in range(b.num_rows)]
    of = [set().union(*[set(t.to_pylist())]) for t in space.terms]
    want = sum(len(set(char_terms(r[4])) & of[0]) + len(set(word_terms(r[4])) & of[1]) for r in rows[0])
    assert sum(len(x.label) for x in found) == 60 and sum(int(x.n.sum()) for x in found) == want


def test_terms_by_numbers(spark):
    words = ["a", "ab", "abc", "éß漢", "𝒳y", "hello", "aaaaaaa", "hell"]
    numbers, texts = experts._padded_grams(pa.array(words))
    for row in ([0], [1, 1, 5], [2, 3, 4, 7], [*range(8)]):
        found, n = np.unique(numbers(np.array(row)), return_counts=True)
        assert dict(zip(texts(found).to_pylist(), n.tolist(), strict=True)) == char_terms(" ".join(words[i] for i in row))
    numbers, texts = experts._words_and_pairs(pa.array(words))
    found, n = np.unique(numbers(np.array([0, 1, 0, 1, 2])), return_counts=True)
    assert dict(zip(texts(found).to_pylist(), n.tolist(), strict=True)) == {"a": 2, "ab": 2, "abc": 1, "a ab": 2, "ab a": 1, "ab abc": 1}
