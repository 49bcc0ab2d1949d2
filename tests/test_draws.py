"""Permutations by index, and draws from them."""

import hashlib
import hmac
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veriloom.operators import draws
from veriloom.operators.contracts import ContractError


def plain(i, n, seed, name):
    a = math.ceil(math.sqrt(n))
    b = -(-n // a)
    while True:
        left, right = divmod(i, b)
        for k in range(draws.ROUNDS):
            text = "\0".join((name, str(k), str(left if k % 2 else right)))
            move = int(hmac.new(seed.encode(), text.encode(), hashlib.sha256).hexdigest()[:12], 16)
            left, right = (left, (right + move) % b) if k % 2 else ((left + move) % a, right)
        i = left * b + right
        if i < n:
            return i


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 17, 100, 257])
def test_permutation(spark, n):
    got = spark.range(n).select("id", draws.permuted(F.col("id"), F.lit(n), "seed", F.lit(f"name{n}")).alias("p")).collect()
    assert [r.p for r in sorted(got)] == [plain(i, n, "seed", f"name{n}") for i in range(n)]
    assert sorted(r.p for r in got) == list(range(n))


def test_group_draws(spark):
    rows = [(f"g{g}", 10 * g + m) for g in range(7) for m in range(1 + g % 4)] + [(None, 1), ("g0", None)]
    df = spark.createDataFrame(rows, "g string, m int").repartition(3)
    got = sorted(tuple(r) for r in draws.group_draws(df, "g", "m", 7 * 25 + 3, "s").collect())
    assert [d for d, _, _ in got] == list(range(178))
    members = {f"g{g}": {10 * g + m for m in range(1 + g % 4)} for g in range(7)}
    cycles = [got[i : i + 7] for i in range(0, 175, 7)]
    assert all({g for _, g, _ in c} == set(members) for c in cycles) and len({tuple(g for _, g, _ in c) for c in cycles}) > 20
    for g, held in members.items():
        dealt = [m for _, h, m in got if h == g]
        assert all(set(dealt[i : i + len(held)]) == held for i in range(0, len(dealt) - len(held) + 1, len(held)))
    again = draws.group_draws(df.repartition(5), "g", "m", 178, "s").collect()
    assert sorted(tuple(r) for r in again) == got != sorted(tuple(r) for r in draws.group_draws(df, "g", "m", 178, "t").collect())
    assert draws.group_draws(df, "g", "m", 0, "s").count() == 0
    with pytest.raises(ContractError):
        draws.group_draws(df.limit(0), "g", "m", 3, "s")


def test_weighted_draws(spark, monkeypatch):
    monkeypatch.setattr(draws, "CHUNK", 8)
    df = spark.createDataFrame([(i, float(w)) for i, w in enumerate([5, 0, 1, 1, 1, 90, 2.5])], "k int, w double").repartition(3)
    got = draws.weighted_draws(df, "k", "w", 333, "s").collect()
    assert sorted(r.draw for r in got) == list(range(333))
    counts, total = Counter(r.k for r in got), 100.5
    assert all(abs(counts[k] - 333 * w / total) < 1 for k, w in enumerate([5, 0, 1, 1, 1, 90, 2.5])) and counts[1] == 0
    ordered = [r.k for r in sorted(got)]
    assert ordered != sorted(ordered) and sum(k == 5 for k in ordered[:100]) > 70
    for bad in ([(0, -1.0)], [(0, float("nan"))], [(0, None)], [(0, 0.0)]):
        with pytest.raises(ContractError):
            draws.weighted_draws(spark.createDataFrame(bad, "k int, w double"), "k", "w", 3, "s")
