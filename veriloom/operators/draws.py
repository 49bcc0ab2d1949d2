"""Draws whose i-th one is an expression of i: no stream of pseudo-random numbers, so any task makes any of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions.hashing import hmac_sha256
from veriloom.operators.contracts import ContractError
from veriloom.operators.ranking import position_within, running_total
from veriloom.operators.schedule import apportion
from veriloom.session import materialised

#: Rounds of a permutation; copies of one row that are made at once.
ROUNDS, CHUNK = 4, 1 << 16


def _bound(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def permuted(i: Column, n: Column, seed: str, name: Column) -> Column:
    """Where the permutation of 0..n-1 that seed and name choose puts i.

    i is written with two digits, to the bases a = ceil(sqrt(n)) and b = ceil(n / a), and in each round one digit is moved on by the
    HMAC of the other. That permutes a * b numbers; one that lands on n or beyond is moved again until it does not, which
    takes a * b - n + 1 rounds at most, and one in most cases.
    """
    i, n = i.cast("long"), n.cast("long")
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def moved(k: Column, digit: Column) -> Column:
        text = F.concat_ws("\0", name, k.cast("string"), digit.cast("string"))
        return F.conv(F.substring(hmac_sha256(seed, text), 1, 12), 16, 10).cast("long")

    def step(s: Column, k: Column) -> Column:
        left, right = s["left"], s["right"]
        of_left = F.struct(F.pmod(left + moved(k, right), a).alias("left"), right.alias("right"))
        of_right = F.struct(left.alias("left"), F.pmod(right + moved(k, left), b).alias("right"))
        return F.when(k % 2 == 0, of_left).otherwise(of_right)

    def once(v: Column) -> Column:
        digits = F.struct(F.floor(v / b).cast("long").alias("left"), (v % b).alias("right"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), digits, step, lambda s: s["left"] * b + s["right"])

    outside = F.sequence(F.lit(0).cast("long"), a * b - n)
    start = F.struct(i.alias("v"), F.lit(False).alias("done"))
    again = lambda s, _: F.when(s["done"], s).otherwise(_bound(once(s["v"]), lambda y: F.struct(y.alias("v"), (y < n).alias("done"))))
    return F.aggregate(outside, start, again, lambda s: s["v"])


def group_draws(members: DataFrame, group: str, member: str, needed: int, seed: str) -> DataFrame:
    """(draw, group, member) of draws 0..needed-1: the groups take turns, all once in each cycle, in an order of the cycle's own,
    and each deals its members from decks, all once in each deck.

    Draw i falls into cycle i div groups; its group is the place of i mod groups in the cycle's permutation, its member that
    of the cycle's number in the group's deck. Groups and members are numbered by ranges and joined by number. Repeated
    members are members of their own; null groups and members take no part; without members there are no draws to make: an error.
    """
    spark = members.sparkSession
    held = members.select(F.col(group).alias("group"), F.col(member).alias("member")).where("group is not null and member is not null")
    placed = materialised(position_within(held, ["group"], ["member"], "at"))
    sizes = placed.groupBy("group").agg(F.count("*").alias("size"))
    groups = materialised(position_within(sizes, [], ["group"], "number"))
    n = groups.count()
    if needed > 0 and not n:
        raise ContractError("draws need groups that have members")
    draws = spark.range(needed).select(F.col("id").alias("draw"), F.floor(F.col("id") / max(1, n)).cast("long").alias("cycle"))
    number = permuted(F.col("draw") % max(1, n), F.lit(n), seed, F.concat(F.lit("cycle\0"), F.col("cycle").cast("string")))
    named = draws.withColumn("number", number).join(groups, "number")
    deck = F.concat(F.lit("deck\0"), F.col("group").cast("string"), F.lit("\0"), F.floor(F.col("cycle") / F.col("size")).cast("string"))
    dealt = named.withColumn("at", permuted(F.col("cycle") % F.col("size"), F.col("size"), seed, deck)).select("draw", "group", "at")
    return dealt.join(placed, ["group", "at"]).select("draw", F.col("group").alias(group), F.col("member").alias(member))


def weighted_draws(df: DataFrame, key: str, weight: str, needed: int, seed: str) -> DataFrame:
    """(draw, key): each row as often as its largest-remainder share of `needed` by weight, in one permutation of all draws.

    Rows are laid end to end by key, copy k goes to draw `permuted(k)`; a row with very many copies is cut into chunks before
    they are made. key is unique. Weights that are null, negative or not finite are an error; if all are 0 so is the sum.
    """
    w = F.col(weight)
    bad, total = df.agg(F.count_if(~F.coalesce((w >= 0) & (w < float("inf")), F.lit(False))), F.sum(weight)).first()
    if bad or (needed > 0 and not total):
        raise ContractError("weights must be finite, not negative and not all 0")
    if needed <= 0:
        return df.select(F.lit(0).cast("long").alias("draw"), key).limit(0)
    counts = apportion(df.select(key, weight), weight, needed, key, "__draws").where("__draws > 0")
    laid = running_total(counts.select(key, "__draws"), key, "__draws", "__upto")
    chunks = laid.select(key, "__upto", F.explode(F.sequence(F.col("__upto") - F.col("__draws"), F.col("__upto") - 1, F.lit(CHUNK))).alias("__from"))
    copies = chunks.repartition(key, "__from").select(key, F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + (CHUNK - 1), F.col("__upto") - 1))).alias("__k"))
    return copies.select(permuted(F.col("__k"), F.lit(needed), seed, F.lit("order")).alias("draw"), key)
