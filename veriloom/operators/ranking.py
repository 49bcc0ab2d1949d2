"""Rank-shaped operators: distributed positions, percentile ranks, z-scores and top-k labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.session import materialised

#: monotonically_increasing_id keeps the row's place within its partition in the low bits.
ROW_BITS = 33


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names made of `names` that df does not have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(columns: Sequence[str]) -> list[str]:
    """Names that mean the columns as they are called, dots included."""
    return [f"`{c.replace('`', '``')}`" for c in columns]


def _ranged(df: DataFrame, by: Sequence[Column]) -> tuple[DataFrame, str, str]:
    """df sorted by range partitions and materialised, as range bounds must not change between two reads; with the
    names of two columns that are added: the row's number, rising in that order, and its partition's."""
    at, part = unused(df, "__at", "__part")
    placed = materialised(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id()))
    return placed.withColumn(part, F.shiftright(at, ROW_BITS)), at, part


def position_within(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], out: str) -> DataFrame:
    """Adds `out`, the row's 0-based place in its group, without one task per group.

    Rows are range-partitioned and sorted by group and order, so a group that holds most of the table
    spans many tasks; each task's share is counted and the counts are summed up front. Rows that tie on
    every key get neighbouring places. Column names of df are free, but for `out`, which is replaced.
    """
    df = df.drop(out)
    keys = [F.col(c) for c in group]
    placed, at, part = _ranged(df, keys + [F.col(c) if isinstance(c, str) else c for c in order])
    task, first, n, shift, *names = unused(placed, "__task", "__first", "__n", "__shift", *[f"__g{i}" for i in range(len(keys))])
    shares = placed.groupBy(*[k.alias(g) for k, g in zip(keys, names, strict=True)], F.col(part).alias(task)).agg(F.min(at).alias(first), F.count("*").alias(n))
    before = F.sum(n).over(Window.partitionBy(*names).orderBy(task)) - F.col(n)
    shares = shares.withColumn(shift, before - F.col(first)).drop(first, n)
    same = F.col(part) == F.col(task)
    for k, g in zip(group, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(g))
    return placed.join(shares, same).withColumn(out, F.col(at) + F.col(shift)).select(*quoted(df.columns), out)


def running_totals(df: DataFrame, group: Sequence[str], order: str | Column, amounts: Mapping[str, str]) -> DataFrame:
    """Adds {out: amount}'s running sums within the group in the order of a column that is unique there, range by range:
    a group spans as many tasks as it needs."""
    keys = [F.col(c) for c in group]
    placed, at, part = _ranged(df, [*keys, F.col(order) if isinstance(order, str) else order])
    task, *names = unused(placed, "__task", *[f"__g{i}" for i in range(len(keys))], *[f"__s{i}" for i in range(len(amounts))])
    groups, sums = names[: len(keys)], names[len(keys) :]
    shares = placed.groupBy(*[k.alias(g) for k, g in zip(keys, groups, strict=True)], F.col(part).alias(task)).agg(*[F.sum(a).alias(s) for a, s in zip(amounts.values(), sums, strict=True)])
    earlier = Window.partitionBy(*groups).orderBy(task)
    shares = shares.withColumns({s: F.sum(s).over(earlier) - F.col(s) for s in sums})
    same = F.col(part) == F.col(task)
    for k, g in zip(group, groups, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(g))
    here = Window.partitionBy(part, *group).orderBy(at)
    added = {out: F.sum(amount).over(here) + F.col(s) for (out, amount), s in zip(amounts.items(), sums, strict=True)}
    return placed.join(shares, same).withColumns(added).select(*quoted(df.columns), *amounts)


def running_total(df: DataFrame, order: str | Column, amount: str, out: str) -> DataFrame:
    """`running_totals` of one column over the whole table."""
    return running_totals(df, (), order, {out: amount})


def pct_ranks(df: DataFrame, key: str, group: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """(key, each out of {out: value}): percentile rank in the row's group, tied values at their mean: (first rank +
    (ties - 1) / 2) / rows. key is unique.

    All values are melted into one narrow table; its distinct values are counted, placed by range partitions and
    joined back, so no task sorts a group and no wide row is moved.
    """
    melted = F.array(*[F.struct(F.lit(i).alias("which"), F.col(v).alias("x")) for i, v in enumerate(values.values())])
    names = [f"g{i}" for i in range(len(group))]
    long_ = df.select(F.col(key).alias("k"), *[F.col(c).alias(g) for c, g in zip(group, names, strict=True)], F.explode(melted).alias("o")).select("k", *names, "o.which", "o.x")
    parts = [*names, "which"]
    counts = long_.groupBy(*parts, "x").agg(F.count("*").alias("n"))
    placed = running_totals(counts, parts, "x", {"upto": "n"})
    same = lambda a, b, on: reduce(lambda p, q: p & q, [a[c].eqNullSafe(b[c]) for c in on])
    sizes = counts.groupBy(*parts).agg(F.sum("n").alias("all"))
    joined = placed.join(sizes, same(placed, sizes, parts)).select(*[placed[c] for c in parts], "x", ((F.col("upto") - F.col("n") + 1 + (F.col("n") - 1) / 2) / F.col("all")).alias("r"))
    ranked = long_.join(joined, same(long_, joined, [*parts, "x"])).select(long_["k"], long_["which"], "r")
    return ranked.groupBy("k").agg(*[F.max(F.when(F.col("which") == i, F.col("r"))).alias(out) for i, out in enumerate(values)]).withColumnRenamed("k", key)


def pct_rank_whole(df: DataFrame, value: str, out: str) -> DataFrame:
    """The percentile rank of `pct_ranks` over the whole table, joined back by value."""
    v, n, upto = unused(df, "__v", "__n", "__upto")
    counts = df.groupBy(F.col(value).alias(v)).agg(F.count("*").alias(n))
    placed = running_total(counts, v, n, upto)
    total = df.count()
    rank = (F.col(upto) - F.col(n) + 1 + (F.col(n) - 1) / 2) / F.lit(float(max(1, total)))
    return df.join(placed.select(v, rank.alias(out)), F.col(value).eqNullSafe(F.col(v))).drop(v)


def zscores(df: DataFrame, group: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """Adds each out of {out: value}: (x - mean) / sample standard deviation of the row's group; a deviation of 0 or none
    counts as 1. One aggregate per group, joined back; rows are not gathered by group."""
    groups, stats = unused(df, *[f"__g{i}" for i in range(len(group))]), {}
    free = iter(unused(df, *[f"__{kind}{i}" for i in range(len(values)) for kind in ("mean", "dev")]))
    at = {out: (next(free), next(free)) for out in values}
    for out, value in values.items():
        mean, dev = at[out]
        stats |= {mean: F.avg(value), dev: F.coalesce(F.nullif(F.stddev_samp(value), F.lit(0.0)), F.lit(1.0))}
    table = df.groupBy(*[F.col(c).alias(g) for c, g in zip(group, groups, strict=True)]).agg(*[v.alias(k) for k, v in stats.items()])
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(g)) for c, g in zip(group, groups, strict=True)])
    return df.join(table, same).withColumns({out: (F.col(value) - F.col(at[out][0])) / F.col(at[out][1]) for out, value in values.items()}).drop(*groups, *stats)


def zscore_whole(df: DataFrame, value: str, out: str) -> DataFrame:
    """The z-score over the whole table, by one aggregate."""
    mean, deviation = df.agg(F.avg(value), F.stddev_samp(value)).first()
    deviation = deviation if deviation and deviation == deviation else 1.0
    return df.withColumn(out, (F.col(value) - F.lit(mean)) / F.lit(deviation))


def quota(n: int, positives: int = 198, rows: int = 5502) -> int:
    """n * positives / rows, halves up, in whole numbers."""
    return min(n, (2 * n * positives + rows) // (2 * rows))


def prevalence(n: int, share: float) -> int:
    return max(0, min(n, int(n * share + 0.5)))


def medians(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """(group, out): the median of each group's values that are not null, of two the mean. Equal values are counted, the counts
    placed by range partitions, so no task or buffer holds a group."""
    names = [f"g{i}" for i in range(len(group))]
    counts = df.where(F.col(value).isNotNull()).groupBy(*[F.col(c).alias(g) for c, g in zip(group, names, strict=True)], F.col(value).alias("x")).agg(F.count("*").alias("n"))
    placed = running_totals(counts, names, "x", {"upto": "n"})
    sizes = placed.groupBy(*[F.col(g).alias(f"of_{g}") for g in names]).agg(F.sum("n").alias("all"))
    same = reduce(lambda p, q: p & q, [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in names], F.lit(True))
    holds = lambda place: (F.col("upto") - F.col("n") <= place) & (place < F.col("upto"))
    low, high = (F.max(F.when(holds(p), F.col("x"))) for p in (F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)))
    return placed.join(F.broadcast(sizes) if not names else sizes, same).groupBy(*names).agg(((low + high) / 2).alias(out)).withColumnsRenamed(dict(zip(names, group, strict=True)))


def label_top(df: DataFrame, k: int, score: str, tie: str, out: str) -> DataFrame:
    """`out` is 1 for the k rows of highest score, ties to the smaller tie key, else 0; a null score is the lowest. The k-th row
    is found by its place among range partitions and the others are compared with it, so no task sorts the table, nor its
    first k rows."""
    if k <= 0:
        return df.withColumn(out, F.lit(0))
    order = [F.desc_nulls_last("s"), F.asc("t")]
    last = position_within(df.select(F.col(score).alias("s"), F.col(tie).alias("t")), [], order, "at").where(F.col("at") == k - 1).first()
    if last is None:  # there are no more than k
        return df.withColumn(out, F.lit(1))
    if last.s is None:
        inside = F.col(score).isNotNull() | (F.col(tie) <= F.lit(last.t))
    else:
        inside = (F.col(score) > F.lit(last.s)) | ((F.col(score) == F.lit(last.s)) & (F.col(tie) <= F.lit(last.t)))
    return df.withColumn(out, F.coalesce(inside, F.lit(False)).cast("int"))


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; `order` should end in a unique column."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def batch_id(position: str, size: int) -> Column:
    """Number of the batch of `size` that a 0-based position falls into."""
    return F.floor(F.col(position) / size)
