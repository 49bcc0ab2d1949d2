"""Systematic sampling of documents so that sources meet target weights."""

from __future__ import annotations

from math import floor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.rows import named, packed
from veriloom.operators.ranking import position_within, running_totals
from veriloom.session import materialised

#: Words, in full: other than space and the controls from tab to carriage return.
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text column (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """sizes (source, source_size), one row a source, with the words (target) that each should give.

    Sources in code-point order, null last, take the weights in turn and share the total; a target stops at `cap` times
    its source's size and the excess is shared anew by weight among the others until none is above. Those that stop are the
    first by their size per weight, each held against what is left when those before it have stopped, so running sums find
    them. Sources may be many: they are placed by ranges.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = position_within(sizes, [], [F.col("source").asc_nulls_last()], "place").withColumn("weight", weight)
    rows = rows.withColumns({"most": F.lit(float(cap)) * F.col("source_size"), "by": F.struct(F.col("source_size") / F.col("weight"), F.col("place"))})
    total, share = materialised(sizes).agg(F.sum("source_size")).first()[0] or 0, rows.agg(F.sum("weight")).first()[0] or 0.0
    rows = running_totals(rows, (), "by", {"most_upto": "most", "weight_upto": "weight"})
    left = F.lit(float(total)) - (F.col("most_upto") - F.col("most"))
    among = F.lit(float(share)) - (F.col("weight_upto") - F.col("weight"))
    rows = materialised(rows.withColumn("stops", left * F.col("weight") / among > F.col("most")))
    stopped, of = rows.where("stops").agg(F.coalesce(F.sum("most"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    rest = F.lit(float(total) - stopped) * F.col("weight") / F.lit(share - of)
    return rows.select("source", "source_size", F.when(F.col("stops"), F.col("most")).otherwise(rest).alias("target"))


def offset(seed: int, source: Column) -> Column:
    """A number in [0, 1) for a source, the same in every run, of 20 bits, so that sums with whole rates are exact."""
    name = F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}|0|"), name), 256), 1, 5)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 20))


def rates(target: float, source_size: int, start: float, groups: list[tuple[int, int]], cap: float = 3.0) -> list[tuple[float, float]]:
    """(prefix sum before the group, expected copies of each of its documents) for (size, documents), largest size first.

    A group's expected copies are what is still to be taken over what is still there, so that the words that the whole copies
    of the larger documents took too many or too few are made up by the smaller ones. Documents without words go by the
    source's own rate.
    """
    out, upto, taken, left = [], start, 0, source_size
    for size, n in groups:
        words, of = (target - taken, left) if size else (target, source_size)
        rate = min(cap, max(0.0, words / of)) if of else 0.0
        out.append((upto, rate))
        after = upto + rate * n
        taken += (floor(after) - floor(upto)) * size
        upto, left = after, left - size * n
    return out


def _rates(sizes: DataFrame, goals: DataFrame, seed: int, cap: float) -> DataFrame:
    """(of, of_size, target, source_size, upto, rate) of each source and size. A source's sizes are one task's: n different sizes
    hold n * n / 2 words at least, so they stay few."""
    asked = sizes.join(goals, F.col("source").eqNullSafe(F.col("of")))
    asked = asked.select("of", "source_size", "target", offset(seed, F.col("of")).alias("start"), "size", "n")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending")])
        first = t.slice(0, 1).to_pylist()[0]
        found = rates(first["target"], first["source_size"], first["start"], list(zip(t["size"].to_pylist(), t["n"].to_pylist(), strict=True)), cap)
        columns = [t["of"], t["size"], t["target"], t["source_size"], pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())]
        return pa.table(columns, names=["of", "of_size", "target", "source_size", "upto", "rate"])

    return asked.groupBy("of").applyInArrow(run, "of string, of_size long, target double, source_size long, upto double, rate double")


def mix_sources(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 17, weights: tuple[float, ...] = (5, 2, 1), keep: tuple[str, ...] = (), cap: float = 3.0) -> DataFrame:
    """(key, `keep`, source, size, source_size, target, copies, taken) for every row of df.

    Expected copies are summed up front over the source's documents, largest first, ties by key and text hash, from one random
    offset per source; a document is emitted once for each whole number that its span of the sum crosses, `cap` times at most.
    Expected copies are target / source_size at first; documents of the next size share out what is then left (`rates`), so
    the words taken miss the target by no more than the last sizes can make up: at most by the source's largest document, and
    mostly by a few words.
    Documents of size 0 take no words. Null sources are one source; null keys and repeated rows count as
    rows; texts are counted whole, whatever their length; an empty table gives an empty result; columns of `keep` with the names
    of the result's are left out. Nothing is collected but totals.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in dict.fromkeys(keep) if c not in (*added, key, source)]
    rows = df.select(named(key).alias("key"), named(source).cast("string").alias("source"), word_count(named(text)).alias("size"), F.xxhash64(named(text)).alias("h"), packed(kept))
    if not kept:  # narrow rows are written once, so that words are counted once
        rows = materialised(rows)
    sizes = materialised(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    goals = targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, cap).withColumnRenamed("source", "of")
    per_size = materialised(_rates(sizes, goals, seed, cap))
    placed = position_within(rows, ["source", "size"], ["key", "h"], "i")
    joined = placed.join(per_size, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size")))
    crossed = F.floor(F.col("upto") + F.col("rate") * (F.col("i") + 1)) - F.floor(F.col("upto") + F.col("rate") * F.col("i"))
    copies = F.least(crossed, F.lit(int(cap))).cast("int")
    out = joined.withColumns({"copies": copies, "taken": (copies * F.col("size")).cast("long")})
    return out.select(F.col("key").alias(key), *[F.col("row").getField(c).alias(c) for c in kept], F.col("source").alias(source), *added)


def mixing_sql(seed: int = 17) -> str:
    """DuckDB SQL of the query's rows over `documents`: the sizes of a source are gone through by recursion."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
o AS (SELECT *, sum(weight) OVER w AS left_weight, (SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_total
  FROM s WINDOW w AS (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c AS (SELECT *, left_total * weight / left_weight > 3.0::DOUBLE * source_size AS capped FROM o),
f AS (SELECT (SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) FILTER (capped), 0) AS total, sum(weight) FILTER (NOT capped) AS share FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN 3.0::DOUBLE * source_size ELSE total * weight / share END AS target,
  ('0x' || substr(sha256('{seed}|0|' || coalesce('s' || source, 'null')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u FROM c, f),
g AS MATERIALIZED (SELECT source, size, n, row_number() OVER (PARTITION BY source ORDER BY size DESC) AS k FROM (SELECT source, size, count(*) AS n FROM d GROUP BY ALL)),
r(source, source_size, target, k, size, n, upto, rate, taken, gone) AS (
  SELECT t.source, t.source_size, t.target, g.k, g.size, g.n, u, CASE WHEN t.source_size > 0 THEN least(3.0::DOUBLE, greatest(0.0::DOUBLE, t.target / t.source_size)) ELSE 0.0::DOUBLE END, 0::BIGINT, 0::BIGINT
  FROM t JOIN g ON g.source IS NOT DISTINCT FROM t.source AND g.k = 1
  UNION ALL SELECT source, source_size, target, k, size, n, upto,
    CASE WHEN size = 0 AND source_size > 0 THEN least(3.0::DOUBLE, target / source_size) WHEN source_size > gone THEN least(3.0::DOUBLE, greatest(0.0::DOUBLE, (target - taken) / (source_size - gone))) ELSE 0.0::DOUBLE END, taken, gone
  FROM (SELECT r.source, source_size, target, g.k, g.size, g.n, upto + rate * r.n AS upto, taken + ((floor(upto + rate * r.n) - floor(upto)) * r.size)::BIGINT AS taken, (gone + r.size * r.n)::BIGINT AS gone
        FROM r JOIN g ON g.source IS NOT DISTINCT FROM r.source AND g.k = r.k + 1)),
p AS (SELECT doc_id, d.source, d.size, source_size, target, upto, rate, row_number() OVER (PARTITION BY d.source, d.size ORDER BY doc_id) - 1 AS i FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.size = r.size),
x AS (SELECT *, least(floor(upto + rate * (i + 1)) - floor(upto + rate * i), 3)::INT AS copies FROM p)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, source, copies FROM x"""
