"""Merkle manifest of a dataset: a node store in Parquet by level, built run by run, and proofs scanned from it."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm.rows import named
from veriloom.llm.sharding import crc_table
from veriloom.llm.textbytes import grouped
from veriloom.operators.ranking import position_within
from veriloom.session import checkpoint_dir, materialised

#: Levels that one pass over a run adds; a run is 2 ** RUN consecutive nodes of the level that the pass reads.
RUN = 10

_NODES = "tree string, level int, idx long, digest string"


def field(value: Column) -> Column:
    """A value as it goes into a leaf: `-` if null, else the UTF-8 bytes' count, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row's values in their order."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _grow(nodes: DataFrame, base: int) -> DataFrame:
    """Levels base + 1 to base + RUN above the nodes (tree, idx, digest) of level `base`. A node is the digest of two, the last
    one of a level of one alone; a tree ends where one node is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["tree", "run"]):
            tree, number, held = t["tree"][0].as_py(), t["run"][0].as_py(), t["digest"].to_pylist()
            alone = number == 0 and len(held) < 1 << RUN  # then no other run can follow, and the tree ends here
            out: list[tuple[int, int, str]] = []
            for up in range(1, RUN + 1):
                if alone and len(held) == 1:
                    break
                held = [_digest(*held[i : i + 2]) for i in range(0, len(held), 2)]
                out += [(base + up, (number << (RUN - up)) + i, d) for i, d in enumerate(held)]
            names = ["tree", "level", "idx", "digest"]
            columns = [pa.array([tree] * len(out), pa.string()), pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    runs = nodes.select("tree", F.shiftright("idx", RUN).alias("run"), "idx", "digest")
    return runs.repartition("tree", "run").sortWithinPartitions("tree", "run", "idx").mapInArrow(run, _NODES)


def build(leaves: DataFrame, folder: str) -> int:
    """Writes the trees over leaves (tree, idx, digest, ...) to folder/level=N and returns the highest level that any has.

    Leaves are written as they are, with whatever columns they have. A pass reads one level, run by run, and writes the RUN
    levels above it: n leaves have some 2n nodes, written in log(n) / RUN passes. idx counts from 0 without gaps in each tree; no
    tree name is null; without leaves level 0 is empty.
    """
    leaves.write.parquet(f"{folder}/level=0")
    spark = leaves.sparkSession
    most = level(spark, folder, 0).groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    highest = (most - 1).bit_length()
    for base in range(0, highest, RUN):
        _grow(level(spark, folder, base), base).write.mode("append").partitionBy("level").parquet(folder)
    return highest


def level(spark: SparkSession, folder: str, n: int) -> DataFrame:
    """Nodes (tree, idx, digest, ...) of one level of a store; level 0 has the columns that the leaves came with."""
    return spark.read.parquet(f"{folder}/level={n}")


def _nodes(spark: SparkSession, folder: str, levels: range) -> DataFrame:
    return reduce(DataFrame.unionByName, [level(spark, folder, n).select("tree", F.lit(n).alias("level"), "idx", "digest") for n in levels])


def tops(spark: SparkSession, folder: str, highest: int) -> DataFrame:
    """(tree, height, digest): the node that remains of each tree."""
    nodes = _nodes(spark, folder, range(highest + 1))
    return nodes.groupBy("tree").agg(F.max("level").alias("height"), F.max_by("digest", "level").alias("digest"))


#: Kinds of rows of a run, in the order of a scan.
_OVER, _NODE, _ASKED = 0, 1, 2


def _climb(asked: DataFrame, nodes: DataFrame, over: DataFrame, base: int) -> DataFrame:
    """asked (tree, idx, row) of level `base` with `path`, the siblings from there to the root: those within the run, then what
    `over` (tree, run, path) says of the run itself. One scan merges the three in the order of their coordinates."""
    row = asked.schema["row"].dataType.simpleString()
    none = lambda kind: F.lit(None).cast(kind)
    rows = over.select("tree", "run", F.lit(_OVER).alias("kind"), none("int").alias("level"), none("long").alias("idx"), none("string").alias("digest"), "path", none(row).alias("row"))
    run = F.shiftright("idx", RUN)
    below = F.expr(f"shiftright(idx, {RUN + base} - level)")
    rows = rows.union(nodes.select("tree", below, F.lit(_NODE), "level", "idx", "digest", none("array<string>"), none(row)))
    rows = rows.union(asked.select("tree", run, F.lit(_ASKED), none("int"), "idx", none("string"), none("array<string>"), "row"))
    rows = rows.repartition("tree", "run").sortWithinPartitions("tree", "run", "kind", "level", "idx")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, above, held = None, [], []
        for batch in batches:
            trees, runs, kinds = (batch.column(c).to_pylist() for c in ("tree", "run", "kind"))
            levels, places, digests, paths = (batch.column(c).to_pylist() for c in ("level", "idx", "digest", "path"))
            found, taken = [], []
            for i, key in enumerate(zip(trees, runs, strict=True)):
                if key != here:
                    here, above, held = key, [], []
                if kinds[i] == _OVER:
                    above = paths[i]
                elif kinds[i] == _NODE:
                    if levels[i] - base == len(held):
                        held.append([])
                    held[-1].append(digests[i])
                else:
                    at = places[i] - (key[1] << RUN)
                    if not held or at >= len(held[0]):
                        raise ValueError(f"no node {places[i]} in level {base} of the tree {key[0]!r}")
                    found.append(_siblings(held, at, key[1] == 0 and len(held[0]) < 1 << RUN) + above)
                    taken.append(i)
            if taken:
                rows = batch.take(pa.array(taken))
                yield pa.RecordBatch.from_arrays([rows.column("tree"), rows.column("idx"), rows.column("row"), pa.array(found, pa.list_(pa.string()))], names=["tree", "idx", "row", "path"])

    return rows.mapInArrow(scan, f"tree string, idx long, row {row}, path array<string>")


def _siblings(held: list[list[str]], at: int, alone: bool) -> list[str]:
    """What stands beside the node at a place of a run and beside those above it, within the run: `<` and the digest to
    its left, `>` and that to its right, or nothing."""
    out = []
    for nodes in held:
        if alone and len(nodes) == 1:
            break
        beside = at ^ 1
        out.append("" if beside >= len(nodes) else ("<" if at & 1 else ">") + nodes[beside])
        at >>= 1
    return out


def proofs(spark: SparkSession, folder: str, highest: int, asked: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """asked (tree, idx, row), leaves by coordinate, with `path`: what stands beside them and their ancestors, from the leaf
    up. `ends` (tree, height, path) goes on from the top of each tree.

    Paths are made from the top down: a pass gives those of the nodes that are the runs of the pass below, so only the
    last one moves leaves, and each leaf moves once.
    """
    if ends is None:
        ends = tops(spark, folder, highest).select("tree", "height", F.array().cast("array<string>").alias("path"))
    stems = None
    for base in range(highest // RUN * RUN, -1, -RUN):
        over = ends.where(F.floor(F.col("height") / RUN) == base // RUN).select("tree", F.lit(0).cast("long").alias("run"), "path")
        if stems is not None:
            over = over.union(stems.select("tree", F.col("idx"), "path"))
        rows = asked if base == 0 else level(spark, folder, base).select("tree", "idx", F.struct(F.lit(True).alias("none")).alias("row"))
        stems = _climb(rows, _nodes(spark, folder, range(base, min(base + RUN, highest + 1))), over, base)
        if base:
            stems = materialised(stems)
    return stems


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    beside = lambda s: F.substring(s, 2, 64)
    return F.aggregate(path, start, lambda h, s: F.sha2(F.when(F.startswith(s, F.lit("<")), F.concat(beside(s), h)).otherwise(F.concat(h, beside(s))), 256))


def siblings(path: Column) -> Column:
    """The digests of a proof, joined from the leaf up."""
    return F.array_join(F.transform(path, lambda s: F.substring(s, 2, 64)), "")


def _tops_of(path: Column, subroot: bool) -> Column:
    return F.filter(path, lambda s: F.startswith(s, F.lit("=")) == F.lit(subroot))


def manifest(df: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", tree: str = "lang", present: tuple[Column, ...] = (), folder: str | None = None) -> tuple[DataFrame, str | None]:
    """Proofs of all rows (tree, idx, key, leaf, present, subroot, path), and the root.

    A leaf is the digest of the row's `fields`; the leaves of a `tree` ascend by key, rows of one key by their digest. Its
    nodes are the digests of two each, the last of one alone if their number is odd; what remains is its subroot, and the
    subroots, by name (null first), are the leaves of the dataset's tree. `present` are the values that are there now, in
    the order of `fields`: their leaf comes as `present`, by default the same. A null value counts as `-`, so null and
    empty texts differ; null keys come first; repeated rows have equal leaves of their own; very long texts are hashed by the JVM
    and never moved; other columns of df are not read; an empty table has no rows and the root None. Stores are in
    `folder`/trees and `folder`/whole, and stay there.
    """
    spark = df.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/manifest-{uuid.uuid4().hex}"
    values = [named(f) for f in fields]
    name = F.coalesce(F.concat(F.lit("="), named(tree).cast("string")), F.lit(""))
    rows = df.select(name.alias("tree"), named(key).alias("key"), leaf(*values).alias("digest"), leaf(*(present or values)).alias("present"))
    placed = position_within(rows, ["tree"], ["key", "digest"], "idx").withColumn("idx", F.col("idx").cast("long"))
    highest = build(placed, f"{folder}/trees")
    found = materialised(tops(spark, f"{folder}/trees", highest))
    whole = position_within(found.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "height", "digest"), ["tree"], ["of"], "idx")
    top = build(whole.withColumn("idx", F.col("idx").cast("long")), f"{folder}/whole")
    root = tops(spark, f"{folder}/whole", top).first()
    subtrees = level(spark, f"{folder}/whole", 0).select("tree", "idx", F.struct("of", "height", "digest").alias("row"))
    ends = materialised(proofs(spark, f"{folder}/whole", top, subtrees).select(F.col("row.of").alias("tree"), "row.height", F.concat(F.array(F.concat(F.lit("="), F.col("row.digest"))), "path").alias("path")))
    asked = level(spark, f"{folder}/trees", 0).select("tree", "idx", F.struct("key", "digest", "present").alias("row"))
    rows = proofs(spark, f"{folder}/trees", highest, asked, ends)  # a subroot stands in its rows' paths, marked by `=`
    subroot = F.substring(F.get(_tops_of(F.col("path"), True), F.lit(0)), 2, 64).alias("subroot")
    out = rows.select("tree", "idx", "row.key", F.col("row.digest").alias("leaf"), "row.present", subroot, _tops_of(F.col("path"), False).alias("path"))
    return out, root and root["digest"]


def manifest_sql(step: int = 7) -> str:
    """DuckDB SQL of the query's rows over `documents`."""
    hashed = lambda n_chars: "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"
    up = "[sha256(nodes[2 * j + 1] || coalesce(nodes[2 * j + 2], '')) FOR j IN range(0, (len(nodes) + 1) // 2)]"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, crcs[1 + (xor(c, x) & 255)])), 4294967295)"
    return f"""
WITH RECURSIVE l AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS t, {hashed("n_chars")} AS leaf,
  {hashed(f"(n_chars + CASE WHEN {crc} % {step} = 0 THEN 1 ELSE 0 END)")} AS present FROM documents, (SELECT {crc_table()}::BIGINT[] AS crcs)),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
n(t, level, nodes) AS (SELECT t, 0, list(leaf ORDER BY i) FROM p GROUP BY t UNION ALL SELECT t, level + 1, {up} FROM n WHERE len(nodes) > 1),
s AS (SELECT t, nodes[1] AS subroot, row_number() OVER (ORDER BY t) - 1 AS k FROM n WHERE len(nodes) = 1),
q(level, nodes) AS (SELECT 0, list(subroot ORDER BY k) FROM s UNION ALL SELECT level + 1, {up} FROM q WHERE len(nodes) > 1),
m AS MATERIALIZED (SELECT t, level, unnest(nodes) AS digest, unnest(range(len(nodes))) AS idx FROM n WHERE len(nodes) > 1),
v AS MATERIALIZED (SELECT level, unnest(nodes) AS digest, unnest(range(len(nodes))) AS idx FROM q WHERE len(nodes) > 1),
b AS (SELECT r, x.level AS place, (i >> x.level) & 1 AS side, m.digest FROM p JOIN (SELECT DISTINCT t, level FROM m) x ON x.t = p.t LEFT JOIN m ON m.t = p.t AND m.level = x.level AND m.idx = xor(i >> x.level, 1)
  UNION ALL SELECT r, 1000 + x.level, (k >> x.level) & 1, v.digest FROM p JOIN s ON s.t = p.t JOIN (SELECT DISTINCT level FROM v) x ON true LEFT JOIN v ON v.level = x.level AND v.idx = xor(k >> x.level, 1)),
o AS (SELECT r, list(CASE WHEN digest IS NULL THEN '' WHEN side = 1 THEN '<' || digest ELSE '>' || digest END ORDER BY place) AS path FROM b GROUP BY r),
f AS (SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM q WHERE len(nodes) = 1) AS root, coalesce(path, []) AS path, present FROM p JOIN s ON s.t = p.t LEFT JOIN o ON o.r = p.r),
g AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: substr(x, 2)), '')) AS proof_sha256,
  list_reduce(list_prepend(present, path), lambda h, x: sha256(CASE WHEN x[1] = '<' THEN substr(x, 2) || h ELSE h || substr(x, 2) END)) AS folded_root FROM f)
SELECT *, folded_root = root AS verified FROM g"""
