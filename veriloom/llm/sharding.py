"""Hierarchical weighted hash tree: rows descend region, rack and shard levels by weighted hash draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.rows import named
from veriloom.operators.ranking import position_within

#: A tree is {region: {rack: {shard: weight}}}.
Tree = dict[str, dict[str, dict[int, float]]]

#: Hex digits of an MD5 that make a draw: 52 bits, exact in a double.
_DIGITS = 13


def tree(n_shards: int, base: int = 24, regions: int = 2, racks: int = 3) -> Tree:
    """Shards 0..n-1 of equal weight. The first `base` fill regions x racks evenly; each further shard
    comes as a region of its own, so what it draws away lands nowhere else."""
    out: Tree = {}
    per_rack = max(1, -(-base // (regions * racks)))
    for s in range(min(n_shards, base)):
        rack = s // per_rack
        out.setdefault(f"r{rack // racks}", {}).setdefault(f"k{rack % racks}", {})[s] = 1.0
    for s in range(base, n_shards):
        out[f"x{s}"] = {"k0": {s: 1.0}}
    return out


def _draw(key: Column, node: str, weight: float) -> Column:
    """The node's draw: exponential with rate `weight`, decided by key and node name alone; the least wins."""
    u = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{node}"))), 1, _DIGITS), 16, 10).cast("double")
    return -F.log((u + 0.5) / float(16**_DIGITS)) / F.lit(float(weight))


def _pick(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the least draw."""
    if len(children) == 1:
        return children[0][2]
    drawn = [F.struct(_draw(key, name, w).alias("d"), v.alias("v")) for name, w, v in children]
    return F.least(*drawn).getField("v")


def shard_of(key: Column, nodes: Tree) -> Column:
    """The shard of `key`. A node's weight is the sum of its shards' weights, so a draw at one level moves
    only keys that the changed subtree gains or loses. A null key counts as the text "null"."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    regions = []
    for region, racks in nodes.items():
        below = []
        for rack, shards in racks.items():
            leaf = _pick(key, [(f"{region}/{rack}/{s}", w, F.lit(s)) for s, w in shards.items()])
            below.append((f"{region}/{rack}", sum(shards.values()), leaf))
        weight = sum(sum(s.values()) for s in racks.values())
        regions.append((region, weight, below))
    # Regions are drawn first; racks are drawn only inside the region that won.
    winner = _pick(key, [(name, w, F.lit(i)) for i, (name, w, _) in enumerate(regions)])
    out = F.lit(None).cast("int")
    for i, (_, _, below) in enumerate(regions):
        out = F.when(winner == i, _descend(key, below)).otherwise(out)
    return out.cast("int")


def _descend(key: Column, below: list[tuple[str, float, Column]]) -> Column:
    winner = _pick(key, [(name, w, F.lit(i)) for i, (name, w, _) in enumerate(below)])
    out = F.lit(None).cast("int")
    for i, (_, _, leaf) in enumerate(below):
        out = F.when(winner == i, leaf).otherwise(out)
    return out


def shard(df: DataFrame, n_shards: int = 24, key: str = "doc_id", text: str = "text", base: int = 24) -> DataFrame:
    """Adds size, law, shard and grown_shard to every row; `with_slots` numbers them.

    Law `key`: the key and the shard count decide the shard; with one more shard (`grown_shard`) a row
    stays or moves into the new shard. `base` is the count that the cluster started with, and stays as it is when
    n_shards grows: with 25 shards a row is where grown_shard says it is with 24. size is the UTF-8 length of the text (null: 0) plus 8. A slot numbers
    a shard's rows from 0 without gaps, by key and text. Null keys share one shard; repeated rows share
    their shard and take neighbouring slots; a text of any length is only measured; an empty table gives an empty result.
    Columns of `df` with the names that are added are replaced.
    """
    if n_shards < base:
        raise ValueError(f"{n_shards} shards are fewer than the base of {base}")
    added = ("size", "law", "shard", "grown_shard")
    return df.select(
        *[named(c) for c in df.columns if c not in added],
        (F.coalesce(F.octet_length(named(text)), F.lit(0)).cast("long") + F.lit(8)).alias("size"),
        F.lit("key").alias("law"),
        shard_of(named(key), tree(n_shards, base)).alias("shard"),
        shard_of(named(key), tree(n_shards + 1, base)).alias("grown_shard"),
    )


def with_slots(rows: DataFrame, key: str = "doc_id", ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds slot, by key within the shard; `rows` should be narrow, as they are sorted."""
    return position_within(rows, ["shard"], [key, *ties], "slot").withColumn("slot", F.col("slot").cast("long"))


def crc_table() -> list[int]:
    """The 256 remainders of CRC-32, by its rule."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def shard_sql(n_shards: int = 24, base: int = 24) -> str:
    """DuckDB SQL for the query's rows: every draw of every level and tree, and the least at each."""
    nodes = []
    for grown, nodes_of in ((False, tree(n_shards, base)), (True, tree(n_shards + 1, base))):
        for i, (region, racks) in enumerate(nodes_of.items()):
            of_region = sum(sum(s.values()) for s in racks.values())
            for j, (rack, shards) in enumerate(racks.items()):
                nodes += [f"({grown}, '{region}', {i}, {of_region}, '{region}/{rack}', {j}, {sum(shards.values())}, '{region}/{rack}/{s}', {s}, {w})" for s, w in shards.items()]
    draw = lambda node, weight: f"-ln((('0x' || substr(md5(k || '|' || {node}), 1, {_DIGITS}))::BIGINT + 0.5::DOUBLE) / {16**_DIGITS}.0::DOUBLE) / {weight}::DOUBLE"
    pick = lambda columns, node, weight, order: f"SELECT r, k, grown, {columns} FROM (SELECT *, row_number() OVER (PARTITION BY r, grown ORDER BY {draw(node, weight)}, {order}) AS n FROM %s) WHERE n = 1"
    return f"""
WITH leaves(grown, region, ri, rw, rack, ki, kw, leaf, shard, sw) AS (VALUES {", ".join(nodes)}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(strlen(text), 0)::BIGINT + 8 AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents),
regions AS ({pick("region", "region", "rw", "ri") % "(SELECT r, k, l.* FROM d, (SELECT DISTINCT grown, region, ri, rw FROM leaves) l)"}),
racks AS ({pick("rack", "rack", "kw", "ki") % "(SELECT r, k, l.* FROM regions x JOIN (SELECT DISTINCT grown, region, rack, ki, kw FROM leaves) l USING (grown, region))"}),
shards AS ({pick("shard", "leaf", "sw", "shard") % "(SELECT r, k, l.* FROM racks x JOIN leaves l USING (grown, rack))"}),
crc AS (SELECT r, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(b, lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS text_crc32 FROM d, (SELECT {crc_table()}::BIGINT[] AS t)),
s AS (SELECT doc_id, size, text_crc32, 'key' AS law, a.shard::INT AS shard, b.shard::INT AS grown_shard FROM d JOIN crc USING (r) JOIN shards a ON a.r = d.r AND NOT a.grown JOIN shards b ON b.r = d.r AND b.grown)
SELECT *, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot FROM s"""
