"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.session import materialised


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 200) -> DataFrame:
    """(node, component) for every node that an edge names; component is the smallest node that edges reach.

    Each round contracts: every node hangs on to the smallest label around it, labels are followed one
    step further, and edges are renamed to labels, which drops those inside a component. The edge table
    shrinks at every round, and no node's neighbours are ever gathered. Null ends are ignored; self-loops
    only name a node.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    live = materialised(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    nodes = live.select(F.col("u").alias("node")).union(live.select("v")).distinct()
    live = live.where("u <> v")
    hops: list[DataFrame] = []
    while not live.isEmpty():
        if len(hops) == rounds:
            raise RuntimeError(f"components did not settle within {rounds} rounds")
        both = live.select(F.col("u").alias("node"), F.col("v").alias("other")).union(live.select("v", "u"))
        # Written before it is followed: the join's tasks can then be split at a label that many nodes have.
        near = materialised(both.groupBy("node").agg(F.min("other").alias("near")).select("node", F.least("node", "near").alias("to")))
        hop = materialised(_follow(near, near))
        hops.append(hop)
        at_u = hop.select(F.col("node").alias("u"), F.col("to").alias("a"))
        at_v = hop.select(F.col("node").alias("v"), F.col("to").alias("b"))
        moved = live.join(at_u, "u").join(at_v, "v").where("a <> b")
        live = materialised(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    if not hops:
        return nodes.select("node", F.col("node").alias("component"))
    labels = hops.pop()
    while hops:
        labels = _follow(hops.pop(), labels)
    return nodes.join(labels, "node", "left").select("node", F.coalesce("to", "node").alias("component"))


def _follow(hop: DataFrame, further: DataFrame) -> DataFrame:
    """Each node's label, replaced by that label's own where it has one."""
    next_ = further.select(F.col("node").alias("to"), F.col("to").alias("further"))
    return hop.join(next_, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
