"""Exact top-k inner-product search with ball trees, shard by shard.

Shards are cuts of clusters, so that a shard lies in a small ball too: before any vector is sent anywhere, a query leaves
out all clusters whose ball cannot reach the kth score that it found in its own shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.llm.rows import named
from veriloom.session import materialised

#: Rows of a shard, and queries of a block: what one task holds at once.
SHARD_ROWS, BLOCK_QUERIES = 8192, 4096
#: Clusters at most, and rows (the first in hash order) that their centres are made of at most.
CLUSTERS, SAMPLE = 512, 8192
#: Rows of a leaf.
LEAF = 256
#: Sums of products up to this size are exact in doubles.
_EXACT = 2.0**53


def quantise(df: DataFrame, vector: str, scale: int = 64) -> DataFrame:
    """Replaces `vector` by floor(scale * x) of its components, as longs; rows whose vector is null or holds a
    null or non-finite component go."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.where(F.col(vector).isNotNull() & ~bad).withColumn(
        vector, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    )


class BallTree:
    """Balls over integer vectors: halves along the axis of the largest spread until a leaf holds LEAF rows."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.order = np.arange(len(x))
        self.nodes: list[tuple[np.ndarray, float, int, int, int, int]] = []
        if len(x):
            self._build(0, len(x))

    def _build(self, a: int, b: int) -> int:
        rows = self.x[self.order[a:b]]
        centre = rows.mean(axis=0)
        radius = float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max()))
        me = len(self.nodes)
        self.nodes.append((centre, radius, a, b, -1, -1))
        if b - a > LEAF and radius > 0:
            axis = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(rows[:, axis], mid)]
            left = self._build(a, a + mid)
            right = self._build(a + mid, b)
            self.nodes[me] = (centre, radius, a, b, left, right)
        return me


def search(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, q_rows: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row's place, score) of every query's k best rows but itself (`rows`, `q_rows`: numbers of rows), ties to
    the smaller id.

    Branch and bound for a block of queries at once: a node is entered, best bound first, by the queries whose
    bound centre.q + radius * |q| reaches the kth score that they have so far; all leaves share that score.
    floor: a kth score that each query has from another shard already.
    """
    exact = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1]) < _EXACT
    work = np.float64 if exact else object
    tree = BallTree(x.astype(np.float64))
    xs, qs, qf = x.astype(work), q.astype(work), q.astype(np.float64)
    norm = np.sqrt((qf**2).sum(axis=1))
    none = -np.iinfo(np.int64).max
    known = np.full(len(q), none, np.int64) if floor is None else floor
    best = np.full((len(q), k), none, np.int64)
    row = np.full((len(q), k), -1, np.int64)
    row_id = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)

    def bound(node: int, who: np.ndarray) -> np.ndarray:
        centre, radius = tree.nodes[node][:2]
        top = qf[who] @ centre + radius * norm[who]
        return top + 1e-6 * (1 + np.abs(top) + radius * norm[who])

    def leaf(a: int, b: int, who: np.ndarray) -> None:
        some = tree.order[a:b]
        score = (qs[who] @ xs[some].T).astype(np.int64)
        score[q_rows[who][:, None] == rows[some][None, :]] = none
        held = np.concatenate([best[who], score], axis=1)
        place = np.concatenate([row[who], np.broadcast_to(some, score.shape)], axis=1)
        named = np.concatenate([row_id[who], np.broadcast_to(ids[some], score.shape)], axis=1)
        if held.shape[1] > 4 * k:  # all that reach the kth score stay until ids settle the ties
            kth = np.partition(held, held.shape[1] - k, axis=1)[:, -k]
            most = int((held >= kth[:, None]).sum(axis=1).max())
            if most < held.shape[1]:
                part = np.argpartition(-held, most - 1, axis=1)[:, :most]
                held, place, named = (np.take_along_axis(m, part, 1) for m in (held, place, named))
        sort = np.lexsort((named, -held), axis=1)[:, :k]
        best[who], row[who], row_id[who] = (np.take_along_axis(m, sort, 1) for m in (held, place, named))

    def visit(node: int, who: np.ndarray) -> None:
        _, _, a, b, left, right = tree.nodes[node]
        if left < 0:
            return leaf(a, b, who)
        at_left, at_right = bound(left, who), bound(right, who)
        for first, second, mine in ((left, right, at_left >= at_right), (right, left, at_left < at_right)):
            for child in (first, second):
                some = who[mine]
                some = some[bound(child, some) >= np.maximum(best[some, -1], known[some])] if len(some) else some
                if len(some):
                    visit(child, some)
        return None

    if len(x) and len(q):
        visit(0, np.arange(len(q)))
    who, rank = np.nonzero((row >= 0) & (best > none))
    return who, row[who, rank], best[who, rank]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of longs as rows; shorter ones end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(lists.offsets.to_numpy())
    x = np.zeros((len(lists), int(lengths.max(initial=0))), np.int64)
    x[np.arange(x.shape[1])[None, :] < lengths[:, None]] = lists.flatten().to_numpy()
    return x


def _alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles of one width; missing components are zeros."""
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m.astype(np.float64), ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def centres(sample: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Centres of a sample: rows far from those before, then moved to the means of the rows nearest to them."""
    x = sample.astype(np.float64)
    if not len(x):
        return np.zeros((1, 0))
    chosen, gap = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(clusters, len(x)) and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    c = x[chosen]
    for _ in range(rounds):
        near = np.argmin((c**2).sum(axis=1)[None, :] - 2 * x @ c.T, axis=1)
        sums, counts = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = np.where(counts[:, None] > 0, sums / np.maximum(1, counts)[:, None], c)
    return c


def _place(rows: DataFrame, middle: np.ndarray) -> DataFrame:
    """rows (id, number, x) with the nearest centre (cluster) and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, c = _alike(_matrix(batch.column("x")), middle)
            near = np.argmin((c**2).sum(axis=1)[None, :] - 2 * x @ c.T, axis=1)
            distance = np.sqrt(((x - c[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "number", "x")], pa.array(near.astype(np.int32)), pa.array(distance)], names=["id", "number", "x", "cluster", "distance"])

    return rows.mapInArrow(run, "id long, number long, x array<long>, cluster int, distance double")


def _reach(asking: DataFrame, middle: np.ndarray, radius: np.ndarray) -> DataFrame:
    """asking (id, number, x, block, cluster, sub, floor) once for each cluster (target) whose ball reaches the floor."""
    names = ["id", "number", "x", "block", "cluster", "sub", "floor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, c = _alike(_matrix(batch.column("x")), middle)
            norm = np.sqrt((q**2).sum(axis=1))[:, None]
            top = q @ c.T + radius[None, :] * norm
            top += 1e-6 * (1 + np.abs(top) + radius[None, :] * norm)
            floor = pc.fill_null(batch.column("floor"), -np.iinfo(np.int64).max).to_numpy()
            who, target = np.nonzero((top >= floor[:, None]) & (radius >= 0)[None, :])
            for a in range(0, len(who), 1 << 14):
                part = batch.select(names).take(pa.array(who[a : a + (1 << 14)]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(target[a : a + (1 << 14)].astype(np.int32))], names=[*names, "target"])

    return asking.mapInArrow(run, "id long, number long, x array<long>, block int, cluster int, sub int, floor long, target int")


def top_k(
    df: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, clusters: int = CLUSTERS
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose key is divisible by `every`, its k best other rows.

    Rows belong to the nearest of some centres, made of a bounded sample; a cluster is cut by hash into shards of about
    shard_rows, and queries are put in blocks of about block_queries, those of a cluster together. Each pair of block and
    shard that is asked is one ball-tree search. A query first searches its own shard; its kth score from there
    goes with it to the shards of the clusters whose ball can reach it, and the k best of all are merged. Vectors are
    copied only to the blocks that ask their cluster. Ties go to the smaller key. Vectors that
    are null or hold null or non-finite components take no part, nor do rows without a key; rows that repeat a key are
    rows of their own, as queries and as candidates, of each other too; a shorter vector counts as ended by zeros. An
    empty table gives an empty result. All rows are scored or bounded away; nothing is capped.
    """
    spark = df.sparkSession
    rows = quantise(df.select(named(key).alias("id"), named(vector).alias("x")).where("id is not null"), "x", scale)
    rows = materialised(rows.withColumn("number", F.monotonically_increasing_id()))
    wanted = min(clusters, max(1, -(-rows.count() // shard_rows)))
    middle = np.zeros((1, 0))
    if wanted > 1:
        middle = centres(_matrix(rows.orderBy(F.xxhash64("number"), "number").limit(SAMPLE).select("x").toArrow().column("x")), wanted)
    placed = materialised(_place(rows, middle))
    sizes = placed.groupBy("cluster").agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.max("distance")).collect()
    radius, layout, block, room = np.full(len(middle), -1.0), [], 0, block_queries
    for cluster, n, n_queries, most in sorted(sizes):
        radius[cluster] = most * (1 + 1e-9)
        if n_queries > room:  # small clusters share a block, a large one has some of its own
            block, room = block + 1, block_queries
        n_blocks = max(1, -(-n_queries // block_queries))
        layout.append((cluster, max(1, -(-n // shard_rows)), block, n_blocks))
        block, room = block + n_blocks - 1, (room - n_queries if n_blocks == 1 else 0)
    layout = F.broadcast(spark.createDataFrame(layout, "cluster int, subs int, first int, n_blocks int"))
    held = placed.join(layout, "cluster").withColumns(
        {"sub": F.pmod(F.xxhash64("number"), F.col("subs")).cast("int"), "block": (F.col("first") + F.pmod(F.xxhash64(F.lit(1), "number"), F.col("n_blocks"))).cast("int")}
    )
    asking = held.where(F.col("id") % every == 0)
    none = -np.iinfo(np.int64).max

    def run(table: pa.Table) -> pa.Table:
        query = table.column("query").to_numpy(zero_copy_only=False)
        ids, number = table.column("id").to_numpy(), table.column("number").to_numpy()
        x = _matrix(table.column("x"))
        floor = pc.fill_null(table.column("floor"), none).to_numpy()
        who, row, score = search(x[~query], ids[~query], number[~query], x[query], number[query], k, floor[query])
        return pa.table({"query": number[query][who], "query_id": ids[query][who], "vec_id": ids[~query][row], "score": score.astype(np.int64)})

    def ask(searched: DataFrame, asked: DataFrame) -> DataFrame:
        """Both have id, number, x, block, cluster and sub; those asked a floor too."""
        columns = ["id", "number", "x", "block", "cluster", "sub"]
        both = searched.select(*columns, F.lit(False).alias("query"), F.lit(None).cast("long").alias("floor")).union(asked.select(*columns, F.lit(True), "floor"))
        return both.groupBy("block", "cluster", "sub").applyInArrow(run, "query long, query_id long, vec_id long, score long")

    own_blocks = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n_blocks") - 1)).alias("block")
    home = ask(held.drop("block").select("id", "number", "x", "cluster", "sub", own_blocks), asking.withColumn("floor", F.lit(None).cast("long")))
    if len(sizes) > 1 or any(n > shard_rows for _, n, *_ in sizes):
        home = materialised(home)
        kth = home.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        told = asking.join(kth, F.col("number") == F.col("query"), "left").select("id", "number", "x", "block", "cluster", "sub", "floor")
        reached = _reach(told, middle, radius).join(layout.select(F.col("cluster").alias("target"), "subs"), "target")
        each = F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("at")
        away = materialised(reached.select("id", "number", "x", "block", "floor", "target", "cluster", "sub", each).where("target <> cluster or at <> sub"))
        asked = away.select("id", "number", "x", "block", F.col("target").alias("cluster"), F.col("at").alias("sub"), "floor")
        pairs = asked.select("block", "cluster", "sub").distinct()
        home = home.union(ask(held.drop("block").join(pairs, ["cluster", "sub"]), asked))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return home.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
