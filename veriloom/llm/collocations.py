"""Phrase collocations: depth-limited count tries per shard, merged by prefix range; their walks and links give the parts."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.rows import named
from veriloom.operators.ranking import position_within
from veriloom.session import bound_batches, materialised

#: Words of one trie, and bytes of text that are cut into words at once; both bound a task's memory.
TRIE_WORDS, CUT_BYTES = 1 << 21, 4 << 20

#: Bytes of text whose share of all tries is merged by one task, and sampled paths per range (a million in all at most).
RANGE_BYTES, SAMPLED, MOST_SAMPLED = 8 << 20, 100, 1_000_000

#: Bytes that end a piece ([.,;:!?\x0A-\x0D]) become line breaks, those between words ([\x20\x09]) spaces; A-Z small letters.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")

#: One trie's nodes level by level: sorted keys (parent's index << 32 | word's rank) and counts.
Levels = list[tuple[np.ndarray, np.ndarray]]
_SHIFT = np.int64(32)


def words(text: bytes, most: int = CUT_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, a line break between its pieces, in lists made of about `most` bytes."""
    at = 0
    while at < len(text):
        end = at + most
        while 0 < end < len(text) and text[end] not in b" \t\n":
            end += 1
        yield [w for w in text[at:end].translate(_PLAIN).replace(b"\n", b" \n ").split(b" ") if w]
        at = end


class _Numbers(dict):
    """Numbers words by first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Shard:
    """Words of one language after another, in order, as numbers; `tries` counts their n-grams."""

    def __init__(self, depth: int) -> None:
        self.depth, self.numbers, self.runs, self.size = depth, _Numbers(), [], 0
        self.end = self.numbers[b"\n"]

    def add(self, lang: bytes, found: list[bytes]) -> None:
        ids = np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found))
        self.runs.append((self.numbers[lang], ids))
        self.size += len(ids)

    def trie(self, last: list[bytes] | None = None) -> tuple[list[bytes], Levels]:
        """Sorted words and levels of the n-grams that are held, the language as the first word. `last`: words of an unfinished
        text that follow the last run; n-grams start before them only."""
        ids = np.concatenate([np.fromiter(map(self.numbers.__getitem__, last or ()), np.int64), np.full(self.depth, self.end)])
        ids = np.concatenate([*[r for _, r in self.runs], ids])
        langs = np.repeat(np.array([n for n, _ in self.runs], np.int64), [len(r) for _, r in self.runs])
        vocabulary = sorted(self.numbers)
        rank = np.empty(len(vocabulary), np.int64)
        rank[np.fromiter(map(self.numbers.__getitem__, vocabulary), np.int64, len(vocabulary))] = np.arange(len(vocabulary))
        whole = ids != self.end
        at = np.flatnonzero(whole[: len(langs)])
        keys, node, counts = np.unique(rank[langs[at]], return_inverse=True, return_counts=True)
        levels: Levels = [(keys, counts)]
        for k in range(self.depth):
            inside = whole[at + k]
            at, node = at[inside], node[inside]
            keys, node, counts = np.unique(node.astype(np.int64) << _SHIFT | rank[ids[at + k]], return_inverse=True, return_counts=True)
            levels.append((keys, counts))
        return vocabulary, levels


def cuts(vocabulary: list[bytes], levels: Levels, path: tuple[bytes, ...]) -> tuple[list[int], list[int]]:
    """By level, the number of nodes before `path` (its proper prefixes count as before it), and the indices of those
    prefixes, as far as the trie has them."""
    before, prefixes, parent = [], [], 0
    for k, (keys, _) in enumerate(levels):
        if parent is None:  # the path has left the trie: what follows hangs on the first node after it
            before.append(int(np.searchsorted(keys, before[-1] << 32)))
            continue
        rank = bisect_left(vocabulary, path[k])
        place = int(np.searchsorted(keys, parent << 32 | rank))
        found = rank < len(vocabulary) and vocabulary[rank] == path[k] and place < len(keys) and keys[place] == parent << 32 | rank
        if found and k + 1 < len(levels):
            prefixes.append(place)
        before.append(place + (found and k + 1 < len(levels)))
        parent = place if found else None
    return before, prefixes


def _columns(levels: Levels, k: int, chosen: np.ndarray) -> list[np.ndarray]:
    """Word ranks of the chosen nodes of level k, first word first."""
    out = []
    for j in range(k, -1, -1):
        keys = levels[j][0][chosen]
        out.append(keys & 0xFFFFFFFF)
        chosen = keys >> _SHIFT
    return out[::-1]


def packed(vocabulary: list[bytes], levels: Levels, low: list[int], high: list[int], above: list[int]) -> bytes | None:
    """The nodes of one range, and those above its first path with a count of 0, with the words that they use."""
    if not any(b > a for a, b in zip(low, high, strict=True)):
        return None
    parts = []
    for k, (_, counts) in enumerate(levels):
        over = np.array(above[k : k + 1], np.int64)
        own = np.arange(low[k], high[k])
        parts.append((_columns(levels, k, np.concatenate([over, own])), np.concatenate([0 * over, counts[own]])))
    ranks = np.unique(np.concatenate([c for columns, _ in parts for c in columns]))
    used = [vocabulary[r] for r in ranks.tolist()]
    buffers = [np.array([len(w) for w in used], np.int32).tobytes(), b"".join(used)]
    for columns, counts in parts:
        buffers += [np.searchsorted(ranks, c).astype(np.int32).tobytes() for c in columns] + [counts.astype(np.int64).tobytes()]
    raw = np.array([len(b) for b in buffers], np.int64).tobytes() + b"".join(buffers)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def unpacked(blob: bytes, depth: int) -> tuple[list[bytes], list[tuple[list[np.ndarray], np.ndarray]]]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    raw = pa.decompress(blob[8:], n, "zstd", asbytes=True)
    n_buffers = 2 + sum(k + 2 for k in range(depth + 1))
    ends = np.cumsum(np.frombuffer(raw, np.int64, n_buffers)) + 8 * n_buffers
    buffers = iter([raw[a:b] for a, b in zip([8 * n_buffers, *ends[:-1].tolist()], ends.tolist(), strict=True)])
    lengths, joined = np.frombuffer(next(buffers), np.int32), next(buffers)
    at = np.concatenate([[0], np.cumsum(lengths)]).tolist()
    vocabulary = [joined[a:b] for a, b in zip(at, at[1:], strict=False)]
    levels = []
    for k in range(depth + 1):
        columns = [np.frombuffer(next(buffers), np.int32).astype(np.int64) for _ in range(k + 1)]
        levels.append((columns, np.frombuffer(next(buffers), np.int64)))
    return vocabulary, levels


def merged(blobs: list[bytes], depth: int) -> tuple[list[bytes], Levels]:
    """One trie out of sorted ones: the counts of equal paths are added, runs merged by a sort that keeps them."""
    tries = [unpacked(b, depth) for b in blobs]
    vocabulary = sorted(set().union(*[v for v, _ in tries]))
    rank = {w: i for i, w in enumerate(vocabulary)}
    maps = [np.fromiter(map(rank.__getitem__, v), np.int64, len(v)) for v, _ in tries]
    out: Levels = []
    for k in range(depth + 1):
        columns = [np.concatenate([m[levels[k][0][j]] for m, (_, levels) in zip(maps, tries, strict=True)]) for j in range(k + 1)]
        counts = np.concatenate([levels[k][1] for _, levels in tries])
        node = columns[0]
        for j in range(k):  # the parent's index stands for the words before
            node = np.searchsorted(out[j][0], node) << _SHIFT | columns[j + 1]
        order = np.argsort(node, kind="stable")
        keys, first = np.unique(node[order], return_index=True)
        out.append((keys, np.add.reduceat(counts[order], first) if len(keys) else counts[:0]))
    return vocabulary, out


def _frequent(vocabulary: list[bytes], levels: Levels, least: int) -> Iterator[tuple[list[bytes], int, list[int]]]:
    """(path, count, counts of its proper prefixes) of all languages and of nodes that occur `least` times, in a walk from the
    root. A prefix above the range counts 0 here: another task holds it."""
    for k, (_, counts) in enumerate(levels):
        chosen = np.flatnonzero(counts >= (least if k else 1))
        lefts, up = [], chosen
        for j in range(k, 0, -1):
            up = levels[j][0][up] >> _SHIFT
            lefts.append(levels[j - 1][1][up].tolist())
        paths = [c.tolist() for c in _columns(levels, k, chosen)]
        for i, n in enumerate(counts[chosen].tolist()):
            yield [vocabulary[c[i]] for c in paths], n, [x[i] for x in reversed(lefts)]


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(named(lang).cast("string"), F.lit("und")).cast("binary").alias("lang"), F.coalesce(named(text), F.lit("")).cast("binary").alias("text"))


def _bounds(texts: DataFrame, depth: int, n_ranges: int, total: int) -> list[tuple[bytes, ...]]:
    """Paths that cut all n-grams into about n_ranges shares, from the n-grams of a sample of texts. They decide which task
    merges what, never a result."""
    if n_ranges < 2:
        return []
    wanted = min(SAMPLED * n_ranges, MOST_SAMPLED)
    part = 1 / 16 if total > 1 << 24 else 1.0  # of the texts, then of their words, which take some eight bytes each
    share = wanted / (total / 8.0) / part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(7)
        for batch in batches:
            out = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for found in words(text):
                    for i in np.flatnonzero(random.random(max(0, len(found) - depth + 1)) < share).tolist():
                        path = found[i : i + depth]
                        if b"\n" not in path:
                            out.append([lang, *path])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.binary()))], names=["path"])

    sampled = texts.sample(part, seed=11) if part < 1 else texts
    paths = sorted(tuple(bytes(w) for w in r.path) for r in sampled.mapInArrow(run, "path array<binary>").collect())
    step = max(1, -(-len(paths) // n_ranges))
    return sorted(set(paths[step::step]))


def tries(docs: DataFrame, depth: int = 3, least: int = 10, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, words, f, lefts) of every sequence of 1 to `depth` words within a piece that occurs `least` times in its language;
    lefts: the words of the language, then the counts of its first 1, 2, ... words.

    A task counts its texts in tries of TRIE_WORDS words, writes each sorted, cut at the bounds of the ranges, and a range's
    cuts are merged by one task, whose walk gives the left parts. Those above its first path are looked up where they are.
    A null language is `und`; null and empty texts have no words; long texts are cut at words, their n-grams are not; repeated rows
    count as often as they are there; an empty table has no sequences.
    """
    bound_batches(docs.sparkSession)
    texts = _texts(docs, text, lang)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = max(1, -(-total // RANGE_BYTES))
    bounds = _bounds(texts, depth, n_ranges, total)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(depth)

        def written(rest: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
            vocabulary, levels = shard.trie(rest)
            places = [([0] * len(levels), []), *[cuts(vocabulary, levels, b) for b in bounds], ([len(k) for k, _ in levels], [])]
            for r, ((low, above), (high, _)) in enumerate(zip(places, places[1:], strict=False)):
                blob = packed(vocabulary, levels, low, high, above)
                if blob is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([blob], pa.binary())], names=["range", "trie"])

        for batch in batches:
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                held: list[bytes] = []
                for found in words(body.as_py()):
                    held += found
                    if shard.size + len(held) > TRIE_WORDS and len(held) >= depth:
                        shard.add(name, held[: 1 - depth or None])
                        held = held[len(held) - depth + 1 :]
                        yield from written(held)
                        shard = Shard(depth)
                shard.add(name, [*held, b"\n"])
        if shard.size:
            yield from written()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            for r, blob in zip(batch.column("range").to_pylist(), batch.column("trie"), strict=True):
                blobs.setdefault(r, []).append(blob.as_py())
        for r in sorted(blobs):
            out = []
            for row in _frequent(*merged(blobs.pop(r), depth), least):
                out.append(row)
                if len(out) == 20_000:
                    yield _batch(r, out)
                    out = []
            yield _batch(r, out)

    dealt = texts.mapInArrow(count, "range int, trie binary").repartitionById(len(bounds) + 1, F.col("range"))
    nodes = materialised(dealt.mapInArrow(merge, "range int, lang string, words array<string>, f long, lefts array<long>"))
    if bounds:
        nodes = _with_prefixes(nodes, bounds, depth)
    return nodes.where(F.size("words") > 0).select("lang", "words", "f", "lefts")


def _batch(r: int, rows: list[tuple[list[bytes], int, list[int]]]) -> pa.RecordBatch:
    decoded = [[w.decode() for w in path] for path, _, _ in rows]
    columns = [pa.array([r] * len(rows), pa.int32()), pa.array([p[0] for p in decoded], pa.string()), pa.array([p[1:] for p in decoded], pa.list_(pa.string()))]
    columns += [pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["range", "lang", "words", "f", "lefts"])


def _with_prefixes(nodes: DataFrame, bounds: list[tuple[bytes, ...]], depth: int) -> DataFrame:
    """nodes with the counts of prefixes that another range holds: prefixes of the range's first path, one row a range."""
    spark = nodes.sparkSession
    first = [(r + 1, k, b[0].decode(), [w.decode() for w in b[1 : k + 1]]) for r, b in enumerate(bounds) for k in range(depth)]
    wanted = spark.createDataFrame(first, "of int, k int, of_lang string, prefix array<string>")
    found = wanted.join(nodes, (F.col("lang") == F.col("of_lang")) & (F.col("words") == F.col("prefix")))
    counts = found.groupBy("of").agg(F.map_from_entries(F.collect_list(F.struct("k", "f"))).alias("above"))
    filled = F.transform("lefts", lambda n, k: F.when(n > 0, n).otherwise(F.try_element_at("above", k)))
    return nodes.join(counts, F.col("range") == F.col("of"), "left").withColumn("lefts", filled)


def linked(nodes: DataFrame, depth: int = 3) -> DataFrame:
    """Adds rights, the counts of a sequence's last 1, 2, ... words, by links from each node to that of its words but the
    first, level by level. Those occur as often as the sequence at least, so they are nodes too."""
    level = nodes.where(F.size("words") == 1).select("*", F.array().cast("array<long>").alias("rights"))
    out = [level]
    for k in range(2, depth + 1):
        target = level.select(F.col("lang").alias("__lang"), F.col("words").alias("__rest"), F.concat("rights", F.array("f")).alias("rights"))
        own = nodes.where(F.size("words") == k)
        level = own.join(target, (F.col("lang") == F.col("__lang")) & (F.slice("words", 2, k - 1) == F.col("__rest"))).drop("__lang", "__rest")
        out.append(level)
    return reduce(DataFrame.unionByName, out)


def _ratio(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in decimals of up to 38 digits: exact for counts up to 10^15."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * a * a, left * right)


def scored(rows: DataFrame, depth: int = 3) -> DataFrame:
    """(lang, words, a, l, r, n, score) of candidates, by the cut that scores lowest, ties to the shortest first part."""
    best = F.lit(None)
    for n in range(2, depth + 1):
        parts = [(k, F.get("lefts", F.lit(k)), F.get("rights", F.lit(n - k - 1))) for k in range(1, n)]
        cut = F.array_min(F.array(*[F.struct(_ratio(F.col("f"), x, y).alias("score"), F.lit(k).alias("k"), x.alias("l"), y.alias("r")) for k, x, y in parts]))
        best = F.when(F.size("words") == n, cut).otherwise(best)
    out = rows.where(F.size("words") >= 2).withColumn("best", best)
    return out.select("lang", "words", F.col("f").alias("a"), "best.l", "best.r", F.get("lefts", F.lit(0)).alias("n"), "best.score")


def without_parts(candidates: DataFrame, depth: int = 3, percent: int = 50) -> DataFrame:
    """Candidates but those inside a longer one that occurs at least `percent` in a hundred times as often."""
    spans = [(n, i, k) for n in range(3, depth + 1) for k in range(2, n) for i in range(1, n - k + 2)]
    if not spans:
        return candidates
    inner = F.array_compact(F.array(*[F.when(F.size("words") == n, F.slice("words", i, k)) for n, i, k in spans]))
    longest = candidates.where(F.size("words") >= 3).select(F.col("lang").alias("__lang"), F.explode(inner).alias("__part"), F.col("a").alias("__a"))
    longest = longest.groupBy("__lang", "__part").agg(F.max("__a").alias("__a"))
    inside = (F.col("lang") == F.col("__lang")) & (F.col("words") == F.col("__part")) & (100 * F.col("__a") >= percent * F.col("a"))
    return candidates.join(longest, inside, "left_anti")


def collocations(docs: DataFrame, depth: int = 3, least: int = 10, percent: int = 50, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of 2 to `depth` words of each language.

    a: how often the phrase occurs; l, r: its first and last part, cut where floor(10^6 * a * a / (l * r)) is least; n: words
    of the language. Phrases that are part of a longer one of at least `percent` % of their count are left out. Order: score
    and a descending, then the phrase by its UTF-8 bytes. Odd inputs: see `tries`. Ranks come from range partitions, so no
    language is one task's.
    """
    nodes = materialised(linked(tries(docs, depth, least, text, lang), depth))
    rows = without_parts(scored(nodes, depth), depth, percent).withColumn("phrase", F.array_join("words", " "))
    placed = position_within(rows.drop("words"), ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], "at")
    return placed.where(F.col("at") < top).select("lang", (F.col("at") + 1).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_sql(least: int = 10, percent: int = 50, top: int = 2000) -> str:
    """DuckDB SQL of the same rows over `documents`, for phrases of 2 and 3 words."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT doc, lang, unnest(string_split_regex(t, '[.,;:!?
-]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
g AS (SELECT lang, unnest(list_concat([w[i:i] FOR i IN range(1, len(w) + 1)], [w[i:i + 1] FOR i IN range(1, len(w))], [w[i:i + 2] FOR i IN range(1, len(w) - 1)])) AS g FROM w),
f AS MATERIALIZED (SELECT lang, g, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY lang),
c AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) >= 2 AND f >= {least}),
s AS (SELECT c.lang, c.g, a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
b AS (SELECT lang, g, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS i FROM s) WHERE i = 1),
i AS (SELECT lang, unnest([g[1:2], g[2:3]]) AS g, a FROM b WHERE len(g) = 3),
m AS (SELECT lang, g, max(a) AS longer FROM i GROUP BY ALL),
o AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, n, score FROM b JOIN n USING (lang) LEFT JOIN m ON m.lang = b.lang AND m.g = b.g WHERE 100 * coalesce(longer, 0) < {percent} * a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o) WHERE rank <= {top}"""
