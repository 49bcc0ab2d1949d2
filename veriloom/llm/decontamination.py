"""Benchmark decontamination: winnowed word fingerprints of texts and benchmark are joined, and hits are extended to windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.llm.rows import ROW, hold, named, release
from veriloom.llm.textbytes import LETTERS, LOWER, grams, mix, prefix_hash, slices, span, words
from veriloom.session import bound_batches, materialised

#: Words of a window, and of a fingerprint's k-gram: among any WINDOW - GRAM + 1 neighbouring k-grams one is kept.
WINDOW, GRAM = 10, 8
#: Benchmark fingerprints (of 8 bytes) that are sent to the texts at most; more are joined by shuffle.
MAX_PRINTS = 4 << 20
#: Of a result: its texts' number of words, runs of hit words as first and one past the last, and item ids.
ADDED = ("__n_words", "__hits", "__items")
_HITS = T.ArrayType(T.StructType().add("a", "long").add("b", "long"))
_FOUND = T.ArrayType(T.StructType().add("w", "string").add("size", "integer").add("at", T.ArrayType(T.IntegerType())))
_FOUND_ARROW = pa.list_(pa.struct([("w", pa.string()), ("size", pa.int32()), ("at", pa.list_(pa.int32()))]))


@dataclass
class Words:
    """Words of a slice of texts: lower-case bytes, first and last byte, text number, hash; and each text's first word."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        low = LOWER[data]
        starts, ends, owner = words(low, offsets, LETTERS)
        hashes = mix(span(prefix_hash(low), starts, ends) + (ends - starts).astype(np.uint64))
        counts = np.bincount(owner, minlength=len(offsets) - 1).astype(np.int64)
        return cls(low, starts, ends, owner, hashes, counts, np.concatenate(([0], np.cumsum(counts))))

    def text(self, at: int, size: int) -> str:
        raw = memoryview(self.raw)
        return b" ".join(bytes(raw[self.starts[j] : self.ends[j]]) for j in range(at, at + size)).decode("utf-8", "replace")


def winnow(hashes: np.ndarray, owner: np.ndarray, window: int, gram: int) -> np.ndarray:
    """First-word numbers of the k-grams that are the rightmost minimum of some window - gram + 1 neighbouring
    k-grams of one text."""
    width = window - gram + 1
    h = grams(hashes, gram)
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = h[:n].copy(), np.arange(n)
    for j in range(1, width):
        better = h[j : j + n] <= best
        best[better] = h[j : j + n][better]
        at[better] = np.arange(j, j + n)[better]
    whole = owner[:n] == owner[window - 1 : window - 1 + n]
    return np.unique(at[whole])


def fingerprints(held: Words, sizes: list[int], window: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, word numbers, hashes): the winnowed k-grams (size: window), and all runs of each smaller size asked for."""
    kept = winnow(held.hashes, held.owner, window, gram)
    if len(kept):
        yield window, kept, grams(held.hashes, gram)[kept]
    for size in sizes:
        h = grams(held.hashes, size)
        inside = np.flatnonzero(held.owner[: len(h)] == held.owner[size - 1 :]) if len(h) else np.zeros(0, np.int64)
        if len(inside):
            yield size, inside, h[inside]


def _spread(held: Words, size: int, matched: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Where windows that hold the matched fingerprints start."""
    if size < window or not len(matched):
        return matched
    begin = np.maximum(matched - (window - gram), held.first[held.owner[matched]])
    end = np.minimum(matched, held.first[held.owner[matched] + 1] - window)
    spans = [np.arange(a, b + 1) for a, b in zip(begin, end, strict=True)]
    return np.unique(np.concatenate(spans))


def _found(held: Words, matched: list[tuple[int, np.ndarray]], window: int, gram: int) -> list[list[dict]]:
    """Of every text, the runs of words to look for in the benchmark: their text, size and places."""
    out: list[dict[tuple[str, int], list[int]]] = [{} for _ in held.counts]
    for size, at in matched:
        for i in _spread(held, size, at, window, gram):
            text = int(held.owner[i])
            out[text].setdefault((held.text(int(i), size), size), []).append(int(i - held.first[text]))
    return [[{"w": w, "size": size, "at": at} for (w, size), at in runs.items()] for runs in out]


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def benchmark_prints(items: DataFrame, window: int, gram: int) -> DataFrame:
    """(size, h): fingerprints of items (item, text); an item of fewer than `window` words has one, of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in slices(batch, "text"):
                held = Words.of(data, offsets)
                for size, at, h in fingerprints(held, [n for n in np.unique(held.counts).tolist() if 0 < n < window], window, gram):
                    if size < window:
                        h = h[held.counts[held.owner[at]] == size]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), size, np.int32)), pa.array(h.view(np.int64))], names=["size", "h"])

    return items.mapInArrow(run, "size int, h long").distinct()


def benchmark_windows(items: DataFrame, window: int) -> DataFrame:
    """(w, items): every window of the benchmark as text, with the ids of the items that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                held, out = Words.of(data, offsets), ([], [])
                for i, name in enumerate(rows.column("item").to_pylist()):
                    n = int(held.counts[i])
                    size = min(window, n)
                    for w in {held.text(int(held.first[i]) + j, size) for j in range(n - size + 1)} if size else ():
                        out[0].append(w)
                        out[1].append(name)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string())], names=["w", "item"])

    return items.mapInArrow(run, "w string, item string").groupBy("w").agg(F.collect_set("item").alias("items"))


def _candidates(texts: DataFrame, prints: DataFrame, window: int, gram: int) -> DataFrame:
    """texts (text, k1, k2 and others) without text, and with n_words and found: runs of words that hold a fingerprint of
    the benchmark's."""
    sizes = [r[0] for r in prints.select("size").distinct().where(F.col("size") < window).orderBy("size").collect()]
    if prints.count() > MAX_PRINTS:
        texts, index = texts.join(_by_shuffle(texts, prints, sizes, window, gram), ["k1", "k2"], "left"), None
    else:
        held = prints.toArrow()
        size, h = held.column("size").to_numpy(), held.column("h").to_numpy().view(np.uint64)
        index = texts.sparkSession.sparkContext.broadcast({int(n): np.sort(h[size == n]) for n in np.unique(size)})
    names = [c for c in texts.columns if c not in ("text", "matched")]
    schema = texts.select(names).schema.add("n_words", "long").add("found", _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                words_ = Words.of(data, offsets)
                if index is not None:
                    none = np.zeros(0, np.uint64)
                    matched = [(size, at[_member(h, index.value.get(size, none))]) for size, at, h in fingerprints(words_, sizes, window, gram)]
                else:
                    told = [[(m["size"], m["at"] + int(words_.first[i])) for m in ms or ()] for i, ms in enumerate(rows.column("matched").to_pylist())]
                    matched = [(size, np.array(sorted(at for ms in told for s, at in ms if s == size), np.int64)) for size in sorted({s for ms in told for s, _ in ms})]
                columns = [*(rows.column(c) for c in names), pa.array(words_.counts, pa.int64()), pa.array(_found(words_, matched, window, gram), _FOUND_ARROW)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_words", "found"])

    return texts.mapInArrow(run, schema)


def _by_shuffle(texts: DataFrame, prints: DataFrame, sizes: list[int], window: int, gram: int) -> DataFrame:
    """(k1, k2, matched): the fingerprints of texts that the benchmark has, where those are too many to be sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                held = Words.of(data, offsets)
                keys = [rows.column(c).to_numpy() for c in ("k1", "k2")]
                for size, at, h in fingerprints(held, sizes, window, gram):
                    of = held.owner[at]
                    place = (at - held.first[of]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[0][of]), pa.array(keys[1][of]), pa.array(place), pa.array(np.full(len(at), size, np.int32)), pa.array(h.view(np.int64))], names=["k1", "k2", "at", "size", "h"]
                    )

    every = materialised(texts.select("text", "k1", "k2").mapInArrow(run, "k1 long, k2 long, at int, size int, h long"))
    matched = materialised(every.join(prints, ["size", "h"], "left_semi"))
    return matched.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "size")).alias("matched"))


def _hits(candidates: DataFrame, windows: DataFrame) -> DataFrame:
    """(k1, k2, hits, items) of the texts that hold a window of the benchmark."""
    runs = candidates.where(F.size("found") > 0).select("k1", "k2", "found").dropDuplicates(["k1", "k2"]).select("k1", "k2", F.explode("found").alias("f"))
    joined = materialised(runs.select("k1", "k2", "f.w", "f.size", "f.at")).join(windows, "w")
    per_text = joined.groupBy("k1", "k2").agg(F.collect_list(F.struct("size", "at")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = []
            for runs in batch.column("runs").to_pylist():
                out: list[dict] = []
                for a, b in sorted((a, a + r["size"]) for r in runs for a in r["at"]):
                    if out and out[-1]["b"] >= a:
                        out[-1]["b"] = max(out[-1]["b"], b)
                    else:
                        out.append({"a": a, "b": b})
                merged.append(out)
            hits = pa.array(merged, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "items")), hits], names=["k1", "k2", "items", "hits"])

    return per_text.mapInArrow(run, per_text.select("k1", "k2", "items").schema.add("hits", _HITS))


def _keyed(documents: DataFrame, text: str) -> DataFrame:
    """documents held (text, ROW) with two hashes of the text, which stand for it where it is not moved."""
    held = hold(documents, {"text": text})
    return held.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})


def _searched(texts: DataFrame, benchmark: DataFrame, item: str, item_text: str, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(texts without text but with n_words, hits of distinct texts); texts are read once."""
    bound_batches(texts.sparkSession)
    items = benchmark.select(F.coalesce(named(item).cast("string"), F.lit("null")).alias("item"), named(item_text).alias("text")).where("text is not null")
    found = materialised(_candidates(texts, materialised(benchmark_prints(items, window, gram)), window, gram))
    return found.drop("found"), materialised(_hits(found, benchmark_windows(items, window)))


def search(
    documents: DataFrame, benchmark: DataFrame, columns: tuple[str, ...] = ("doc_id",), text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """`columns` of documents with __n_words, __hits (runs of hit words as first and one past the last, merged) and
    __items (ids, sorted); columns of those names are replaced.

    A window is `window` consecutive words of an item (all of them, of a shorter one); words are lower-cased
    runs of digits, a-z and non-ASCII characters. Every shared window is found: winnowing keeps a fingerprint
    in each stretch of that length, of both texts the same one; what a matching fingerprint lies in is compared as
    text. Documents are read once and their texts do not move: fingerprints of the benchmark, of 8 bytes each, are
    sent to them up to MAX_PRINTS, and joined by shuffle beyond; windows are joined by their text, as only places with a
    matching fingerprint are left by then. Null and empty texts have no words; a null item id is called "null"; repeated
    rows are treated alike; empty tables give no hits.
    """
    kept = documents.select(*[named(c) for c in dict.fromkeys([*columns, text])])
    used = {"text": text}
    rows, hits = _searched(_keyed(kept, text), benchmark, item, item_text, window, gram)
    joined = rows.join(hits, ["k1", "k2"], "left")
    added = {"__n_words": F.col("n_words"), "__hits": F.coalesce("hits", F.array().cast(_HITS)), "__items": F.coalesce("items", F.array().cast("array<string>"))}
    out = [c for c in dict.fromkeys(columns) if c not in ADDED and c not in used.values()]
    return joined.select(*[F.col(ROW).getField(c).alias(c) for c in out], *[v.alias(k) for k, v in added.items()])


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """All columns of documents, texts too, with those that `search` adds; see there. Documents are read again for it."""
    keyed = _keyed(documents, text)
    rows, hits = _searched(keyed.select("text", "k1", "k2"), benchmark, item, item_text, window, gram)
    counts = rows.dropDuplicates(["k1", "k2"])
    joined = keyed.join(counts, ["k1", "k2"]).join(hits, ["k1", "k2"], "left")
    added = {"__n_words": F.col("n_words"), "__hits": F.coalesce("hits", F.array().cast(_HITS)), "__items": F.coalesce("items", F.array().cast("array<string>"))}
    return release(joined, documents, {"text": text}, added)


def without_hits(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, few: int = 1 << 20
) -> DataFrame:
    """The rows of documents that share no window with the benchmark, as they are. The texts with hits are named by two
    hashes; up to `few` of them are sent to the rows, more are joined by shuffle."""
    keyed = _keyed(documents, text)
    _, hits = _searched(keyed.select("text", "k1", "k2"), benchmark, item, item_text, window, gram)
    bad = materialised(hits.select("k1", "k2"))
    if bad.count() <= few:
        bad = F.broadcast(bad)
    return release(keyed.join(bad, ["k1", "k2"], "left_anti"), documents, {"text": text})


def digest(rows: DataFrame) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated from the columns that `search` adds."""
    n_hit = F.aggregate("__hits", F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"])
    return rows.withColumns(
        {
            "n_words": F.col("__n_words"),
            "n_hit": n_hit,
            "n_items": F.size("__items").cast("long"),
            "items_sha256": F.sha2(F.array_join(F.array_sort("__items"), ","), 256),
            "contaminated": n_hit > 0,
        }
    ).drop(*ADDED)
