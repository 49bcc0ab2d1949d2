"""Exact repeated-substring removal: collection BWT and common prefixes, built column by column.

A string of `length` bytes that repeats holds, among its first `WINDOW` k-grams, the one with the least hash; both
occurrences select it (winnowing), at one offset, and the CORE bytes that follow lie inside both. Selected
places whose CORE repeats are anchors; strings around an anchor differ only in less than WINDOW bytes at either
side. Anchors with the same whole surroundings repeat as a whole. For those that differ, the sides are
inserted into a Burrows-Wheeler transform one symbol per string and round, with the core as one symbol;
a common prefix that spans the needed symbols is a repeated string. A core with so many surroundings that they do
not fit a transform has each of its strings hashed whole and counted instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.llm.rows import hold, release
from veriloom.llm.textbytes import flat, grouped, mix, prefix_hash, slices, span
from veriloom.session import bound_batches, materialised

LENGTH, GRAM, WINDOW = 400, 16, 100
#: Bytes from an anchor on that every string with that anchor holds.
CORE = LENGTH - WINDOW + 1
#: The same for strings of SHARED bytes, some 50 words: the places where they begin are counted beside (n_shared).
SHARED = 280
NEAR = SHARED - WINDOW + 1
#: Sides reach this far at most; half of one is fixed by the group, the rest is sorted.
REACH = WINDOW - 1
HALF = WINDOW // 2
#: Strings of one transform; a core with more surroundings than this has its strings hashed.
COLLECTION = 6000
_PAD, _FIRST_CORE = 256, 257


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place in the buffer, text number, hash of NEAR bytes, whether the core is whole, hash of the core, hash of the
    surroundings) of the places that are the rightmost least k-gram of some WINDOW neighbouring ones and have NEAR bytes."""
    none = np.zeros(0, np.int64)
    empty = (none, none, none.view(np.uint64), none.astype(bool), none.view(np.uint64), none.view(np.uint64))
    sizes = np.diff(offsets)
    n = len(data) - GRAM + 1
    if n < WINDOW or sizes.max(initial=0) < SHARED:
        return empty
    prefix = prefix_hash(data)
    at = np.arange(n)
    h = mix(span(prefix, at, at + GRAM))
    h = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - at.astype(np.uint64))
    low, width = h, 1
    while 2 * width <= WINDOW:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    rest = WINDOW - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    starts = np.arange(len(low))
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(low)]
    low = low[starts + SHARED <= offsets[owner + 1]]
    chosen = np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))
    place = np.unique(chosen.astype(np.int64))
    text = np.searchsorted(offsets, place, "right") - 1
    end = offsets[text + 1]
    keep = place + NEAR <= end
    place, text, end = place[keep], text[keep], end[keep]
    near = mix(span(prefix, place, place + NEAR))
    whole = place + CORE <= end
    core = mix(span(prefix, place, np.minimum(place + CORE, end)))
    a, b = surroundings(place, offsets[text], end)
    around = mix(span(prefix, a, b) + mix(((place - a) * 4096 + (b - place)).astype(np.uint64)))
    return place, text, near, whole, core, around


def surroundings(place: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last byte that strings with this anchor can cover."""
    return np.maximum(place - REACH, start), np.minimum(place + CORE + REACH, end)


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo:hi]) of each non-empty range."""
    if not len(lo):
        return np.zeros(0, values.dtype)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], hi[order]
    out = np.empty(len(lo), values.dtype)
    if int((hi - lo).sum()) <= 8 * len(values):
        pairs = np.ravel(np.column_stack((lo, hi)))
        out[order] = np.minimum.reduceat(np.append(values, values[-1:]), pairs)[::2]
        return out
    level = np.floor(np.log2(hi - lo)).astype(np.int64)
    table, found = values, np.empty(len(lo), values.dtype)
    for k in range(int(level.max()) + 1):
        mine = np.flatnonzero(level == k)
        found[mine] = np.minimum(table[lo[mine]], table[hi[mine] - (1 << k)])
        if len(table) <= 1 << k:
            break
        table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
    out[order] = found
    return out


def collection_repeats(strings: np.ndarray, need: int) -> np.ndarray:
    """mask[k, o]: the suffix of string k from symbol o on shares `need` leading symbols or more with another suffix.

    Strings are rows of equal length. Round j inserts the j-th symbol from the right of every string: the symbol
    is written to the transform where the string's last suffix stands, a stable sort of the transform by symbol
    gives the new suffixes' places (its LF mapping), and their common prefixes with both neighbours are one more
    than the least common prefix between the symbol's neighbouring occurrences. The transform, common prefixes
    and suffix numbers are sequential arrays, each passed over once a round.
    """
    count, width = strings.shape
    bwt = np.zeros(count, np.uint16)
    lcp = np.zeros(count, np.int16)
    name = np.arange(count, dtype=np.int32) * (width + 1) + width
    place = np.arange(count)
    for column in range(width - 1, -1, -1):
        size = len(bwt)
        symbol = strings[:, column]
        bwt[place] = symbol
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(size, np.int64)
        rank[order] = np.arange(size)
        mine = rank[place]
        before, after = order[np.maximum(mine - 1, 0)], order[np.minimum(mine + 1, size - 1)]
        same_before = (mine > 0) & (bwt[before] == symbol)
        same_after = (mine < size - 1) & (bwt[after] == symbol)
        with_before, with_after = np.zeros(count, np.int16), np.zeros(count, np.int16)
        with_before[same_before] = 1 + _range_min(lcp, before[same_before] + 1, place[same_before] + 1)
        with_after[same_after] = 1 + _range_min(lcp, place[same_after] + 1, after[same_after] + 1)
        place = count + mine
        old = np.ones(size + count, bool)
        old[place] = False
        grown = []
        for values, new in ((bwt, np.zeros(count, np.uint16)), (lcp, with_before), (name, np.arange(count, dtype=np.int32) * (width + 1) + column)):
            out = np.empty(size + count, values.dtype)
            out[old], out[place] = values, new
            grown.append(out)
        bwt, lcp, name = grown
        follower = place + 1
        inside = follower < size + count
        lcp[follower[inside]] = with_after[inside]
    reaches = lcp >= need
    reaches[:-1] |= lcp[1:] >= need
    mask = np.zeros(count * (width + 1), bool)
    mask[name[reaches]] = True
    return mask.reshape(count, width + 1)[:, :width]


def _occurrences(df: DataFrame) -> DataFrame:
    """(near, core, around, key, place) of the anchors of texts (text); key is the text's hash, core null where it is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                place, owner, near, whole, core, around = anchors(data, offsets)
                if len(place):
                    key = rows.column("key").to_numpy()[owner]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(near.view(np.int64)), pa.array(core.view(np.int64), mask=~whole), pa.array(around.view(np.int64)), pa.array(key), pa.array((place - offsets[owner]).astype(np.int32))],
                        names=["near", "core", "around", "key", "place"],
                    )

    source = df.select(F.xxhash64("text").alias("key"), "text").where(F.octet_length("text") >= SHARED)
    return source.mapInArrow(run, "near long, core long, around long, key long, place int")


def _sides(rows: DataFrame) -> DataFrame:
    """Strings of anchors, from rows (text, key, wanted: array of (core, around, place, hot)): for the left and the right
    side one of 2 * HALF - 1 symbols, named by the core and the half of that side which the group has in common.
    For a hot core, each string of LENGTH bytes around the anchor, as a group name alone (side 2, start: its first byte).
    Anchors whose core is not in the text belong to another text of the same hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in _STRING}
            for text, key, wanted in zip(batch.column("text").to_pylist(), batch.column("key").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                raw = text.encode()
                places, cores = np.array([w["place"] for w in wanted]), np.array([w["core"] for w in wanted])
                for w in (w for w, ok in zip(wanted, _cores_at(np.frombuffer(raw, np.uint8), places, cores), strict=True) if ok):
                    p, core = w["place"], w["core"]
                    if w["hot"]:
                        for start in range(max(0, p - REACH), min(p, len(raw) - LENGTH) + 1):
                            _add(out, _name(core, 2, raw[start : start + LENGTH]), key, core, p, start, 2, 0, 0, b"")
                        continue
                    left, right = raw[max(0, p - REACH) : p], raw[p + CORE : p + CORE + REACH]
                    fixed, far = HALF, REACH - HALF
                    # Strings that start HALF to REACH bytes before the anchor, then those that start less before it.
                    if len(left) >= fixed:
                        body = left[: len(left) - fixed].rjust(far, b"\0") + right[:far].ljust(far, b"\0")
                        _add(out, _name(core, 0, left[len(left) - fixed :]), key, core, p, 0, 0, far - (len(left) - fixed), far + min(far, len(right)), body)
                    if len(right) >= fixed:
                        body = left[max(0, len(left) - far) :].rjust(far, b"\0") + right[fixed:].ljust(far, b"\0")
                        _add(out, _name(core, 1, right[:fixed]), key, core, p, 0, 1, far - min(far, len(left)), far + len(right) - fixed, body)
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in _STRING.items()], names=list(_STRING))

    return rows.mapInArrow(run, "group_id binary, key long, core long, place int, start int, side byte, low short, high short, body binary")


def _name(core: int, side: int, fixed: bytes) -> bytes:
    return hashlib.blake2b(fixed, digest_size=16, key=core.to_bytes(8, "little", signed=True), salt=bytes([side])).digest()


#: Columns of a string: its group's name, its text and anchor, and the symbols on either side of the core; low and high
#: bound those of `body` that are there, the others pad.
_STRING = {
    "group_id": pa.binary(), "key": pa.int64(), "core": pa.int64(), "place": pa.int32(), "start": pa.int32(), "side": pa.int8(), "low": pa.int16(), "high": pa.int16(), "body": pa.binary(),
}


def _add(out: dict[str, list], *values: object) -> None:
    for column, value in zip(_STRING, values, strict=True):
        out[column].append(value)


def _cores_at(data: np.ndarray, places: np.ndarray, cores: np.ndarray) -> np.ndarray:
    """Whether the text's CORE bytes at each place have the hash given."""
    fits = places + CORE <= len(data)
    at = places[fits]
    out = np.zeros(len(places), bool)
    out[fits] = mix(span(prefix_hash(data), at, at + CORE)).view(np.int64) == cores[fits]
    return out


def _repeated(tables: list[pa.Table]) -> pa.RecordBatch:
    """(key, core, place, start, end) of the anchors of some groups: bytes start..end of the text are in repeated strings."""
    table = pa.concat_tables(tables)
    far = REACH - HALF
    body = np.frombuffer(b"".join(table.column("body").to_pylist()), np.uint8).reshape(-1, 2 * far)
    low, high, side = (table.column(c).to_numpy().astype(np.int64) for c in ("low", "high", "side"))
    group = np.repeat(np.arange(len(tables)), [t.num_rows for t in tables])
    strings = np.empty((len(body), 2 * far + 1), np.uint16)
    strings[:, :far], strings[:, far + 1 :] = body[:, :far], body[:, far:]
    column = np.arange(2 * far)
    pad = (column[None, :] < low[:, None]) | (column[None, :] >= high[:, None])
    strings[:, :far][pad[:, :far]] = _PAD
    strings[:, far + 1 :][pad[:, far:]] = _PAD
    strings[:, far] = _FIRST_CORE + group
    mask = collection_repeats(strings, far + 1)[:, : far + 1]
    start = np.arange(far + 1)
    mask &= (start[None, :] >= low[:, None]) & (start[None, :] + far <= high[:, None])
    hit = np.flatnonzero(mask.any(axis=1))
    first = np.argmax(mask[hit], axis=1)
    last = far - np.argmax(mask[hit][:, ::-1], axis=1)
    place = table.column("place").to_numpy()[hit].astype(np.int64)
    before = np.where(side[hit] == 0, HALF, 0) + far
    begin, end = place - before + first, place - before + last + LENGTH
    of = [table.column(c).combine_chunks().take(pa.array(hit)) for c in ("key", "core", "place")]
    return pa.RecordBatch.from_arrays([*of, pa.array(begin), pa.array(end)], names=["key", "core", "place", "start", "end"])


def _second(text: str) -> Column:
    """A second hash of a text, independent of its key."""
    return F.xxhash64(F.lit(1), F.col(text))


def _repeats(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of texts (text): (key, core, place, start, end) of `repeated_spans`, and (key, shared): how many of the text's anchors
    begin a string of NEAR bytes that begins elsewhere too, copies of a text taken as one, and one more if there are copies.
    Spans of a whole text have no place, and the text's second hash as core."""
    bound_batches(texts.sparkSession)
    copies = texts.groupBy(F.xxhash64("text").alias("key"), _second("text").alias("core"), F.octet_length("text").cast("long").alias("size")).agg(F.count("*").alias("n"))
    begin, none = F.lit(0).cast("long"), F.lit(None).cast("int")
    whole = copies.where((F.col("n") > 1) & (F.col("size") >= LENGTH)).select("key", "core", none.alias("place"), begin.alias("start"), F.col("size").alias("end"))

    every = _occurrences(texts)
    at = F.xxhash64("key", "place")
    # Written on either side of the join: its tasks can be split where a core is very common only if they do nothing else.
    often = materialised(every.groupBy("near").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).where("lo <> hi").select("near"))
    found = materialised(materialised(every.join(often, "near").drop("near")).distinct())
    shared = found.groupBy("key").agg(F.count("*").alias("shared")).union(copies.where((F.col("n") > 1) & (F.col("size") >= SHARED)).select("key", F.lit(1).cast("long")))
    shared = shared.groupBy("key").agg(F.sum("shared").alias("shared"))
    found = found.where("core is not null")
    alike = materialised(found.groupBy("core", "around").agg(F.count("*").alias("n"), F.min("key").alias("least")))
    per_core = materialised(alike.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1").select("core", (F.col("kinds") > COLLECTION).alias("hot")))
    twice = found.join(alike.where("n > 1").select("core", "around"), ["core", "around"])
    reach = copies.select("key", "size").distinct()
    first, last = F.greatest(F.col("place") - REACH, F.lit(0)).cast("long"), F.least(F.col("place") + CORE + REACH, F.col("size"))
    sure = twice.join(reach, "key").select("key", "core", "place", first.alias("start"), last.alias("end")).where(F.col("end") - F.col("start") >= LENGTH)

    one = found.join(alike.select("core", "around", F.col("least").alias("key")), ["core", "around", "key"]).groupBy("core", "around", "key").agg(F.min("place").alias("place"))
    wanted = materialised(one.join(per_core, "core")).groupBy("key").agg(F.collect_list(F.struct("core", "around", "place", "hot")).alias("wanted"))
    long_ = texts.select(F.xxhash64("text").alias("key"), _second("text").alias("second"), "text").where(F.octet_length("text") >= LENGTH)
    strings = _sides(long_.join(wanted, "key").dropDuplicates(["key", "second"]).select("key", "text", "wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for group in grouped(batches, ["group_id"]):
            if group.num_rows < 2:
                continue
            held.append(group)
            rows += group.num_rows
            if rows >= COLLECTION:
                yield _repeated(held)
                held, rows = [], 0
        if held:
            yield _repeated(held)

    spans = [sure, whole]
    if per_core.where("hot").isEmpty():
        cold = strings
    else:
        strings = materialised(strings)
        cold, hot = strings.where("side < 2"), strings.where("side = 2").select("group_id", "key", "core", "place", F.col("start").cast("long").alias("start"))
        at = F.xxhash64("key", "start")
        common = materialised(hot.groupBy("group_id").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).where("lo <> hi").select("group_id"))
        spans.append(hot.join(common, "group_id").select("key", "core", "place", "start", (F.col("start") + LENGTH).alias("end")))
    edges = cold.repartition("group_id").sortWithinPartitions("group_id").mapInArrow(run, "key long, core long, place int, start long, end long")
    for more in spans:
        edges = edges.union(more)
    return edges, shared


def repeated_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """(key, core, place, start, end): byte ranges, of the texts whose hash is key and whose CORE bytes at place have the
    hash core, covered by strings of LENGTH bytes that also start anywhere else. Ranges may overlap. Texts that occur
    more than once are given as a whole, with no place and their second hash as core: so no text gets another's
    ranges because 64 bits of theirs are equal.

    Hot passages: occurrences are counted before they are joined, equal surroundings become one string, and the
    strings of a core are dealt out by the half side that they share. As both halves can lie inside a long passage,
    a core with over COLLECTION surroundings is not dealt out: its strings of LENGTH bytes, at most WINDOW an anchor, are
    hashed whole (128 bits) and counted. So no group is larger than COLLECTION, whatever is common.
    """
    return _repeats(hold(df, {"text": text}).select("text"))[0]


def _own(data: np.ndarray, ranges: list[dict], second: int) -> set[tuple[int, int]]:
    """(start, end) of the ranges that are this text's."""
    whole = {(r["start"], r["end"]) for r in ranges if r["place"] is None and r["core"] == second and r["end"] == len(data)}
    if whole:
        return whole
    placed = [r for r in ranges if r["place"] is not None]
    right = _cores_at(data, np.array([r["place"] for r in placed], np.int64), np.array([r["core"] for r in placed], np.int64)) if placed else ()
    return {(r["start"], r["end"]) for r, ok in zip(placed, right, strict=True) if ok}


def remove_repeats(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_bytes, n_removed, n_spans, kept_sha256, spans (maximal removed runs as first byte and one past
    the last) and n_shared to every row; columns of those names are replaced. See `repeated_spans`.

    n_shared is a feature of its own, beside the removal, which does not look at it. It counts shorter passages too, by equal
    64-bit hashes that are not held against the text, and marks other documents as well: on sf0.1 8 % of those that share no 51
    words with another document (repeats of their own, passages of 30 to 50 words). It is the number of the text's anchors whose NEAR bytes begin at another place, copies of the text
    aside, and one more if it has copies (of SHARED bytes or more). A passage of SHARED bytes or more that occurs elsewhere
    gives at least one; those under LENGTH bytes are not removed. Null counts as empty text; a row that repeats another's text
    loses all of it if it has LENGTH bytes; short texts lose nothing; texts of any length are searched whole; an empty table
    gives an empty result.
    """
    used = {"text": text}
    held = hold(df, used)
    spans, shared = _repeats(held.select("text"))
    span = F.struct("start", "end", "place", "core")
    none = lambda *names: [F.lit(None).cast(t).alias(c) for c, t in (n.split() for n in names)]
    found = spans.select("key", *none("shared long"), "start", "end", "place", "core").union(shared.select("key", "shared", *none("start long", "end long", "place int", "core long")))
    found = found.groupBy("key").agg(F.collect_set(F.when(F.col("start").isNotNull(), span)).alias("ranges"), F.max("shared").alias("shared"))
    joined = held.withColumns({"key": F.xxhash64("text"), "second": _second("text")}).join(found, "key", "left")
    joined = joined.select("text", "row", "ranges", "second", F.coalesce("shared", F.lit(0)).cast("long").alias("n_shared"))
    run_type = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))
    added = (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("spans", run_type))
    schema = joined.drop("ranges", "second").schema
    for c, t in added:
        schema = schema.add(c, t)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            raw, sizes, removed, spans, kept = memoryview(data), [], [], [], []
            for i, (ranges, second) in enumerate(zip(batch.column("ranges").to_pylist(), batch.column("second").to_pylist(), strict=True)):
                a, b = int(offsets[i]), int(offsets[i + 1])
                runs: list[list[int]] = []
                for start, end in sorted(_own(data[a:b], ranges, second)) if ranges else ():
                    if runs and runs[-1][1] >= start:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([start, end])
                digest, at = hashlib.sha256(), 0
                for start, end in runs:
                    digest.update(raw[a + at : a + start])
                    at = end
                digest.update(raw[a + at : b])
                sizes.append(b - a)
                removed.append(sum(e - s for s, e in runs))
                spans.append([{"start": s, "end": e} for s, e in runs])
                kept.append(digest.hexdigest())
            columns = [batch.column(n) for n in ("text", "row", "n_shared")]
            columns += [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(kept), pa.array(spans, span_type)]
            yield pa.RecordBatch.from_arrays(columns, names=["text", "row", "n_shared", *[c for c, _ in added]])

    names = [c for c, _ in added] + ["n_shared"]
    return release(joined.mapInArrow(run, schema), df, used, {c: F.col(c) for c in names})
