"""Word n-gram Jaccard join by T-occurrence search (DivideSkip), with exact prefix signatures before it.

Two texts link when their shingle sets have den * |x & y| >= num * |x | y|. A set x then shares at least
least(x) = ceil(num * |x| / den) shingles with any partner. In hash order, the first |x| - least(x) + k
shingles (its prefix) hold the first k shared ones, for x and its partner alike. Of the prefix shingles that
occur in other sets of a size that can link, all but the k - 1 most frequent are x's signatures: partners always
share one. @@ families are what is searched, each with inverted lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.llm.rows import hold, named, packed, release
from veriloom.llm.textbytes import LOWER, NOT_SPACE, SLICE_BYTES, flat, grams, grouped, mix, prefix_hash, slices, span, words
from veriloom.operators.graph import connected_components
from veriloom.session import bound_batches, materialised

#: Share of a set's size that a prefix holds beyond the least that could be needed.
SPARE = 0.05
#: Texts of one search task; larger families are dealt to several tasks.
BLOCK = 4096
#: Marks of texts that are sent to all tasks; more are joined by shuffle.
MOST_SENT = 1 << 20
#: DivideSkip's weight of a binary probe against a step of the merge.
MU = 0.01


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle hashes in ascending order, text number of each, set size per text). A text of fewer than
    k words has its whole sequence as its one shingle; without words the set is empty."""
    parts, first = [], 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        value, text, n = _slice_sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], k)
        parts.append((value, text + first, n))
        first = last
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _slice_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = LOWER[data]
    starts, ends, owner = words(low, offsets, NOT_SPACE)
    n_texts = len(offsets) - 1
    hashes = mix(span(prefix_hash(low), starts, ends) + (ends - starts).astype(np.uint64))
    counts = np.bincount(owner, minlength=n_texts)
    full = grams(hashes, k)
    inside = owner[: len(full)] == owner[k - 1 :] if len(full) else np.zeros(0, bool)
    values, texts = [full[inside]], [owner[: len(full)][inside]]
    first = np.concatenate(([0], np.cumsum(counts)))
    for size in range(1, k):
        short = np.flatnonzero(counts == size)
        if len(short):
            values.append(grams(hashes, size)[first[short]])
            texts.append(short)
    value, text = np.concatenate(values), np.concatenate(texts)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[fresh], text[fresh]
    return value, text, np.bincount(text, minlength=n_texts)


def _ceil(a: np.ndarray, num: int, den: int) -> np.ndarray:
    return -(-a * num // den)


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    spare = np.maximum(1, np.ceil(n * SPARE)).astype(np.int64)
    return np.minimum(n, n - _ceil(n, num, den) + spare)


def _fewest_shared(n: Column, num: int, den: int) -> Column:
    """How many shingles of a set of n its prefix shares with a partner's, at least: the spare part of the smallest partner."""
    least = F.ceil(n * F.lit(num) / F.lit(den))
    return F.greatest(F.lit(1), F.ceil(least * F.lit(SPARE))).cast("int")


def _may_link(small: Column, large: Column, num: int, den: int) -> Column:
    """Whether sets of these sizes, in ascending order, can link: the smaller one at most is shared, the larger one at least is the union."""
    return small * F.lit(den) >= large * F.lit(num)


def signatures(df: DataFrame, text: str, keep: list[str], k: int, num: int, den: int) -> DataFrame:
    """`keep`, __key (hash of the text), __n (set size) and __prefix of every row."""
    source = df.select(*keep, F.xxhash64(text).alias("__key"), F.col(text).alias("__text"))
    schema = source.drop("__text").schema.add("__n", "long").add("__prefix", T.ArrayType(T.LongType()))
    names = [*keep, "__key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "__text"):
                value, owner, n = shingle_sets(data, offsets, k)
                n = n.astype(np.int64)
                upto = prefix_length(n, num, den)
                first = np.concatenate(([0], np.cumsum(n)))
                head = np.arange(len(value)) - first[owner] < upto[owner]
                bounds = np.concatenate(([0], np.cumsum(upto))).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(bounds), pa.array(value[head].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(n), prefix], names=[*names, "__n", "__prefix"])

    return source.mapInArrow(run, schema)


class Lists:
    """Inverted lists of a family: for each shingle the ascending numbers of the sets that hold it."""

    def __init__(self, value: np.ndarray, owner: np.ndarray, n: np.ndarray) -> None:
        order = np.lexsort((owner, value))
        tokens, self.postings = value[order], owner[order]
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        at = np.flatnonzero(new)
        self.start, self.length = at, np.diff(np.append(at, len(tokens)))
        number = np.empty(len(tokens), np.int64)
        number[order] = np.cumsum(new) - 1
        self.token, self.n = number, n
        self.first = np.concatenate(([0], np.cumsum(n)))

    def search(self, i: int, open_: np.ndarray, num: int, den: int) -> np.ndarray:
        """The sets among `open_` (a mask) that link with set i.

        DivideSkip: with T occurrences required, the L longest lists are set aside; a set with T - L
        occurrences in the merged short lists is a candidate, and is looked up in the long ones by
        binary search, for as long as it can still reach T.
        """
        lists = self.token[self.first[i] : self.first[i + 1]]
        lists = lists[self.length[lists] > 1]
        need = int(_ceil(self.n[i], num, den))
        if len(lists) < need or need == 0:
            return np.zeros(0, np.int64)
        lists = lists[np.argsort(self.length[lists], kind="stable")]
        longest = int(self.length[lists[-1]])
        n_long = min(need - 1, int(need / (MU * np.log2(longest) + 1)))
        short, long_ = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        merged = np.concatenate([self.postings[self.start[t] : self.start[t] + self.length[t]] for t in short])
        merged = np.sort(merged[open_[merged]], kind="stable")
        if not len(merged):
            return merged
        cut = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
        found, count = merged[cut], np.diff(np.append(cut, len(merged)))
        least = -(-(self.n[i] + self.n[found]) * num // (num + den))
        alive = count >= np.maximum(least - n_long, 1)
        found, count, least = found[alive], count[alive], least[alive]
        for left, t in enumerate(long_[::-1]):
            alive = count >= least - (n_long - left)
            found, count, least = found[alive], count[alive], least[alive]
            if not len(found):
                break
            post = self.postings[self.start[t] : self.start[t] + self.length[t]]
            at = np.minimum(np.searchsorted(post, found), len(post) - 1)
            count = count + (post[at] == found)
        return found[count >= least]


def links(value: np.ndarray, owner: np.ndarray, n: np.ndarray, num: int, den: int, label: np.ndarray | None = None, queries: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the components of a family. A set searches only sets outside its own component so far, and
    the search ends when one component is left. label: components known before; queries: the sets to search for."""
    lists = Lists(value, owner, n)
    comp = np.arange(len(n)) if label is None else label.copy()
    out = []
    n_comps = len(np.unique(comp))
    for i in np.arange(len(n)) if queries is None else queries:
        if n_comps == 1:
            break
        for j in lists.search(int(i), comp != comp[i], num, den):
            if comp[j] != comp[i]:
                out.append((int(i), int(j)))
                comp[comp == comp[j]] = comp[i]
                n_comps -= 1
    return out


def _search(dealt: DataFrame, keys: list[str], k: int, num: int, den: int) -> DataFrame:
    """(src, dst, whole): each text that links inside its group of `keys`, with the smallest key that links reach there;
    whole: the group is a whole family. Rows have __key, __text, __parts, and __label and __query where known."""
    labelled = "__label" in dealt.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, keys):
            key = table.column("__key").to_numpy()
            data, offsets = flat(table.column("__text"))
            value, owner, n = shingle_sets(data, offsets, k)
            label = queries = None
            if labelled:
                _, label = np.unique(table.column("__label").to_numpy(), return_inverse=True)
                queries = np.flatnonzero(table.column("__query").to_numpy(zero_copy_only=False))
            found = links(value, owner, n.astype(np.int64), num, den, label, queries)
            if found:
                least = np.arange(len(key))  # rows come by key, so the smallest number is the smallest key
                for a, b in found:
                    low, high = sorted((least[a], least[b]))
                    least[least == high] = low
                linked = np.flatnonzero(np.isin(least, least[np.array(found)[:, 0]]))
                whole = np.full(len(linked), table.column("__parts")[0].as_py() == 1)
                yield pa.RecordBatch.from_arrays([pa.array(key[linked]), pa.array(key[least[linked]]), pa.array(whole)], names=["src", "dst", "whole"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "__key").mapInArrow(run, "src long, dst long, whole boolean")


def _sent(marks: DataFrame) -> DataFrame:
    """Rows of a few numbers that texts are joined with: sent to all tasks, so that the texts stay where they are, up to
    MOST_SENT of them; beyond, texts meet them by shuffle."""
    return F.broadcast(marks) if marks.count() <= MOST_SENT else marks


def near_duplicates(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), k: int = 4, num: int = 85, den: int = 100, block: int = BLOCK) -> DataFrame:
    """`keep`, __n (set size), __class and __key (the text's hash) of every row: rows share a class exactly if links connect
    them. Columns of `keep` with those three names are left out.

    Equal texts are one set throughout, so copies cost nothing and link with no work. Empty sets (null or empty
    text, no words) have a null class and link with nothing. Families over `block` texts are searched in
    parts that all hold the family's first text; if that leaves more than one component, texts outside
    the largest one are searched against every part, in blocks. No pair is capped or sampled. Shingles are
    64-bit hashes. An empty table gives an empty result; repeated rows are copies.
    """
    bound_batches(df.sparkSession)
    kept = [c for c in dict.fromkeys(keep) if c not in ("__n", "__class", "__key")]
    df = df.select(packed(kept), named(text).alias("text"))
    base = materialised(signatures(df, "text", ["row"], k, num, den))
    entries = base.select("__key", "__n", F.explode("__prefix").alias("__h"))
    by_size = Window.partitionBy("__h").orderBy("__n", "__key")
    one = entries.withColumn("p", F.lag("__key").over(by_size)).where("p is null or p <> __key").drop("p")
    near = one.withColumns({"before": F.lag("__n").over(by_size), "after": F.lead("__n").over(by_size), "__df": F.count("*").over(Window.partitionBy("__h"))})
    common = near.where(F.coalesce(_may_link(F.col("before"), F.col("__n"), num, den), F.lit(False)) | F.coalesce(_may_link(F.col("__n"), F.col("after"), num, den), F.lit(False)))
    ranked = common.groupBy("__key", "__n").agg(F.array_sort(F.collect_list(F.struct("__df", "__h"))).alias("s"))
    n_kept = F.size("s") - _fewest_shared(F.col("__n"), num, den) + 1
    chosen = ranked.where(n_kept > 0).select("__key", "__n", F.explode(F.slice("s", 1, n_kept)).alias("e")).select("__key", "__n", F.col("e.__h").alias("__h"))
    # Of the texts that have a signature, runs by size without a step too large to link: partners are in one run, which hangs on its first.
    step = F.lag("__n").over(by_size)
    runs = chosen.withColumn("first", F.when(F.coalesce(_may_link(step, F.col("__n"), num, den), F.lit(False)), None).otherwise(F.col("__key")))
    star = runs.select("__key", F.last("first", ignorenulls=True).over(by_size).alias("head")).where("__key <> head")
    families = connected_components(star, "__key", "head").select(F.col("node").alias("__key"), F.col("component").alias("__family"))
    sizes = families.groupBy("__family").agg(F.ceil(F.count("*") / block).cast("int").alias("__parts"))
    members = materialised(families.join(sizes, "__family"))

    source = df.select(F.xxhash64("text").alias("__key"), F.col("text").alias("__text"))
    texts = materialised(source.join(_sent(members), "__key").dropDuplicates(["__key"]))  # of families only, for both searches
    own = F.pmod(F.xxhash64("__key"), F.col("__parts")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("__parts") - 1)
    parts = F.explode(F.when(F.col("__key") == F.col("__family"), everywhere).otherwise(F.array(own)))
    found = materialised(_search(texts.withColumn("__part", parts), ["__family", "__part"], k, num, den))
    classes = found.where("whole").select(F.col("src").alias("__key"), F.col("dst").alias("__class"))

    def over_parts(links: DataFrame) -> DataFrame:
        return connected_components(links).select(F.col("node").alias("__key"), F.col("component").alias("__class"))

    large = members.where("__parts > 1")
    if not large.isEmpty():
        within = found.where("not whole").drop("whole")
        large = materialised(large.join(over_parts(within), "__key", "left").withColumn("__label", F.coalesce("__class", "__key")).drop("__class"))
        per_label = large.groupBy("__family", "__label").agg(F.count("*").alias("c"))
        main = per_label.groupBy("__family").agg(F.max(F.struct("c", "__label")).alias("m"), F.sum("c").alias("all"))
        main = main.select("__family", F.col("m.__label").alias("__main"), (F.col("all") - F.col("m.c")).alias("__rest")).where("__rest > 0")
        open_ = large.join(main, "__family").withColumn("__asks", F.ceil(F.col("__rest") / block).cast("int"))
        told = texts.select("__key", "__text").join(open_, "__key").withColumn("__part", own)
        ask = F.pmod(F.xxhash64("__key"), F.col("__asks")).cast("int")
        each_ask, each_part = F.explode(F.sequence(F.lit(0), F.col("__asks") - 1)), F.explode(everywhere)
        columns = ["__family", "__ask", "__part", "__key", "__text", "__label", "__query", "__parts"]
        held = told.withColumn("__ask", each_ask).withColumn("__query", F.lit(False))
        asked = told.where("__label <> __main").withColumn("__ask", ask).withColumn("__part", each_part).withColumn("__query", F.lit(True))
        more = materialised(_search(held.select(columns).union(asked.select(columns)), ["__family", "__ask", "__part"], k, num, den))
        classes = classes.union(over_parts(within.union(more.drop("whole"))))
    rows = base.drop("__prefix").join(classes, "__key", "left")
    out = [F.col("row").getField(c).alias(c) for c in kept]
    return rows.select(*out, "__n", F.when(F.col("__n") > 0, F.coalesce("__class", "__key")).alias("__class"), "__key")


def components(df: DataFrame, text: str = "text", key: str = "doc_id", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(key, n_shingles, component_id): the smallest key that links reach from a row, itself included; a row
    without shingles has its own. Null keys are never the smallest unless a class has no other."""
    rows = materialised(near_duplicates(df.select(named(key).alias("id"), named(text).alias("text")), "text", ("id",), k, num, den))
    least = rows.where(F.col("__class").isNotNull()).groupBy("__class").agg(F.min("id").alias("__least"))
    joined = rows.join(least, "__class", "left")
    own = F.when(F.col("__class").isNull(), F.col("id")).otherwise(F.col("__least"))
    return joined.select(F.col("id").alias(key), F.col("__n").alias("n_shingles"), own.alias("component_id"))


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of df without all but one of each class: the one with the smallest key (null last) and text hash,
    one of those that repeat it. Rows without shingles stay. Columns and texts stay as they are. Rows are marked where they
    are: only those of the few marks (ids and hashes that go, or that several rows have) are looked up, and only rows that
    repeat another's id and text are moved."""
    used = {"id": key, "text": text}
    held = hold(df, used)
    rows = materialised(near_duplicates(held.select("id", "text"), "text", ("id",), k, num, den).where("__class is not null").select("__class", "id", F.col("__key").alias("hash")))
    each = rows.groupBy("__class", "id", "hash").agg(F.count("*").alias("n"))
    first = rows.groupBy("__class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("f"))
    chosen = F.col("id").eqNullSafe(F.col("f.id")) & (F.col("hash") == F.col("f.hash"))
    marks = each.join(first, "__class").select(F.col("id").alias("of_id"), F.col("hash").alias("of_hash"), chosen.alias("chosen"), "n").where("not chosen or n > 1")
    marks = materialised(marks.drop("n"))
    marked = held.withColumn("hash", F.xxhash64("text")).join(_sent(marks), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash")), "left")
    stays = marked.where("chosen is null").select(held.columns)
    if not marks.where("chosen").isEmpty():
        place = F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.lit(0)))
        stays = stays.unionByName(marked.where("chosen").withColumn("place", place).where("place = 1").select(held.columns))
    return release(stays, df, used)
