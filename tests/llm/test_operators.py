"""The operators against plain versions, on small tables with nulls, ties, copies, long texts and clashing columns."""

import gzip
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from veriloom.llm import decontamination, html_text, jaccard, licenses, mixing, quality, sharding, suffix_dedup, topk, warc
from veriloom.session import table

SF = "/root/testdata/sf0.001"
WORDS = "the of and to in is was for on with as by at from it be this that are or an".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "é"]) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Prose with shared passages, exact and near copies, periodic and empty texts."""
    rng = random.Random(11)
    passage = prose(rng, 90)
    out = [None, "", " \n\t", "a", "a b", "A  b", "ab " * 700, "x" * 3000, "x" * 399, "é" * 900, prose(rng, 9000)]
    base = [prose(rng, rng.randint(5, 300)) for _ in range(60)]
    out += base + base[:8] * 2
    out += [prose(rng, 30) + " " + passage + " " + prose(rng, 30) for _ in range(12)]
    for text in base[10:30]:
        words = text.split(" ")
        for _ in range(3):
            copy = list(words)
            for _ in range(rng.randint(1, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = "new" + str(rng.randint(0, 9999))
            out.append(" ".join(copy))
    out += [base[40][100:900], base[41] + base[42], base[43].upper()]
    return out


def frame(spark, texts, extra=""):
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, start string").repartition(5)


def test_suffix_dedup(spark, texts):
    rows = suffix_dedup.remove_repeats(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == brute.remove_repeats(texts)
    assert rows[0].key == "clash"
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in rows)
    assert suffix_dedup.remove_repeats(frame(spark, texts).limit(0)).count() == 0
    longer, least = (brute.starts_elsewhere(texts, n) for n in (suffix_dedup.SHARED, suffix_dedup.NEAR))
    copied = Counter(t for t in texts if t and len(t.encode()) >= suffix_dedup.SHARED)
    for r, whole, some in zip(rows, longer, least, strict=True):
        copies = copied[texts[r.doc_id]] > 1
        assert (not (whole or copies) or r.n_shared) and (some or copies or not r.n_shared)


def test_suffix_dedup_of_hot_cores(spark, texts, monkeypatch):
    """With room for few surroundings, common cores have their strings hashed; the rows are the same."""
    monkeypatch.setattr(suffix_dedup, "COLLECTION", 2)
    rng = random.Random(3)
    passage = prose(rng, 110)
    many = texts[:40] + [prose(rng, 25) + passage[rng.randint(0, 90) :] + prose(rng, 25) for _ in range(40)]
    rows = suffix_dedup.remove_repeats(frame(spark, many)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == brute.remove_repeats(many)


@pytest.mark.parametrize("seed", range(4))
def test_suffix_dedup_of_low_entropy(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab" if rng.random() < 0.2 else "a") for _ in range(rng.randint(380, 1500))) for _ in range(8)]
    texts += ["".join(texts[rng.randrange(8)][k : k + 300] for k in (0, 100, 250)) for _ in range(4)] + [texts[0]] * 2
    rows = suffix_dedup.remove_repeats(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == brute.remove_repeats(texts)


@pytest.mark.parametrize("seed", range(6))
def test_collection_transform(seed):
    rng = np.random.default_rng(seed)
    strings = rng.integers(0, rng.integers(1, 4), (int(rng.integers(1, 40)), int(rng.integers(1, 30)))).astype(np.uint16) + 1
    strings[len(strings) // 2 :] = strings[: len(strings) - len(strings) // 2]
    for need in (1, 3, 7):
        got = suffix_dedup.collection_repeats(strings, need)
        seen = Counter(tuple(s[o : o + need]) for s in strings for o in range(len(s) - need + 1))
        for k, s in enumerate(strings):
            for o in range(len(s)):
                assert got[k, o] == (o + need <= len(s) and seen[tuple(s[o : o + need])] > 1)


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (1, 50, 100)])
def test_jaccard_components(spark, texts, k, num, den):
    got = jaccard.components(frame(spark, texts), k=k, num=num, den=den).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute.components(list(enumerate(texts)), k, num, den)


def test_jaccard_in_small_blocks(spark, texts):
    """Families in parts: the second search finds what parts alone do not."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    family = []
    for i in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(60)] = f"z{i}{rng.randint(0, 99)}"
        family.append(" ".join(copy))
    rows = frame(spark, family)
    whole = {tuple(r) for r in jaccard.near_duplicates(rows, k=2, num=70).select("doc_id", "__n", "__class").collect()}
    parts = {tuple(r) for r in jaccard.near_duplicates(rows, k=2, num=70, block=3).select("doc_id", "__n", "__class").collect()}
    assert whole == parts
    expected = brute.components(list(enumerate(family)), 2, 70, 100)
    got = jaccard.components(rows, k=2, num=70).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected


def test_jaccard_families_hold_sizes_that_can_link(spark, monkeypatch):
    """A shingle that all texts share connects no texts whose sizes rule a link out; copies and near copies stay together."""
    texts = ["a b c d " + " ".join(f"w{i}x{j}" for j in range(4 * 2**i)) for i in range(8)]
    texts += [texts[7], texts[7].replace("w7x5", "other")]
    searched = []
    search = jaccard._search
    monkeypatch.setattr(jaccard, "_search", lambda dealt, *rest: searched.append(dealt.count()) or search(dealt, *rest))
    got = [r.component_id for r in jaccard.components(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [0, 1, 2, 3, 4, 5, 6, 7, 7, 7] and searched == [2]


def test_divide_skip_finds_every_link():
    rng = np.random.default_rng(4)
    base = np.sort(rng.choice(10_000, 80, replace=False)).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(80) < p, rng.integers(20_000, 90_000, 80), base).astype(np.uint64)) for p in rng.random(30) * 0.2]
    n = np.array([len(s) for s in sets])
    lists = jaccard.Lists(np.concatenate(sets), np.repeat(np.arange(30), n), n)
    for i in range(30):
        want = [j for j in range(30) if j != i and 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
        assert list(lists.search(i, np.arange(30) != i, 85, 100)) == want


def test_keep_one(spark, texts):
    source = frame(spark, texts)
    kept = jaccard.keep_one(source)
    assert kept.columns == source.columns
    classes = {}
    for key, n, c in brute.components(list(enumerate(texts)), 5, 80, 100):
        classes.setdefault(c if n else ("empty", key), []).append(key)
    got = sorted(r.doc_id for r in kept.collect())
    assert got == sorted(min(v) for v in classes.values())
    doubled = source.union(source).withColumn("doc_id", F.when(F.col("doc_id") > 20, F.col("doc_id")))
    assert jaccard.keep_one(doubled).where("text rlike '[^ \\\\n\\\\t]'").count() == sum(1 for c in classes if not isinstance(c, tuple))


def test_keep_one_leaves_texts_in_place(spark, texts, monkeypatch):
    source = frame(spark, texts)
    plan = jaccard.keep_one(source)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    want = sorted(r.doc_id for r in jaccard.keep_one(source.union(source)).collect())
    monkeypatch.setattr(jaccard, "MOST_SENT", 0)
    assert sorted(r.doc_id for r in jaccard.keep_one(source.union(source)).collect()) == want
    assert sorted(set(want)) == sorted(r.doc_id for r in jaccard.keep_one(source).collect())


def test_contamination(spark, texts, monkeypatch):
    rng = random.Random(8)
    items = [(i, prose(rng, 25)) for i in range(6)] + [(6, "one two three"), (7, None), (8, " . "), (9, "ONE, two"), (10, "1 2 3 4 5 6 7 8 9 10"), (11, "1 2 3 4 5 6 7 8 9 10"), (12, "zz " * 30)]
    docs = [*texts, prose(rng, 5) + " " + items[0][1] + " " + items[1][1][30:] + " " + prose(rng, 5), "so one two three! One, TWO", "0 1 2 3 4 5 6 7 8 9 10 11", "zz " * 11, items[2][1][:60], "zz " * 9 + "one"]
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    expected = brute.contamination(docs, items)
    source = frame(spark, docs).withColumn("__hits", F.lit("clash")).withColumn("found", F.lit("own"))
    for most in (1 << 25, 3):  # beyond it, fingerprints are joined by shuffle
        monkeypatch.setattr(decontamination, "MAX_PRINTS", most)
        rows = decontamination.digest(decontamination.search(source, benchmark, ("doc_id", "found"))).orderBy("doc_id").collect()
        assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in rows] == expected
        assert all(r.contaminated == (r.n_hit > 0) and r.found == "own" for r in rows)
        whole = decontamination.decontaminate(source, benchmark).orderBy("doc_id")
        assert set(whole.columns) == {*source.columns, *decontamination.ADDED}
        assert [(r.text, sum(h.b - h.a for h in r["__hits"]), len(r["__items"])) for r in whole.collect()] == [(t, e[1], e[2]) for t, e in zip(docs, expected, strict=True)]
        clean = decontamination.without_hits(source, benchmark, few=most)
        assert clean.columns == source.columns
        assert sorted(r.doc_id for r in clean.collect()) == [i for i, e in enumerate(expected) if not e[1]]
    empty = decontamination.digest(decontamination.search(source, benchmark.limit(0))).collect()
    assert len(empty) == len(docs) and not any(r.contaminated for r in empty)
    assert decontamination.search(source.limit(0), benchmark).count() == decontamination.without_hits(source.limit(0), benchmark).count() == 0


def test_contamination_of_a_large_benchmark():
    """What a worker holds of a benchmark is its fingerprints: 8 bytes for about every second word."""
    rng = np.random.default_rng(1)
    raw = np.frombuffer(" ".join(f"w{x}" for x in rng.integers(0, 10**6, 200_000)).encode(), np.uint8)
    held = decontamination.Words.of(raw, np.array([0, len(raw)]))
    (size, at, h), *_ = decontamination.fingerprints(held, [], decontamination.WINDOW, decontamination.GRAM)
    assert size == decontamination.WINDOW and 0.4 < len(at) / 200_000 < 0.6 and h.nbytes < 0.7 * len(raw)


def test_top_k(spark):
    rng = np.random.default_rng(9)
    vectors = rng.normal(0, 0.2, (300, 8)).astype(float)
    vectors[50:90] = vectors[10]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(400, None), (401, [None] + [0.5] * 7), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [0.1] * 8), (0, rows[0][1])]
    source = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash"))
    q = np.floor(np.concatenate([vectors, vectors[:1]]) * 64).astype(int)
    ids, expected = [*range(300), 0], []
    for i in [*range(0, 300, 20), 300]:  # the last row repeats the first one: both are queries, and candidates of each other
        order = sorted((-int(q[i] @ q[j]), ids[j]) for j in range(301) if j != i)[:20]
        expected += [(ids[i], r + 1, j, -s) for r, (s, j) in enumerate(order)]
    for shard in (8192, 40):
        got = topk.top_k(source, shard_rows=shard, block_queries=4 if shard == 40 else 4096)
        assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0, 1.0]), (20, [0.5])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(few).collect()) == [(0, 1, 1, 8192), (0, 2, 20, 2048), (20, 1, 1, 4096), (20, 2, 0, 2048)]
    twice = spark.createDataFrame([(20, [1.0]), (20, [-2.0]), (1, [0.5])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(twice).collect()) == [(20, 1, 1, -4096), (20, 1, 1, 2048), (20, 2, 20, -8192), (20, 2, 20, -8192)]
    assert topk.top_k(source.limit(0)).count() == 0


def test_top_k_of_clusters(spark):
    """Far clusters are not asked, whatever holds most rows; the result is that of all pairs."""
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 3, (12, 6))
    vectors = np.concatenate([m + rng.normal(0, 0.05, (n, 6)) for m, n in zip(middle, [400, *[30] * 11], strict=True)])
    source = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    q = np.floor(vectors * 64).astype(int)
    expected = []
    for i in range(0, len(q), 20):
        order = sorted((-int(q[i] @ q[j]), j) for j in range(len(q)) if j != i)[:20]
        expected += [(i, r + 1, j, -s) for r, (s, j) in enumerate(order)]
    got = topk.top_k(source, shard_rows=60, block_queries=5)
    assert sorted(tuple(r) for r in got.collect()) == expected
    c = topk.centres(q, 12)
    placed = topk._place(spark.createDataFrame([(i, i, [int(x) for x in v]) for i, v in enumerate(q)], "id long, number long, x array<long>"), c).toPandas()
    radius = np.array([placed[placed.cluster == i].distance.max() if (placed.cluster == i).any() else -1 for i in range(len(c))])
    best = {i: min(s for q_, _, _, s in expected if q_ == i) for i in range(0, len(q), 20)}
    asking = spark.createDataFrame([(i, i, [int(x) for x in q[i]], 0, 0, 0, best[i]) for i in best], "id long, number long, x array<long>, block int, cluster int, sub int, floor long")
    assert topk._reach(asking, c, radius).count() < 0.7 * len(best) * (radius >= 0).sum()


def test_sharding(spark, texts):
    rows = frame(spark, texts)
    rows = rows.union(rows.limit(20).withColumn("doc_id", F.lit(None).cast("long")))
    out = sharding.shard(rows)
    assert {"key", "start"} <= set(out.columns)
    got = sharding.with_slots(out.select("doc_id", "size", "shard", "grown_shard", F.crc32(F.coalesce("text", F.lit(""))).alias("c")), ties=("c", "size")).collect()
    assert all(r.grown_shard in (r.shard, 24) for r in got) and {r.shard for r in got} <= set(range(24))
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        if r.doc_id is not None:
            text = texts[r.doc_id] or ""
            assert r["size"] == len(text.encode()) + 8 and r.c == zlib.crc32(text.encode())
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(got) == len(texts) + 20
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    more = {r.doc_id: r.shard for r in sharding.shard(rows, 25).where("doc_id is not null").collect()}
    assert more == {r.doc_id: r.grown_shard for r in got if r.doc_id is not None}
    with pytest.raises(ValueError):
        sharding.shard(rows, 12)
    ids = spark.range(40_000)
    counts = Counter(r[0] for r in ids.select(sharding.shard_of(F.col("id"), sharding.tree(24))).collect())
    assert min(counts.values()) > 0.85 * 40_000 / 24 and len(counts) == 24


def test_weighted_tree(spark):
    heavy = {"a": {"k": {0: 3.0, 1: 1.0}}, "b": {"k": {2: 1.0}, "l": {3: 1.0}}}
    grown = {"a": {"k": {0: 3.0, 1: 1.0}}, "b": {"k": {2: 1.0}, "l": {3: 2.0}}}
    rows = spark.range(12_000).select(sharding.shard_of(F.col("id"), heavy).alias("a"), sharding.shard_of(F.col("id"), grown).alias("b")).collect()
    counts = Counter(r.a for r in rows)
    assert abs(counts[0] / 12_000 - 0.5) < 0.03 and abs(counts[1] / 12_000 - 1 / 6) < 0.02
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    assert moved and all(b in (2, 3) for _, b in moved), "rows move only into the subtree that grew"


def test_mixing(spark, texts):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(1, 80)) if i % 50 else None, [None, "a", "b", "ä", "big"][min(4, rng.randint(0, 9))]) for i in range(800)]
    source = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix_sources(source).collect()
    again = mixing.mix_sources(source.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == 803
    sizes = Counter()
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", rows[r.doc_id][1] or ""))
        sizes[r.source] += r["size"]
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        taken, target = sum(r.taken for r in mine), mine[0].target
        assert abs(taken - target) <= max(5, 0.001 * target) and target <= 3 * sizes[s] + 1e-6
        assert all(r.taken == r.copies * r["size"] <= 3 * r["size"] for r in mine)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(sum(sizes.values()))
    assert mixing.mix_sources(source.limit(0)).count() == 0


def plain_targets(sizes, weights=(5, 2, 1), cap=3.0):
    """The excess shared anew until none is above, round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, total, out = set(names), float(sum(sizes.values())), {}
    while left:
        share = sum(weight[s] for s in left)
        over = {s for s in left if total * weight[s] / share > cap * sizes[s]}
        out |= {s: cap * sizes[s] for s in over} if over else {s: total * weight[s] / share for s in left}
        total -= sum(cap * sizes[s] for s in over)
        left -= over or left
    return out


@pytest.mark.parametrize("sizes", [{"b": 10, "a": 10, None: 980}, {"a": 0}, {"x": 5, "y": 5, "z": 5}, {"a": 1, "ab": 2, "b": 900, "c": 3, "é": 7, "\U0001f600": 60, "\uffff": 4, None: 0}])
def test_targets(spark, sizes):
    table_ = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(table_).collect()}
    want = plain_targets(sizes)
    assert set(got) == set(want) and all(got[s] == pytest.approx(want[s]) for s in want)


@pytest.mark.parametrize("start", [0.0, 0.3, 1 - 2**-20, 1 - 2**-48])
def test_rates_keep_to_the_target(start):
    """Any offset: a document has three copies at most, and the words taken come near the target."""
    rng = random.Random(8)
    for _ in range(60):
        groups = sorted({rng.choice([1, 2, 3, 9, 40, 300, rng.randint(1, 5000)]): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}.items(), reverse=True)
        total = sum(s * n for s, n in groups)
        target = total * rng.choice([0.1, 0.5, 1.0, 2.5, 3.0])
        taken = 0
        for (size, n), (upto, rate) in zip(groups, mixing.rates(target, total, start, groups), strict=True):
            copies = [min(3, int(np.floor(upto + rate * (i + 1)) - np.floor(upto + rate * i))) for i in range(n)]
            assert 0 <= min(copies) and max(copies) <= 3 and 0 <= rate <= 3
            taken += sum(copies) * size
        assert abs(taken - target) <= groups[0][0] * (1 if start < 1 - 2**-21 or start == 1 - 2**-20 else 2) + 1e-6


def test_mixing_of_the_tables(spark):
    """Every source of the tables is within 20 words of its target or as near as its smallest documents allow."""
    rows = mixing.mix_sources(table(spark, "/root/testdata/sf0.01", "documents")).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("copies").alias("c"), F.min("size").alias("s")).collect()
    assert all(abs(r.t - r.g) <= max(40, 0.005 * r.g) and r.c <= 3 for r in rows), [tuple(r) for r in rows]


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body class="page">
<header><h1>Site name that is quite long for a header</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>About us and all our friends</a></ul></nav>
<div class="cookie-notice">We use cookies and would like you to agree to all of them now.</div>
<article><header><h1>Head &eacute;</h1></header><p>First   long paragraph of <b>the&nbsp;article</b> with words enough to count.<p>Ti.</p>
<ul><li>one item<li>two <i>items</i></ul><div class="ad">Buy this very good thing today, it is on offer for everyone.</div>
<p>Last paragraph, 1 &lt; 2 &#x26; more words to make it long.</p><aside>Related things that are long enough to look like text.</aside></article>
<section id="comments"><p>A reader says that this is a very long comment with many words in it.</p></section>
<form><p>Sign up for our letter with many words in the text here</p></form><footer>&copy; all the long footer words that go on and on</footer></body></html>"""


def test_html_text(spark):
    want = "Head é\nFirst long paragraph of the article with words enough to count.\nTi.\none item\ntwo items\nLast paragraph, 1 < 2 & more words to make it long."
    assert html_text.main_text(PAGE) == want
    no_article = PAGE.replace("<article>", "<div class=content>").replace("</article>", "</div>")
    got = html_text.main_text(no_article)
    assert "First long paragraph" in got and "Last paragraph" in got and "cookies" not in got and "footer" not in got and "reader says" not in got
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "just words"), (5, "u", "<p>open <b>tags <i>only"), (1, "u", PAGE), (6, "u", "<p>" + "long words " * 40_000), (7, "u", "<!-- x <script>")]
    source = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = {(r.page_id, r.text, r.n_chars) for r in html_text.extract(source).collect()}
    assert (1, want, len(want)) in out and (2, "", 0) in out and (3, "", 0) in out and (4, "just words", 10) in out and (5, "open tags only", 14) in out
    assert any(p == 6 and n == len("long words " * 40_000) - 1 for p, _, n in out) and any(p == 7 for p, _, _ in out)


@pytest.mark.parametrize("wrapper", ["div class='site-content has-sidebar'", "div class=no-sidebar", "div id=layout-right-sidebar", "div class='row menu-open'", "form action=x.aspx", "div class=postAdFree"])
def test_html_layout_wrappers(wrapper):
    """A wrapper with a boilerplate name is layout; marked blocks beside or inside the article stay out."""
    want = html_text.main_text(PAGE)
    body = PAGE[PAGE.index("<article>") :].replace("</body></html>", "")
    tag = wrapper.split()[0]
    wrapped = f"<html><body><nav>Home and more</nav><{wrapper}>{body}</{tag}></body></html>"
    assert html_text.main_text(wrapped) == want
    assert html_text.main_text(wrapped.replace("<article>", "<main><article>").replace("</article>", "</article></main>")) == want
    assert html_text.main_text(f"<main><p>x</p><{wrapper}>{body}</{tag}></main>").endswith(want)
    bare = html_text.main_text(wrapped.replace("<article>", "<div>").replace("</article>", "</div>"))
    assert "First long paragraph" in bare and "Last paragraph" in bare and not re.search("footer|reader says|Sign up|Related|Buy this", bare)


def test_html_long_comments_stay_out():
    comments = "<section id=comments>" + "<article><p>A reader says that this is a very long comment with many words in it.</p></article>" * 30 + "</section>"
    text = "One paragraph of the text, with words enough to be dense."
    for tag in ("div", "article"):
        assert html_text.main_text(f"<body><{tag}><p>{text}</p><p>{text}</p></{tag}>{comments}</body>") == f"{text}\n{text}"


def test_html_article_over_sibling_blocks():
    """Without <article>, text beside the block that holds most of it is kept."""
    line = lambda i: f"Sentence number {i} of this article, which is long enough to be dense."
    p = lambda a, b: "".join(f"<p>{line(i)}</p>" for i in range(a, b))
    head, n = "<h1>Title</h1><p>A short intro.</p>", 20
    want = ["Title", "A short intro.", *map(line, range(n))]
    for body in (
        f"<div>{head}<section>{p(0, 14)}</section><section>{p(14, n)}</section></div>",
        f"<div>{head}{p(0, 3)}<blockquote>{p(3, 17)}</blockquote>{p(17, n)}</div>",
        f"<div>{head}<ul><li>" + "<li>".join(map(line, range(n))) + "</ul></div>",
        f"<div>{head}{p(0, 2)}<table><tr><td>{p(2, 18)}</td><td>{p(18, n)}</td></tr></table></div>",
    ):
        got = html_text.main_text(f"<html><body><nav><a href=/>Home</a></nav>{body}<footer>All the long footer words that go on and on</footer></body></html>")
        assert got.split("\n") == want


def sentences(start, n):
    return [f"Sentence number {i} of this article, which goes on for long enough to be taken for dense text." for i in range(start, start + n)]


BODIES = {
    "flat": ("<h1>A title</h1><p>{0}</p><p>{1}</p><p>Short.</p><p>{2}</p>", ["A title", 0, 1, "Short.", 2]),
    "parts": ("<h1>A title</h1><p>Intro.</p><section><h2>One</h2><p>{0}</p><p>{1}</p></section><section><h2>Two</h2><ul><li>{2}<li>item</ul></section>", ["A title", "Intro.", "One", 0, 1, "Two", 2, "item"]),
    "ads": ("<h1>A title</h1><p>{0}</p><div class='ad'>Buy this thing today, on offer for everyone and all.</div><p class='related-work'>{1}</p><p>{2}</p><nav><a href=/>next</a></nav>", ["A title", 0, 1, 2]),
    "open": ("<h1>A title<p>One <b><i><u><em><span><a><b><i><u><s>words here<p>{0}<p>{1}<blockquote><p>{2}</blockquote>", ["A title", "One words here", 0, 1, 2]),
}
WRAPPERS = (
    "", "<div class='wrap has-sidebar'>", "<div class='layout has-sidebar'>", "<div class='with-menu'>", "<div class='search-form-page'>", "<div id='has-related'>", "<form action=x>", "<nav><ul><li><a href=/>Home</a><li>",
    "<div>" * 200, "<div class='widget-area'><div class='page-with-comments'>",
)
NOISE = (
    "<ul class=menu><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/c>Contact us</a></li></ul>",
    "<div class=cookie-notice>We use cookies and would like you to agree to all of them.</div>",
    "<div id=comments><div class=comment><p>A reader says that this is a long comment with many words.</p></div><div class=comment><p>Another reader does not agree with that at all, and says so.</p></div></div>",
    "<aside>Other things that are long enough to look like the text of the article.</aside><footer>Copyright of all the long footer words that go on and on</footer>",
)


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_html_pages_made_by_hand(wrapper, tag):
    """Pages put together from known blocks, with and without <article>: the text is the article's blocks."""
    long_ = sentences(0, 3)
    for body, parts in BODIES.values():
        want = "\n".join(long_[x] if isinstance(x, int) else x for x in parts)
        page = f"<html><head><title>T</title></head><body>{NOISE[0]}{NOISE[1]}{wrapper}<{tag}>{body.format(*long_)}</{tag}>{NOISE[2]}{NOISE[3]}</body></html>"
        if tag == "div" and "nav" in wrapper:
            # Nothing tells such an article from the open menu but its density.
            assert set(long_) <= set(html_text.main_text(page).split("\n"))
        else:
            assert html_text.main_text(page) == want


def test_html_page_builder_blocks():
    long_ = sentences(0, 6)
    blocks = "".join(f"<div class='builder-widget text-block'><p>{x}</p></div>" for x in long_)
    page = f"<body>{NOISE[0]}<div class=row>{blocks}</div>{NOISE[2]}{NOISE[3]}</body>"
    assert html_text.main_text(page) == "\n".join(long_)


def test_html_depth_costs_no_more_than_length():
    """Tens of thousands of open elements, stray end tags and marks are walked once."""
    import time

    began, n = time.perf_counter(), 20_000
    text = sentences(0, 1)[0]
    for page in (
        "<div>" * n + f"<p>{text}</p>", "<b>" * n + "<div>x</div>" * n, "<div>" * n + "</p></i></li>" * n, "".join(f"<div class='ad x{i}'>" for i in range(n)) + text,
        "<ul>" + "<li class=comment><p>words here" * n, "<p>" + "<b>" * n + f"{text}<p>{text}",
    ):
        html_text.main_text(page)
    assert time.perf_counter() - began < 60


def test_html_pages_of_the_tables(spark):
    """Article text of the tables' pages, taken with a pattern that fits only them."""
    import html

    for r in table(spark, SF, "pages").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)[^>]*>", inner)
        want = "\n".join(b for b in (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " " if "<br" in x else "", x))).strip() for x in blocks) if b)
        assert html_text.main_text(r.html) == want


NEVER = [
    '<script>track("a < b");</script>', "<style>p{color:red}</style>", "<noscript>Switch it on, please do</noscript>", "<button>Buy now</button>", '<span hidden>hidden words</span>',
    '<span class="ad">an advert</span>', "<svg><title>icon</title><text>x</text></svg>", "<textarea>type</textarea>", '<b aria-hidden="true">not said</b>', "<select><option>one<option>two</select>",
    "<template><p>later</p></template>", "<canvas>no canvas</canvas>", "<!-- a remark -->", "<iframe>frame</iframe>",
]
AROUND = [
    "<nav><ul><li><a href=/a>Home</a><li><a href=/b>Contact us today</a></ul></nav>", '<div class="ad">Buy this thing today, it is cheap and very good.</div>', '<div class="cookie-notice">We use cookies, please agree to that.</div>',
    "<footer>Copyright by the people of this site, all rights reserved.</footer>", '<aside>Other things that one may like to read some day.</aside>', '<form><label>Mail</label><input name=m><p>Sign up for our letter, it is free.</p></form>',
    '<div class="sidebar">{long} {long} {long}</div>', '<div id="user-feedback"><p>A reader says: {long}</p></div>', '<section class="comments"><p>{long}</p><p>{long}</p></section>', '<div class="related">More to read: {long}</div>',
]


def _page(rng):
    """A page and its main text: an article in one of several containers, with what never counts inside its paragraphs and
    furniture around it and between its blocks."""
    long = lambda n=None: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "é", ","]) for _ in range(n or rng.randint(18, 45))) + "."
    # The article holds several paragraphs, so that it is the page's main text by any measure.
    blocks, text = [], []
    title = long(6)
    for _ in range(rng.randint(4, 9)):
        words = long().split(" ")
        at = rng.randrange(1, len(words))
        inner = rng.choice(NEVER) if rng.random() < 0.6 else ""
        tag = rng.choice(["p", "p", "p", "blockquote", "h2"])
        if tag == "h2":
            words, inner = words[:5], ""
        body = " ".join(words[:at]) + " " + inner + " " + rng.choice(["", "<b>", "<i>"]) + " ".join(words[at:])
        blocks.append(f"<{tag}>{body}</{tag}>")
        text.append(" ".join(words))
        if rng.random() < 0.25:
            blocks.append(rng.choice(AROUND[:2] + AROUND[7:]).format(long=long()))
    around = lambda: "".join(rng.choice(AROUND).format(long=long()) for _ in range(rng.randint(0, 3)))
    head, body = f"<h1>{title}</h1>", "".join(blocks)
    kind = rng.choice(["article", "main", "beside", "div", "card", "header"])
    inside = {
        "article": f"<article>{head}{body}</article>", "main": f"<main>{head}{body}</main>", "beside": f"{head}<main>{body}</main>", "div": f"<div class='content'>{head}{body}</div>",
        "card": f"<div class='content'>{head}{body}</div><article>A short card to click</article>", "header": f"<header>{head}</header><article>{body}</article>",
    }[kind]
    html = f"<!DOCTYPE html><html><head><title>{title} - Site</title>{rng.choice(NEVER[:2])}</head><body>{around()}{inside}{around()}</body></html>"
    return kind, html, "\n".join([title, *text])


def test_html_of_generated_pages():
    rng = random.Random(77)
    wrong = Counter()
    for i in range(500):
        kind, page, want = _page(rng)
        got = html_text.main_text(page)
        if got != want:
            wrong[kind] += 1
            if sum(wrong.values()) < 4:
                print(kind, repr(page), repr(got), repr(want), sep="\n")
    assert not wrong


def test_html_by_hand():
    main = html_text.main_text
    assert main('<article><p>A</p><script>track("a");</script><p>B</p></article>') == "A\nB"
    assert main("<p>A<svg><title>icon</title></svg> tail</p>") == "A tail"
    assert main("<title>T<body><p>x") == "x" and main("<head><title>t</title><p>body text") == "body text"
    assert main("<p>x<script>never closed </p>") == "x"


def test_warc(spark, tmp_path):
    rows = [(1, "u1", "<p>a</p>"), (2, "u2", "<p>a</p>"), (3, None, "é\r\n\r\nWARC/1.1\r\n"), (4, "u\r\nX: y", None), (5, "u", ""), (None, "u", "<p>a</p>"), (2, "u2", "<p>a</p>"), (6, "u", "z" * 300_000)]
    source = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).repartition(3)
    got = warc.archive(source, folder=str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    import base64
    import hashlib

    html = {r[0]: r[2] or "" for r in rows}
    for r in got:
        assert r.payload_bytes == len(html[r.page_id].encode())
        assert r.payload_digest == base64.b32encode(hashlib.sha1(html[r.page_id].encode()).digest()).decode()
    kinds = sorted(((r.page_id or 0), r.record_type, r.refers_to) for r in got)
    assert kinds == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "revisit", 2), (3, "response", None), (4, "revisit", 5), (5, "response", None), (6, "response", None)]
    files = list((tmp_path / "w" / "deduplicated").glob("*.gz"))
    records = [x for f in files for x in warc.parse(gzip.decompress(f.read_bytes()))]
    assert len(records) == len(rows) and all(b.endswith(b"\r\n\r\n") and h["WARC-Profile"] for _, h, b in records if h["WARC-Type"] == "revisit")
    # A revisit names the record it revisits, by the id that this has in the same archives.
    ids = {h["WARC-Record-ID"]: h for _, h, _ in records}
    assert len(ids) == len(rows)
    for _, h, _ in records:
        if h["WARC-Type"] == "revisit":
            original = ids[h["WARC-Refers-To"]]
            assert original["WARC-Type"] == "response" and original["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
    assert not (tmp_path / "w" / "raw").exists()
    small = warc.archive(source.where("page_id < 3"), least_bytes=100).collect()
    assert {r.record_type for r in small} == {"response"}
    assert warc.archive(source.limit(0)).count() == 0


def test_warc_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4_000)
    rows = [(i, "u", chr(97 + i) * 1_000) for i in range(20)]
    assert warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder=str(tmp_path / "w")).count() == 20
    assert len(list((tmp_path / "w" / "deduplicated").glob("*.gz"))) >= 5


def test_one_long_page_leaves_the_other_files_as_they_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 20)
    rows = [(i, "u", f"{i} " * 200) for i in range(60)]
    number = []
    for name, more in (("a", []), ("b", [(60, "u", "z" * 400_000), (61, "u", "z" * 400_000), (62, "u", "y" * 9_000)])):
        got = warc.archive(spark.createDataFrame(rows + more, "page_id long, url string, html string").coalesce(1), folder=str(tmp_path / name)).collect()
        assert sorted(r.page_id for r in got) == list(range(60 + len(more)))
        number.append(len(list((tmp_path / name / "deduplicated").glob("*.gz"))))
    assert 3 <= number[0] <= 4 and number[1] <= number[0] + 3
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.page_id > 59) == [(60, "revisit", 61), (61, "response", None), (62, "response", None)]


def test_quality(spark):
    documents, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    held = labels.where("doc_id % 3 = 0")
    got = quality.classify(documents, labels.where("doc_id % 3 <> 0")).join(held, "doc_id").toPandas()
    clean = got[(got.quality == 1) & (got.toxic == 0)]
    junk = got[got.quality == 0]
    assert clean.keep.mean() > 0.95 and junk.keep.mean() < 0.2 and got[got.toxic == 1].keep.mean() < 0.35
    narrow = quality.classify(documents, labels.where("doc_id % 3 <> 0"), columns=("doc_id", "lang")).join(held, "doc_id").toPandas()
    both = got.merge(narrow, on="doc_id")
    assert len(both) == len(got) and (both.keep_x == both.keep_y).all() and np.allclose(both.p_quality_x, both.p_quality_y)


def test_quality_against_plain_sums(spark):
    """Site posteriors and decisions from the document's evidence, by loops over all rows."""
    documents, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.fit(documents, labels)
    held = [(r.doc_id, r.source, r.lang, r.bad, r.toxic) for r in quality.evidence(documents.select("doc_id", "source", "lang", "text"), model, False).collect()]
    sig = lambda x: 1 / (1 + np.exp(-x))
    good = {d: sig(-(bad + model.prior[0])) for d, _, _, bad, _ in held}
    sites = {level: {} for level in ("host", "path")}
    for d, host, path, *_ in held:
        for level, name in (("host", host), ("path", (host, path))):
            n, g = sites[level].get(name, (0, 0.0))
            sites[level][name] = (n + 1, g + good[d])
    n, g = len(held), sum(good.values())
    share = (g + 1) / (n + 2)

    def strength(level):
        spread = sum(b * b / a for a, b in sites[level].values()) / n - share**2 - share * (1 - share) * len(sites[level]) / n
        return min(1e4, max(2.0, share * (1 - share) / spread - 1)) if spread > 1e-9 else 1e4

    host_good = {h: (b + strength("host") * share) / (a + strength("host")) for h, (a, b) in sites["host"].items()}
    path_good = {p: (b + strength("path") * host_good[p[0]]) / (a + strength("path")) for p, (a, b) in sites["path"].items()}
    got = {r.doc_id: r for r in quality.classify(documents, labels).collect()}
    for d, host, path, bad, toxic in held:
        (host_n, host_g), (path_n, path_g) = sites["host"][host], sites["path"][host, path]
        rest = (host_g - good[d] + strength("host") * share) / (host_n - 1 + strength("host"))  # the site without the document
        prior = (path_g - good[d] + strength("path") * rest) / (path_n - 1 + strength("path"))
        prior = min(1 - 1e-4, max(1e-4, prior))
        p_quality, p_toxic = sig(np.log(prior / (1 - prior)) - bad), sig(toxic + model.prior[1])
        assert got[d].path_good == pytest.approx(path_good[host, path], rel=1e-6) and got[d].p_quality == pytest.approx(p_quality, rel=1e-6, abs=1e-12)
        assert got[d].keep == (p_quality >= 0.5 and p_toxic < 0.5)


def test_quality_edges(spark, texts):
    source = frame(spark, texts).withColumnRenamed("key", "lang").withColumn("keep", F.lit("clash"))
    labels = spark.createDataFrame([(0, 1, 0), (1, None, 0), (99999, 0, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(source, labels).collect()
    assert len(got) == len(texts) and all(0 <= r.p_quality <= 1 and 0 <= r.p_toxic <= 1 for r in got)
    assert quality.classify(source, labels.limit(0)).count() == len(texts)
    assert quality.classify(source.limit(0), labels).count() == 0


def test_posteriors_shrink(spark):
    rows = [("big", "p", -4.0)] * 200 + [("big", "q", -4.0)] * 200 + [("bad", "p", 4.0)] * 200 + [("tiny", "p", 4.0)] + [(None, None, 0.0)]
    scored = spark.createDataFrame(rows, "host string, path string, bad double").withColumn("toxic", F.lit(0.0))
    model = quality.Model([], [], [0.0, 0.0])
    got = {(r[0], r[1]): r for r in quality.posteriors(scored, model).collect()}
    assert got["big", "p"].path_good > 0.9 and got["bad", "p"].path_good < 0.1
    assert 0.1 < got["tiny", "p"].path_good < 0.7, "one bad row does not condemn a site"
    assert (None, None) in got


def test_licenses(spark):
    line = "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, f"text\n{line}\nmore"), (2, "Released under the MIT License."), (3, "You need a license to drive a car"), (4, None), (5, ""), (1, f"text\n{line}\nmore"),
        (6, "This work is licensed under the GNU General Public License, version 3."), (7, "Licensed under CC BY-NC 4.0."), (8, "nothing\nhere"), (9, "license"), (10, "word " * 50_000 + "\n" + line),
    ]
    source = spark.createDataFrame(rows, "doc_id long, text string").withColumn("family", F.lit("clash"))
    scanned = licenses.scan(source)
    got = sorted((r.doc_id, r.paragraph, r.family, r.confirmed) for r in scanned.collect())
    assert [g for g in got if g[0] in (1, 2, 6, 7, 10)] == [(1, 0, "apache", True), (1, 0, "apache", True), (2, 0, "mit", True), (6, 0, "gpl", True), (7, 0, "cc-by-nc", True), (10, 0, "apache", True)]
    assert [g for g in got if g[0] in (3, 9)] == [(9, 0, "unknown", False)] and not any(g[0] in (4, 5, 8) for g in got)
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert licenses.scan(source.limit(0)).count() == 0


HEADERS = {
    "mit": "Copyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one",
}


def granted(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("confirmed").collect()
    return sorted((r.doc_id, r.paragraph, r.family) for r in rows)


def test_licenses_of_wrapped_headers(spark):
    texts = [f"a\n\n{t}" for t in HEADERS.values()] + ["/*\n * " + t.replace("\n", "\n * ") + "\n */" for t in HEADERS.values()] + ["dnl " + t.replace("\n", "\ndnl ") for t in HEADERS.values()]
    got = granted(spark, texts)
    assert [(d, f) for d, _, f in got] == [(i, f) for i, f in enumerate([*HEADERS] * 3)]
    assert [p for _, p, _ in got[:4]] == [4, 2, 2, 2]


def test_licenses_by_short_name(spark):
    names = {
        "Distributed under GPL-3.0": ["gpl"], "CC-BY-SA 4.0": ["cc-by-sa"], "Apache-2.0": ["apache"], "Dual MIT/GPLv2": ["gpl", "mit"], "SPDX-License-Identifier: BSD-3-Clause": ["bsd"], "MPL-2.0": ["mpl"],
        "CC-BY-4.0": ["cc-by"], "CC-BY-NC-4.0": ["cc-by-nc"], "SPDX-License-Identifier: MIT": ["mit"], "Distributed under the MIT License": ["mit"], "LGPL-2.1": ["lgpl"], "er kam mit den anderen": [], "a lecture at MIT": [],
        "an Apache server": [], "permission was granted to modify the binary": [], "CC-BY-NC-SA 4.0": ["cc-by-nc-sa"], "CC0-1.0": ["cc0"], "EPL-2.0": ["epl"], "EUPL-1.2": ["eupl"], "CC BY-ND 4.0": ["cc-by-nd"],
        "MIT or Apache-2.0": ["apache", "mit"], "GPLv3": ["gpl"], "SPDX-License-Identifier: AGPL-3.0-only": ["agpl"], "This is free and unencumbered software released into the public domain.": ["unlicense"],
    }
    assert granted(spark, names) == sorted((i, 0, f) for i, fs in enumerate(names.values()) for f in fs)


def test_unknown_licenses(spark):
    texts = ["All rights reserved.", "Copyright (c) 2021 Some Body", "Licensed under terms that nobody has seen", "You need a license to drive a car", "a driving licence", "plain words"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.family, r.confirmed) for r in got] == [(i, "unknown", False) for i in range(3)]


def test_license_search_loses_nothing(spark):
    """Texts without a cue have no n-gram that is a feature, whatever stands between words."""
    rng = random.Random(2)
    pieces = [*licenses.STEMS, *(w for r in licenses.RUNS for w in r.split()), "nc", "sa", "4", "x", "Ünd", "é"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "-", "/", "\n", "_", ". ", "", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(4000)]
    texts = [t.upper() if i % 3 == 0 else t for i, t in enumerate(texts)]
    kept = {r.text for r in spark.createDataFrame([(t,) for t in texts], "text string").where(licenses.has_cue(F.col("text"))).collect()}
    held = {t for t in texts if re.search(licenses.CUES, " ".join(licenses._words(t)))}
    assert held <= kept and len(kept) < len(set(texts))


def test_license_model_is_calibrated():
    """Of the rows that the fit did not see, nearly all have their classes, and certain ones are right."""
    rows = licenses.training_rows()
    order = random.Random(7).sample(range(len(rows)), len(rows))
    vocabulary = {g: i for i, g in enumerate(sorted({g for tokens, _ in rows for g in licenses._grams(tokens) if re.search(licenses.CUES, g)}))}
    x, y = licenses._matrix(rows, vocabulary)
    held, kept = order[: len(rows) // licenses.HELD_OUT], order[len(rows) // licenses.HELD_OUT :]
    w, b = licenses._fit(x[kept], y[kept])
    p = 1 / (1 + np.exp(-(x[held] @ w + b)))
    assert ((p >= 0.5) == (y[held] > 0)).all(axis=1).mean() > 0.85 and (y[held] > 0)[p >= 0.9].mean() > 0.97
    weights, start = licenses.trained()
    assert len(weights) < 0.2 * len(vocabulary) * len(start) and all(v < 0 for v in start.values())


def test_licenses_in_long_lines(spark):
    """A whole template in a line of any length, and two of different families in one line."""
    rng = random.Random(5)
    filler = lambda n: " ".join(f"{rng.choice(WORDS)} w{rng.randint(0, 99)}" for _ in range(n))
    grant = {f: t[0] for f, t in licenses.TEMPLATES.items()}
    texts = [f"{filler(400)} {t} {filler(400)}" for t in grant.values()] + [f"{filler(300)} {grant['mit']} {filler(300)} {grant['gpl']} {filler(5000)}"]
    want = [(i, 0, f) for i, f in enumerate(grant)] + [(len(grant), 0, "gpl"), (len(grant), 0, "mit")]
    assert granted(spark, texts) == sorted(want)


#: Names that the operators use inside, or add, or that they once lost.
CLASHES = (
    "key", "id", "row", "text2", "size", "shard", "slot", "law", "copies", "taken", "target", "source_size", "rate", "offset", "offsets", "of", "i", "h", "hash", "place", "n_words", "found", "hits", "items", "k1", "k2",
    "host", "path", "bad", "toxic", "keep", "host_good", "site_host", "p_quality", "start", "end", "ranges", "shared", "core", "around", "near", "second", "paragraph", "family", "norm", "a", "b", "w", "html2",
    "__ranges", "__hash", "__place", "__id", "__host", "__path", "__n", "__bad", "__g0", "__p", "__shift", "__at", "__part", "__s", "__rate", "__of", "__line", "__hits", "__row", "__key", "__class", "with.dot", "none",
)


@pytest.fixture(scope="module")
def clashing(spark, texts):
    rows = spark.createDataFrame([(i, t, f"s{i % 3}", "en") for i, t in enumerate(texts[:60])], "doc_id long, text string, source string, lang string")
    return rows.select("*", *[F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in CLASHES])


def _clash_values(out, left=()):
    """Every clashing column that the operator does not replace has its own values."""
    names = [n for n in CLASHES if n not in left]
    for r in out.select("doc_id", *[F.col(f"`{n}`") for n in names]).collect():
        assert all(r[n] == f"{n}-{r.doc_id}" for n in names), r


def test_clashing_columns(spark, clashing):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, " ".join(WORDS))], "item_id int, text string")
    _clash_values(suffix_dedup.remove_repeats(clashing))
    _clash_values(jaccard.keep_one(clashing))
    _clash_values(quality.classify(clashing, labels), ("keep", "host_good", "p_quality"))
    _clash_values(decontamination.without_hits(clashing, benchmark))
    _clash_values(decontamination.decontaminate(clashing, benchmark), ("__hits",))
    _clash_values(decontamination.search(clashing, benchmark, ("doc_id", *CLASHES)), ("__hits",))
    added = ("size", "source_size", "target", "copies", "taken")
    _clash_values(mixing.mix_sources(clashing, keep=CLASHES), added)
    dotted = clashing.withColumnsRenamed({"doc_id": "doc.id", "text": "te.xt"})
    assert sharding.shard(dotted, key="doc.id", text="te.xt").where("shard is null").isEmpty()
    assert jaccard.components(dotted, text="te.xt", key="doc.id").count() == 60
    _clash_values(sharding.with_slots(sharding.shard(clashing)), ("size", "law", "shard", "slot", "grown_shard"))
    _clash_values(html_text.extract(clashing.withColumn("html", F.col("text"))))
    _clash_values(licenses.scan(clashing.withColumn("text", F.lit("MIT License")), keep=("doc_id", *CLASHES)), ("paragraph", "family"))
    rows = jaccard.near_duplicates(clashing, keep=("doc_id", *CLASHES))
    _clash_values(rows, ("__n", "__class", "__key"))


def test_sharding_of_an_empty_table(spark, texts):
    none = frame(spark, texts).limit(0)
    assert sharding.with_slots(sharding.shard(none)).count() == 0
