"""Phrases, binary records and manifests against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from veriloom.llm import collocations, manifest, queries, records
from veriloom.session import table

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def plain_collocations(rows, depth, least, percent, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, depth + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in held.items():
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in held.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(6)
    words = ["the", "of", "New", "york", "é", "a\x01", "a", "\x00", "b'c", "😀", "ab", "A\x1f"]
    text = lambda n: "".join(rng.choice(words[: rng.randint(2, 12)]) + rng.choice([" ", " ", " ", "\t", ". ", "\n", ", ", "  ", "\r\n"]) for _ in range(n))
    rows = [(rng.choice(["en", "en", None, "und", "fr x", ""]), text(rng.randint(0, 60))) for _ in range(150)]
    return rows + [("en", None), ("en", ""), ("de", "solo"), ("en", "New york city " * 400), ("zz", "x " * 30)]


@pytest.mark.parametrize("depth, least, percent, top, trie, cut, of_range", [(3, 10, 50, 2000, 1 << 21, 4 << 20, 8 << 20), (3, 3, 50, 40, 37, 64, 400), (4, 2, 70, 2000, 500, 1 << 20, 900), (2, 5, 50, 5, 100, 10, 1500)])
def test_collocations(spark, phrases, monkeypatch, depth, least, percent, top, trie, cut, of_range):
    """In one trie, and in tries of a few words whose n-grams cross their borders, merged over many ranges."""
    monkeypatch.setattr(collocations, "TRIE_WORDS", trie)
    monkeypatch.setattr(collocations, "RANGE_BYTES", of_range)
    source = spark.createDataFrame([(*r, "x") for r in phrases], "lang string, text string, words string").repartition(4)
    got = collocations.collocations(source, depth, least, percent, top)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(phrases, depth, least, percent, top)


def test_words_are_cut_anywhere():
    text = b"one two. three\tfour\n\nfive six"
    whole = [w for part in collocations.words(text) for w in part]
    assert whole == [b"one", b"two", b"\n", b"three", b"four", b"\n", b"\n", b"five", b"six"]
    assert all([w for part in collocations.words(text, n) for w in part] == whole for n in range(1, 30))


def test_collocations_of_an_empty_table(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none).count() == 0
    dotted = spark.createDataFrame([("en", "a b " * 20)], "`la.ng` string, `te.xt` string")
    assert sorted(r.phrase for r in collocations.collocations(dotted, text="te.xt", lang="la.ng").collect()) == ["a b a", "b a b"]


def test_checksums():
    """Known values of CRC-32C, and a bit-wise version."""

    def plain(data):
        crc = 0xFFFFFFFF
        for b in data:
            crc ^= b
            for _ in range(8):
                crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
        crc ^= 0xFFFFFFFF
        return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF

    rng = random.Random(2)
    parts = [b"123456789", b"", b"\0" * 32, *[rng.randbytes(rng.choice([1, 3, 4, 255, 256, 257, 511, 700, 5000])) for _ in range(40)]]
    assert records.masked_crc32c(parts).tolist() == [plain(p) for p in parts]
    assert plain(b"123456789") == (((0xE3069283 >> 15 | 0xE3069283 << 17) & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF
    assert records.unframed(b"".join(records.framed(parts)), "here") == parts
    broken = bytearray(b"".join(records.framed([b"abc", b"defg"])))
    for i in (0, 9, 13, 16, 21, -1):
        bad = bytearray(broken)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            records.unframed(bytes(bad), "here")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(name):
    rng = random.Random(1)
    parts = ["<|endoftext|>", " ", "  ", "\n", "\t", "a", "B", "é", "ß", "ɏ", "1", "23", "'s", "'", "'ll", "it's", "日本", "😀", "\x1f", "\x85", " ", " ", "²", "ª", "¿", "–", "…", "%%", "\x00", "á", "٣", "word", " the"]
    encoder, plain = records.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["x" * 5000, "ab " * 4000]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.parted == (name == "byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    rows = [(i * 3 - 40, " ".join(rng.choice("the of and is été 12, it's".split(" ")) for _ in range(rng.randint(0, 90)))) for i in range(120)]
    return rows + [(None, "no key"), (None, None), (5, None), (5, ""), (5, "twice"), (5, "twice"), (2**60, "long " * 30_000)]


def test_records(spark, texts, tmp_path):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    source = spark.createDataFrame([(*r, "x") for r in texts], "doc_id long, text string, key string").repartition(5)
    folder = records.write_tokens(source, TOKENIZER, end=2, folder=str(tmp_path / "r"), file_bytes=1000)
    got = sorted((tuple(r) for r in records.digests(spark, folder).collect()), key=lambda r: r[1])
    keys = [(-(2**63) if k is None else k) for k, *_ in got]
    assert len(got) == len(texts) and keys == sorted(keys) and [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got][:-1]]).tolist()
    want = Counter((k, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])) for k, t in texts)
    rows = records.read_tokens(spark, folder).collect()
    assert Counter((r.key, tuple(r.ids)) for r in rows) == want
    assert Counter((k, n, c) for k, _, n, c in got) == Counter((k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, ids in want.elements())
    shuffled = records.read_tokens(spark, folder, shuffle=3)
    assert sorted(map(repr, shuffled.collect())) == sorted(map(repr, rows)) and [r.start for r in shuffled.collect()] != sorted(r.start for r in rows)
    assert spark.read.parquet(f"{folder}/files").count() > 10
    (tmp_path / "r/data/leftover.records").write_bytes(b"half")  # of a lost task: no row names it
    assert records.read_tokens(spark, folder).count() == len(texts)
    name = spark.read.parquet(f"{folder}/files").first().file
    data = bytearray((tmp_path / f"r/data/{name}.records").read_bytes())
    data[20] ^= 1
    (tmp_path / f"r/data/{name}.records").write_bytes(bytes(data))
    with pytest.raises(Exception, match="checksum"):
        records.digests(spark, folder).collect()


def test_records_of_the_tables(spark):
    tokenizer, at, want = Tokenizer.from_file(TOKENIZER), 0, []
    for r in table(spark, SF, "documents").orderBy("doc_id").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.op12_records(spark, SF).collect()) == want


def test_records_of_an_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    folder = records.write_tokens(none, TOKENIZER, end=2, folder=str(tmp_path / "e"))
    assert records.digests(spark, folder).count() == records.read_tokens(spark, folder).count() == 0


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_manifest(rows):
    """(key, leaf, subroot, proof) of each row and the root; rows of (key, tree, leaf)."""
    groups = defaultdict(list)
    for key, name, leaf in rows:
        groups[name].append(((key is not None, key or 0), leaf, key))
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {n: (sorted(groups[n], key=lambda x: x[:2]),) for n in names}
    trees = {n: (g, tree([x[1] for x in g])) for n, (g,) in trees.items()}
    top = tree([trees[n][1][-1][0] for n in names]) if names else []

    def beside(levels, i):
        out = []
        for nodes in levels[:-1]:
            out.append(nodes[i ^ 1] if i ^ 1 < len(nodes) else "")
            i >>= 1
        return "".join(out)

    return sorted((repr(key), leaf, trees[n][1][-1][0], beside(trees[n][1], i) + beside(top, k)) for k, n in enumerate(names) for i, (_, leaf, key) in enumerate(trees[n][0])), top and top[-1][0]


@pytest.mark.parametrize("run, langs", [(10, ["en", None, "é", "a"]), (2, ["en", "en", None, "", "=", "é"]), (1, ["one"]), (3, [f"l{i}" for i in range(70)])])
def test_manifest(spark, monkeypatch, run, langs):
    monkeypatch.setattr(manifest, "RUN", run)
    rng = random.Random(run)
    rows = [(rng.choice([None, i, i, i, 7]), rng.choice(["s", None]), rng.choice(langs), rng.choice([None, i]), rng.choice([None, "", "é" * i, "text"])) for i in range(90)]
    rows += rows[:5] + [(10**9 + i, "s", "alone", 1, "t") for i in range(2 ** (run + 1) if run < 4 else 1)] + [(3, "s", "huge", 1, "x" * 300_000)]
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = [(r[0], r[2], H(*map(show, r))) for r in rows]
    want, root = plain_manifest(leaves)
    source = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, digest string").repartition(6)
    got, top = manifest.manifest(source)
    path = F.col("path")
    found = got.select("key", "leaf", "subroot", manifest.siblings(path).alias("s"), manifest.fold(F.col("present"), path).alias("folded")).collect()
    assert top == root and sorted((repr(r.key), r.leaf, r.subroot, r.s) for r in found) == want
    assert {r.folded for r in found} == {root}


def test_tampered_rows_fold_elsewhere(spark):
    source = spark.createDataFrame([(i, "s", "en", i, "t") for i in range(50)], "doc_id long, source string, lang string, n_chars long, text string")
    fields = [F.col(c) if c != "n_chars" else F.when(F.col("doc_id") % 5 == 0, F.col(c) + 1).otherwise(F.col(c)) for c in source.columns]
    rows, root = manifest.manifest(source, present=tuple(fields))
    folded = manifest.fold(F.col("present"), F.col("path"))
    assert sorted(r.key for r in rows.where(folded != F.lit(root)).collect()) == list(range(0, 50, 5))


def test_proofs_of_some_leaves(spark, tmp_path):
    leaves = [H(str(i)) for i in range(3000)]
    rows = spark.createDataFrame([("t", i, d) for i, d in enumerate(leaves)], "tree string, idx long, digest string")
    highest = manifest.build(rows, str(tmp_path / "m"))
    assert highest == 12 and manifest.tops(spark, str(tmp_path / "m"), highest).first().digest == tree(leaves)[-1][0]
    asked = rows.where("idx in (0, 1023, 1024, 2999)").select("tree", "idx", F.struct("digest").alias("row"))
    got = manifest.proofs(spark, str(tmp_path / "m"), highest, asked).select("idx", manifest.fold(F.col("row.digest"), F.col("path")).alias("root")).collect()
    assert {r.root for r in got} == {tree(leaves)[-1][0]} and len(got) == 4
    with pytest.raises(Exception, match="no node"):
        manifest.proofs(spark, str(tmp_path / "m"), highest, asked.withColumn("idx", F.lit(3000).cast("long"))).collect()


def test_manifest_of_an_empty_table(spark):
    rows, root = manifest.manifest(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string"))
    assert rows.count() == 0 and root is None
