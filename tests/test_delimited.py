"""CSV read by ranges of bytes, and one ordered file written by many tasks."""

import csv
import glob
import hashlib
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from veriloom.operators.contracts import ContractError
from veriloom.sources import delimited

SIGNS = ["a", "bé", '"', "\n", "\r\n", ",", " ", "", "word", "\n\n", '""', "x" * 40]


def quoted(rows, end="\n"):
    out = io.StringIO(newline="")
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("seed, split, end", [(0, 64, "\n"), (1, 37, "\r\n"), (2, 700, "\n"), (3, None, "\n")])
def test_ranges_against_one_reader(spark, tmp_path, seed, split, end):
    rng, want, header = random.Random(seed), [], ["id", "name", "de scription"]
    value = lambda: "".join(rng.choice(SIGNS) for _ in range(rng.randint(1, 6))) or "v"
    for f in range(4):
        rows = [[f"{f}-{i}", value(), value()] for i in range(rng.choice([0, 1, 30, 60]))]
        want += rows
        text = quoted([header, *rows], end)
        (tmp_path / f"f{f}.csv").write_bytes((("﻿" if f == 9 else "") + text + (end if f % 2 else "")).encode())
    (tmp_path / "f8.csv").write_bytes(b"")
    got = delimited.read_csv(spark, str(tmp_path), split).orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == list(range(len(want)))
    assert [[r["id"], r["name"] or "", r["de scription"] or ""] for r in got] == want


def test_more_tasks_than_files(spark, tmp_path):
    rows = [["1", "two\nlines " * 50], ["2", "x"]] * 40
    (tmp_path / "one.csv").write_text(quoted([["id", "text"], *rows]), newline="")
    with delimited._split_by(spark, 512):
        states = delimited._states(delimited._lines(spark, str(tmp_path)))
        assert states.count() > 20 and states.where("inside").count() > 5
    assert [r.text for r in delimited.read_csv(spark, str(tmp_path), 512).orderBy("ordinal").collect()] == [t for _, t in rows]


def test_ranges_joined_by_shuffle(spark, tmp_path, monkeypatch):
    rows = [[str(i), "a\n" * (i % 9) + "é"] for i in range(200)]
    (tmp_path / "one.csv").write_text(quoted([["id", "text"], *rows]), newline="")
    monkeypatch.setattr(delimited, "MOST_SENT", 0)
    got = delimited.read_csv(spark, str(tmp_path), 100).orderBy("ordinal").collect()
    assert [[r.id, r.text] for r in got] == rows


def test_broken_files(spark, tmp_path):
    for name, files in {"open": ['a,b\n1,"2\n'], "headers": ["a,b\n1,2\n", "a,c\n1,2\n"], "twice": ["a,a\n1,2\n"], "none": [""]}.items():
        folder = tmp_path / name
        folder.mkdir()
        for i, text in enumerate(files):
            (folder / f"{i}.csv").write_text(text)
        with pytest.raises(ContractError):
            delimited.read_csv(spark, str(folder)).collect()
    (tmp_path / "short.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        delimited.read_csv(spark, str(tmp_path / "short.csv")).collect()


def test_ordered_file(spark, tmp_path):
    rows = [(i, f"n{i % 7}", 'quo"ted', "two\nlines", None if i % 3 else "", i / 4) for i in range(500)]
    df = spark.createDataFrame(rows, "ordinal long, `a,b` string, q string, l string, e string, x double").repartition(7)
    many = delimited.write_ordered_csv(df, str(tmp_path / "many.csv"))
    one = delimited.write_ordered_csv(df.coalesce(1), str(tmp_path / "one.csv"))
    assert open(many, "rb").read() == open(one, "rb").read()
    assert [p.name for p in tmp_path.iterdir() if "staging" in p.name] == []
    read = list(csv.reader(open(many, newline="")))
    assert read[0] == ["a,b", "q", "l", "e", "x"] and [r[0] for r in read[1:]] == [r[1] for r in rows] and read[1][1:3] == ['quo"ted', "two\nlines"]
    back = delimited.read_csv(spark, many, 1000).orderBy("ordinal")
    assert [r["a,b"] for r in back.collect()] == [r[1] for r in rows]
    with pytest.raises(ContractError):
        delimited.write_ordered_csv(df, many)
    empty = delimited.write_ordered_csv(df.where(F.lit(False)), str(tmp_path / "empty.csv"))
    assert open(empty).read() == '"a,b",q,l,e,x\n'


def test_files_grow_in_number(spark, monkeypatch):
    from veriloom.plans import source_queries
    from veriloom.session import checkpoint_dir

    before = set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/csv-*/part-*"))
    monkeypatch.setattr(source_queries, "FILE_BYTES", 1 << 17, raising=False)
    source_queries.split_csv(spark, "/root/testdata/sf0.001")
    written = set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/csv-*/part-*")) - before
    assert len(written) > 3 and max(map(os.path.getsize, written)) < 1 << 19


ODD = ["plain", "  lead", "trail  ", "\ttab\t", "end\r", "\rstart", "a\r\nb", "a\rb", "", "\n", "x\n\n", " ", '"', '""', '\\"x', "end\\", "﻿mark", "nul\0in", "\0", "#c", "\x01a\x1f", "\xa0", None]


def odd_documents(spark, folder):
    rows = [(i, t, None if i % 5 == 0 else "", "src0" if i % 3 else "") for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    digest = lambda t: t if t is None else hashlib.sha256(t.encode()).hexdigest()
    return [(i, i, lang, source, t if t is None else len(t), digest(t)) for i, t, lang, source in rows]


def test_ordered_file_of_odd_texts(spark, tmp_path):
    from veriloom.plans import source_queries

    want = odd_documents(spark, tmp_path)
    assert [tuple(r) for r in source_queries.ordered_csv_file(spark, str(tmp_path)).orderBy("ordinal").collect()] == want


def test_rows_of_one_null_or_too_many_values(spark, tmp_path):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["a", None, "", "b"])], "ordinal long, v string")
    path = delimited.write_ordered_csv(df, str(tmp_path / "one.csv"))
    assert [r.v or "" for r in delimited.read_csv(spark, path).orderBy("ordinal").collect()] == ["a", "", "", "b"]
    for i, record in enumerate(["1,2,3", '"1"x,2', '1,x"2"', "1"]):
        (tmp_path / f"{i}.csv").write_text(f"a,b\n{record}\n")
        with pytest.raises(Exception, match="Malformed"):
            delimited.read_csv(spark, str(tmp_path / f"{i}.csv")).collect()
    (tmp_path / "long.csv").write_text('a,b\n,"' + '""x,\n' * 200_000 + '"\n')
    assert [tuple(r) for r in delimited.read_csv(spark, str(tmp_path / "long.csv")).collect()] == [(0, None, '"x,\n' * 200_000)]


def test_split_files_of_odd_texts(spark, tmp_path):
    from veriloom.plans import source_queries

    want = odd_documents(spark, tmp_path)
    assert [tuple(r) for r in source_queries.split_csv(spark, str(tmp_path)).orderBy("ordinal").collect()] == want
    spark.read.parquet(f"{tmp_path}/documents.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert source_queries.split_csv(spark, f"{tmp_path}/none").collect() == []
