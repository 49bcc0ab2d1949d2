"""The registered queries against SQL or plain versions on the smallest tables, and the pipeline."""

import glob
import os
import re

import duckdb
import pytest

from tests.llm import brute
from tests.test_queries_against_sql import rows
from veriloom.llm import queries
from veriloom.session import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    ours = queries.queries()[name](spark, SF).toPandas()
    theirs = duck.execute(queries.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and rows(ours, columns) == rows(theirs, columns)


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF, "documents").orderBy("doc_id").collect()]


def test_suffix_dedup(spark, documents):
    got = queries.op1_suffix_dedup(spark, SF).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == brute.remove_repeats([t for _, t in documents])


def test_decontamination(spark, documents):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    got = queries.op6_decontamination(spark, SF).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got] == brute.contamination([t for _, t in documents], items)


def test_every_row_is_answered(spark, documents):
    for name in ("op2_sharding", "op3_mixing", "op9_quality", "op10_jaccard"):
        got = sorted(r.doc_id for r in queries.queries()[name](spark, SF).select("doc_id").collect())
        assert got == [i for i, _ in documents]
    assert queries.op7_html_text(spark, SF).count() == table(spark, SF, "pages").count()


def test_pipeline(spark, documents):
    """Each stage on its predecessor's rows, against plain versions where there are any."""
    import corpus_pipeline as p

    docs = table(spark, SF, "documents")
    out = [docs]
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
    columns = out[0].columns
    assert all(d.columns == columns for d in out[:-1]) and out[-1].columns[: len(columns)] == columns
    pairs = [(r.doc_id, r.text) for r in out[1].collect()]
    assert 0 < len(pairs) < out[0].count()
    classes = {c for _, _, c in brute.components(pairs, 5, 80, 100)}
    assert sorted(r.doc_id for r in out[2].collect()) == sorted(classes)
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    two = [(r.doc_id, r.text) for r in out[2].collect()]
    hit = brute.contamination([t for _, t in two], items)
    assert sorted(r.doc_id for r in out[3].collect()) == sorted(i for (i, _), h in zip(two, hit, strict=True) if not h[1])
    words = lambda d: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in d.collect())
    assert words(out[4]) == pytest.approx(words(out[3]), rel=0.3)
    assert out[5].count() == out[4].count()
    whole = queries.pipeline(spark, SF)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, out[5].collect()))


def test_stages_keep_clashing_columns(spark):
    import corpus_pipeline as p
    from pyspark.sql import functions as F

    docs = table(spark, SF, "documents").limit(40)
    for name in ("size", "keep", "copies", "taken", "target", "key", "p_quality", "host_good", "start", "head", "shard"):
        docs = docs.withColumn(name, F.lit("own"))
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.where("size = 'own' and keep = 'own' and copies = 'own'").count() == out.count() > 0
    last = p.STAGES[-1][1](spark, docs, SF)
    assert len(set(last.columns)) == len(last.columns) and last.count() == 40


def test_stages_on_odd_tables(spark):
    """Each stage on an empty table, and on null ids, texts, sources and languages, empty and very long texts and repeats."""
    import corpus_pipeline as p

    docs = table(spark, SF, "documents")
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, "en", None, 3), (3, "long words " * 40_000, None, "s", 9), (4, " \n", "en", "s", 2)]
    odd = spark.createDataFrame([(i, t, lang, source, n) for i, t, lang, source, n in rows], "doc_id long, text string, lang string, source string, n_chars long").select(*docs.columns)
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        out = stage(spark, odd, SF)
        assert out.count() <= 3 * len(rows) and out.columns[:5] == docs.columns
    assert p.STAGES[-1][1](spark, odd, SF).where("shard is null").count() == 0
    assert p.near_duplicate_stage(spark, odd, SF).count() == len(rows)  # none has a shingle that another has
    assert p.decontamination_stage(spark, odd, SF).count() == len(rows)
