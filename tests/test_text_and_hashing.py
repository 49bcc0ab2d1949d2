import hashlib
import hmac
import html
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from veriloom.functions import hashing, text


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make("x").alias("y")).first()[0]


@pytest.mark.parametrize(
    "raw",
    [
        None, "", "  a b ", "&lt;b&gt;bold&lt;/b&gt; A&amp;B", "<p>one<br>two</p>", "see https://x.example/a?b=1 now", "ｆｕｌｌ ﬁ ½", "bell\x07 and\x0b tab\t",
        "Ёлка é 😀", "WWW.x.example y",
    ],
)
def test_clean_text(spark, raw):
    x = unicodedata.normalize("NFKC", html.unescape(raw or ""))
    for pattern in (r"<[^>]+>", r"(?i)\b(?:https?://|www\.)\S+", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"):
        x = re.sub(pattern, " ", x)
    expected = re.sub(r"\s+", " ", x).strip()
    assert one(spark, raw, text.clean_text) == expected
    words = " ".join(re.findall(r"\b\w+\b", expected.lower().replace("ё", "е")))
    assert one(spark, raw, text.normalized_text) == words


def test_middle_truncate(spark):
    assert one(spark, "x" * 9000, lambda c: text.middle_truncate(c, 9000)) == "x" * 9000
    long_ = "ab" * 4501
    limit = 7000
    expected = long_[: limit * 2 // 3] + " … " + long_[-limit // 3 :]
    assert one(spark, long_, lambda c: text.middle_truncate(c, limit)) == expected


def test_token_ngrams_of_short_texts(spark):
    grams = lambda c: text.token_ngrams(text.contract_tokens(c), 3)
    assert one(spark, "A b", grams) == []
    assert one(spark, "A b c d", grams) == ["a b c", "b c d"]
    assert one(spark, None, grams) == []


def test_char_wb_ngrams(spark):
    def reference(value):
        out = []
        for word in re.sub(r"\s+", " ", value.lower()).split():
            padded = f" {word} "
            for n in (3, 4, 5):
                out += [padded[i : i + n] for i in range(max(1, len(padded) - n + 1))]
                if len(padded) <= n:
                    break
        return sorted(out)

    for value in ("a", "ab cd", "hello World x", "ёж и ещё"):
        assert sorted(one(spark, value, text.char_wb_ngrams)) == reference(value)


def test_greedy_chunks(spark):
    words = "aaaa bbbb cccc dddddddddddddd ee f"
    assert one(spark, words, lambda c: text.greedy_chunks(F.col(c), 10)) == ["aaaa bbbb", "cccc", "dddddddddddddd", "ee f"]
    assert one(spark, "", lambda c: text.greedy_chunks(F.col(c), 10)) == []


def test_json_object(spark):
    parse = lambda c: text.json_object(F.col(c), "a int")["a"]
    assert one(spark, '```json\n{"a": 3}\n```', parse) == 3
    assert one(spark, 'so: {"a": 4} done', parse) == 4
    assert one(spark, "[1, 2]", parse) is None
    assert one(spark, '{"a": ', parse) is None


@pytest.mark.parametrize("seed", ["42", "k" * 80])
def test_hmac(spark, seed):
    expected = hmac.new(seed.encode(), b"ns\0v\xc3\xa9", hashlib.sha256).hexdigest()
    assert one(spark, "vé", lambda c: hashing.stable_rank(seed, "ns", F.col(c))) == expected


def test_canonical_json():
    assert hashing.canonical_sha256([]) == "4f53cda18c2baa0c0354bb5f9a3ecbe5ed12ab4d8e11ba873c2f11161202b945"
    assert hashing.canonical_json({"b": 1, "a": "ё"}) == '{"a":"ё","b":1}'
    with pytest.raises(ValueError):
        hashing.canonical_json(float("nan"))


def test_mock_margin(spark):
    digest = hashlib.sha256(b"ns\0a\0b").hexdigest()[:16]
    row = spark.createDataFrame([("a", "b")], "a string, b string").select(hashing.mock_margin("ns", F.col("a"), F.col("b"))).first()
    assert row[0] == int(digest, 16) / (2**64 - 1) * 2 - 1


def test_odd_hash_and_positions(spark):
    for value in "abcdef":
        assert one(spark, value, lambda c: hashing.odd_hash(F.col(c))) == bool(int(hashlib.sha256(value.encode()).hexdigest(), 16) % 2)
    row = spark.range(1).select(hashing.even_positions(F.lit(10), F.lit(4)), hashing.even_positions(F.lit(10), F.lit(1))).first()
    assert row[0] == [0, 3, 6, 9] and row[1] == [0]


def test_json_of_objects_and_arrays(spark):
    schema = "items array<struct<a:int>>"
    read = lambda raw: spark.createDataFrame([(raw,)], "x string").select(text.json_object(F.col("x"), schema, "items").alias("y")).first().y
    for raw in ('{"items": [{"a": 1}, {"a": 2}]}', 'so: {"items": [{"a": 1}, {"a": 2}]} .', '[{"a": 1}, {"a": 2}]', '```json\n[{"a": 1}, {"a": 2}]\n```'):
        assert [i["a"] for i in read(raw)["items"]] == [1, 2]
    assert read("nothing") is None and read(None) is None


def test_unclosed_references_and_what_python_gets(spark, monkeypatch):
    """Only closed references are decoded where asked; Python gets the rows that hold a reference, and null for the others."""
    rows = spark.createDataFrame([(0, "a&amp p &amp;lt; &notit; &#65; &eacute;"), (1, "plain " * 100), (2, None)], "id int, t string")
    cleaned = {r.id: (r.x, r.y) for r in rows.select("id", text.clean_text("t", unclosed=False).alias("x"), text.clean_text("t").alias("y")).collect()}
    assert cleaned[0] == ("a&amp p &lt; &notit; A é", "a& p &lt; ¬it; A é")
    assert cleaned[1][0] == cleaned[1][1] == ("plain " * 100).strip() and cleaned[2] == ("", "")
    got = []
    monkeypatch.setattr(text, "_unescape", lambda c: got.append(c) or c)
    text.unescape("t")
    sent = {r.id: r.sent for r in rows.select("id", got[0].alias("sent")).collect()}
    assert sent[0] is not None and sent[1] is None and sent[2] is None


def test_kept_signs_by_either_class(spark):
    values = ["Plain  text, 9-a_b!", " café — naïve ", "Ёлка и Чай, 5л", "ӘЯ ё", "", None, " a ", "x<b>y</b> z"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")
    out = rows.select("id", text.audit_text("v").alias("a"), text.policy_text("v").alias("p"))
    assert "[^0-9a-z]+" in out._jdf.queryExecution().optimizedPlan().toString()  # texts of ASCII signs go by a table of them
    for r in out.collect():
        low = (values[r.id] or "").lower()
        assert r.a == re.sub("[^0-9a-zа-яё]+", " ", low).strip(" ")
        assert r.p == re.sub("[^a-zа-я0-9]+", " ", re.sub("<[^>]+>", " ", low.replace("ё", "е"))).strip(" ")


def test_greedy_chunks_word_by_word(spark):
    def packed(value, most):
        out = []
        for w in value.split():
            if out and len(out[-1]) + 1 + len(w) <= most:
                out[-1] += " " + w
            else:
                out.append(w)
        return out

    values = ["", "a", " a  b\tc d ", "é𝒳 漢字𝒳𝒳𝒳 x 𝒳𝒳𝒳𝒳𝒳𝒳𝒳𝒳𝒳𝒳𝒳𝒳 yy", "aaaa bbbb cccc dddddddddddddd ee f", "123456789 0 12345678 0 1234567890 1", "x " * 40, "y" * 300 + " z"]
    for most in (1, 2, 10, 120):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", text.greedy_chunks("v", most).alias("c"))
        for r in rows.collect():
            assert r.c == packed(values[r.i], most), (values[r.i], most)


def test_evidence_moves_pieces_once(spark):
    from veriloom.operators import policy

    rows = spark.createDataFrame([(1, "One. two; One", "gas and gas"), (2, "", ""), (3, "<b> </b>", "x")], "id int, name string, description string")
    out = policy.evidence(rows, "id", ("name", "description"), ("gas",), key="k")
    assert {tuple(r) for r in out.collect()} == {(1, 0, "One.", 0, "one."), (1, 1, "two", 0, "two"), (1, 2, "One", 0, "one"), (1, 3, "gas and gas", 2, "gas and gas"), (2, 0, policy.STAND_IN, 0, policy.STAND_IN.lower()), (3, 0, "x", 0, "x")}
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_evidence_split_keeps_every_piece(spark, tmp_path):
    from veriloom.plans import policy_queries

    said = [f"Sentence number {i} of the card, with the words that it has." for i in range(400)]
    spark.createDataFrame([(1, "Name\n" + " ".join(said), "en", "src0")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = policy_queries.evidence_split(spark, str(tmp_path)).orderBy("evidence_id").collect()
    assert [r.evidence_id for r in found] == list(range(len(found))) and [r.evidence for r in found][-len(said) :] == said
    assert policy_queries.topk_restore_order(spark, str(tmp_path)).count() == 32
