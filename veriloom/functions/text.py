"""Text functions as column expressions; only NFKC and the full entity table leave the JVM, for rows that need them."""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word character is a letter, a digit of any kind or "_"; Java's and RE2's \w are ASCII.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"(?U)\s+"
URL = r"(?i)(?<![\p{L}\p{N}_])(?:https?://|www\.)\S+"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
TAG = r"<[^>]+>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def _unescape_nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", html.unescape(v)), na_action="ignore")


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[0-9A-Za-z]+);")


def _unescape_closed(value: str) -> str:
    """Character references that a semicolon ends, decoded."""
    return _CLOSED.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" else html.entities.html5.get(m[0][1:], m[0]), value)


@F.pandas_udf(T.StringType())
def _unescape_closed_nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", _unescape_closed(v)), na_action="ignore")


@F.pandas_udf(T.StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def _where(needed: Column, c: Column, function: Callable[[Column], Column]) -> Column:
    """function(c) where needed, else c. A Python function gets the column of every row, so it is null in those that need none."""
    return F.when(needed, function(F.when(needed, c))).otherwise(c)


def unescape_nfkc(c: Column | str, unclosed: bool = True) -> Column:
    """HTML entities decoded (unclosed: those without a semicolon too), then NFKC; plain ASCII without "&" is already both."""
    c = F.coalesce(_col(c), F.lit(""))
    return _where(c.rlike(r"[^\x00-\x7F]|&"), c, _unescape_nfkc if unclosed else _unescape_closed_nfkc)


def unescape(c: Column | str) -> Column:
    c = F.coalesce(_col(c), F.lit(""))
    return _where(c.contains("&"), c, _unescape)


def collapse(c: Column | str) -> Column:
    """Runs of white space, NBSP and its kin included, as one space; none at the ends."""
    return F.trim(F.regexp_replace(_col(c), SPACE, " "))


def clean_text(c: Column | str, unclosed: bool = True) -> Column:
    """Decoded (unclosed: references without a semicolon too), NFKC, without tags, URLs and control characters, white space
    collapsed; null gives ""."""
    x = unescape_nfkc(c, unclosed)
    for pattern in (TAG, URL, CONTROL):
        x = F.regexp_replace(x, pattern, " ")
    return collapse(x)


def _fold_yo(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ё"), F.lit("е"))


def words_of(c: Column | str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(f"{WORD}+"), F.lit(0))


def normalized_text(c: Column | str) -> Column:
    """Words of the cleaned, lower-cased text (ё as е), joined by spaces."""
    return F.array_join(words_of(_fold_yo(clean_text(c))), " ")


def normalized_words(c: Column | str) -> Column:
    """`normalized_text` for text that is clean already: no entity, tag or URL to remove."""
    return F.array_join(words_of(_fold_yo(F.coalesce(_col(c), F.lit("")))), " ")


def _kept(value: Column, others: str) -> Column:
    """Runs of anything but 0-9, a-z and `others` as one space, none at the ends. Java looks ASCII classes up in a table and tries
    mixed ones range by range, so texts without one of the others go by the former."""

    def spaced(x: Column) -> Column:
        plain = (F.octet_length(x) == F.length(x)) | ~x.rlike(f"[{others}]")
        return F.when(plain, F.regexp_replace(x, "[^0-9a-z]+", " ")).otherwise(F.regexp_replace(x, f"[^0-9a-z{others}]+", " "))

    return F.trim(let(value, spaced))


def policy_text(c: Column | str) -> Column:
    """Decoded, lower-cased, tags dropped, only a-z, а-я and 0-9 kept."""
    return _kept(F.regexp_replace(_fold_yo(unescape(c)), TAG, " "), "а-я")


def audit_text(c: Column | str) -> Column:
    """Lower-cased; runs of anything but 0-9, a-z, а-я and ё become one space."""
    return _kept(F.lower(F.coalesce(_col(c), F.lit(""))), "а-яё")


def surface_key(name: Column | str, description: Column | str) -> Column:
    """Both fields, lower-cased, with white space collapsed: equal for exact copies."""
    return collapse(F.lower(F.concat(F.coalesce(_col(name), F.lit("")), F.lit("\n"), F.coalesce(_col(description), F.lit("")))))


def folded(c: Column | str) -> Column:
    """Decoded, lower-cased, white space collapsed; tags stay."""
    return collapse(F.lower(unescape(c)))


def middle_truncate(c: Column | str, limit: int) -> Column:
    """Text over `limit` characters keeps its first two thirds and its last third around " … "."""
    c = F.coalesce(_col(c), F.lit(""))
    head, tail = limit * 2 // 3, -(-limit // 3)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(" … "), F.right(c, F.lit(tail))))


#: What stands for an empty field and for the middle of a long body.
EMPTY_FIELD, LEFT_OUT = "[нет]", "\n[середина длинного текста опущена]\n"


def prompt_window(name: Column | str, description: Column | str, title: int = 1000, most: int = 9000, head: int = 6500, tail: int = 2500, empty: str = EMPTY_FIELD, gap: str = LEFT_OUT) -> Column:
    """The two fields as prompt lines; a long body keeps its head and tail, an empty field says so."""
    field = lambda c: F.coalesce(F.nullif(F.trim(_col(c)), F.lit("")), F.lit(empty))
    body = field(description)
    body = F.when(F.length(body) > most, F.concat(F.substring(body, 1, head), F.lit(gap), F.right(body, F.lit(tail)))).otherwise(body)
    return F.concat(F.lit("Название: "), F.substring(field(name), 1, title), F.lit("\nОписание: "), body, F.lit("\nИтоговая метка:"))


def contract_tokens(c: Column | str) -> Column:
    """Tokens of the data contract: runs of word characters, lower-cased."""
    return words_of(F.lower(F.coalesce(_col(c), F.lit(""))))


def generator_tokens(c: Column | str) -> Column:
    """Tokens of the generator: runs of 0-9, a-z, а-я and ё, so "_" and accented Latin split words."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit("[0-9a-zа-яё]+"), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, where body uses it more than once or inside a loop over an array."""
    return F.transform(F.array(value), body)[0]


def counted(values: Column) -> Column:
    """(value, n) of each distinct value of an array without nulls, in ascending order; counted inside the row."""

    def runs(held: Column) -> Column:
        size = F.size(held)
        starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(held, i) != F.get(held, i - 1)))
        of = lambda at: F.transform(at, lambda i, k: F.struct(F.get(held, i).alias("value"), (F.coalesce(F.get(at, k + 1), size) - i).cast("long").alias("n")))
        return F.when(size > 0, let(starts, of))

    return let(F.array_sort(values), runs)


def ngram_hashes(tokens: Column, width: int) -> Column:
    """(a, b) of every run of `width` tokens: two independent 64-bit hashes of it, without making its text."""
    words = F.transform(tokens, lambda t: F.xxhash64(t))

    def of_run(held: Column, i: Column) -> Column:
        run = [held[i + k] for k in range(width)]
        return F.struct(F.xxhash64(*run).alias("a"), F.xxhash64(F.lit(width), *run).alias("b"))

    def runs(held: Column) -> Column:
        last = F.size(held) - width
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: of_run(held, i))

    return let(words, runs)


def token_ngrams(tokens: Column, width: int) -> Column:
    """All runs of `width` tokens, in order, joined by spaces; none if there are fewer tokens."""

    def runs(held: Column) -> Column:
        last = F.size(held) - width
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", *[held[i + k] for k in range(width)]))

    return let(tokens, runs)


def spaced_words(c: Column | str) -> Column:
    """Lower-cased runs of other than white space."""
    return F.filter(F.split(collapse(F.lower(F.coalesce(_col(c), F.lit("")))), " "), lambda w: F.length(w) > 0)


def padded_ngrams(word: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of a word padded by one space on either side, n from low to high; a padded word
    shorter than n is emitted once, whole, and then no longer n is tried."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    size = F.length(padded)

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), size - n + 1))
        grams = F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))
        # The first n that is not below the word's length gives the word itself; later ones nothing.
        return grams if n == low else F.when(size >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of_size(n) for n in range(low, high + 1)])


def char_wb_ngrams(c: Column | str, low: int = 3, high: int = 5) -> Column:
    """`padded_ngrams` of every word of a text, in order."""
    return F.flatten(F.transform(spaced_words(c), lambda word: padded_ngrams(word, low, high)))


def word_ngrams(c: Column | str, high: int = 2) -> Column:
    """Word 1-grams to high-grams over words of two characters or more."""
    tokens = F.filter(contract_tokens(c), lambda w: F.length(w) >= 2)
    return F.concat(*[token_ngrams(tokens, n) for n in range(1, high + 1)])


def feature_text(name: Column | str, description: Column | str) -> Column:
    return F.concat(F.lit("title "), F.coalesce(_col(name), F.lit("")), F.lit("\n description "), F.coalesce(_col(description), F.lit("")))


def count_of(c: Column, needle: Column | str) -> Column:
    """Non-overlapping occurrences of a non-empty string."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return ((F.length(c) - F.length(F.replace(c, needle, F.lit("")))) / F.length(needle)).cast("int")


def keyword_score(c: Column, keywords: tuple[str, ...]) -> Column:
    return sum((count_of(c, k) for k in keywords), F.lit(0))


def sentences(c: Column) -> Column:
    """Split after . ! or ? before white space, and at runs of semicolons and line breaks."""
    return F.split(c, r"(?<=[.!?])\s+|[;\n]+")


def greedy_chunks(c: Column, most: int = 120) -> Column:
    """Words packed in order into pieces of at most `most` characters; a longer word is a piece of its own. As words are one space
    apart, a piece is the longest run from a word's beginning that ends before a space or the end."""
    return F.regexp_extract_all(collapse(c), F.lit(rf"(?s)[^ ].{{0,{most - 1}}}(?= |\z)|[^ ]+"), F.lit(0))


def json_object(c: Column, schema: str, array_key: str | None = None) -> Column:
    """The outermost {...} of a text, parsed; null where there is none or it is malformed. With array_key, a text that is
    an array at its top level (in a code fence or not) counts as the object {array_key: array}."""
    bare = F.trim(F.regexp_replace(F.trim(c), r"(?i)^```(?:json)?\s*|\s*```$", ""))
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    if array_key is not None:
        found = F.when(bare.startswith("["), F.concat(F.lit('{"' + array_key + '":'), bare, F.lit("}"))).otherwise(found)
    return F.from_json(found, schema, {"mode": "PERMISSIVE"})


def chat_messages(*turns: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in turns])


def fill(template: Column, **slots: Column) -> Column:
    for name, value in slots.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def python_words(text: str) -> list[str]:
    """The words of `words_of`, in plain Python, for tests."""
    return [w for w in re.findall(r"\w+", text)]
