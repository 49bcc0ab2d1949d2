"""Keys at any depth of JSON columns, opened level by level, and the provenance contract over them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.operators.contracts import FORBIDDEN_KEYS, ContractError
from veriloom.operators.ranking import quoted
from veriloom.session import materialised

_OWN = ("key", "path", "depth", "value")


def _named(parent: Column) -> Column:
    """The path of an entry: `a.b[0]`; keys that hold signs of paths are quoted as in JSON."""
    text = F.to_json(F.array("key"))
    key = F.when(F.col("key").rlike(r"^[^.\[\]\"\\]+$"), F.col("key")).otherwise(F.substr(text, F.lit(2), F.length(text) - 2))
    of_list = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))
    of_object = F.concat(F.when(parent == "", "").otherwise("."), key)
    return F.concat(parent, F.when(F.col("key").isNull(), of_list).otherwise(of_object))


def walk_keys(df: DataFrame, json: str, keep: Iterable[str]) -> DataFrame:
    """(keep, path, depth, key): every key of the objects in a JSON column, at any depth, in objects and lists alike.

    Texts become variants, and each round opens one level of all rows at once, so there are as many rounds as the deepest row
    has levels; values that are neither objects nor lists are left behind. depth counts the objects around a key, itself
    included. Null texts have no keys, texts that are no JSON are an error; repeated rows repeat their keys; a scalar has none.
    """
    kept = list(keep)
    if clash := [k for k in kept if k in (*_OWN, "pos", "v")]:
        raise ContractError(f"columns {clash} have names of this operator's")
    names = quoted(kept)
    level = df.where(F.col(json).isNotNull()).select(*names, F.lit("").alias("parent"), F.lit(0).alias("above"), F.parse_json(json).alias("v"))
    found = []
    while True:
        opened = level.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()))
        is_key = F.col("key").isNotNull()
        opened = opened.select(*names, _named(F.col("parent")).alias("path"), (F.col("above") + is_key.cast("int")).alias("depth"), "key", "value")
        opened = materialised(opened.withColumn("opens", F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)<")))
        found.append(opened.where("key is not null").select(*names, "path", "depth", "key"))
        if opened.where("opens").isEmpty():
            return reduce(DataFrame.unionByName, found)
        level = opened.where("opens").select(*names, F.col("path").alias("parent"), F.col("depth").alias("above"), F.col("value").alias("v"))


def forbidden_keys(df: DataFrame, json: str, keep: Iterable[str], forbidden: Iterable[str] = FORBIDDEN_KEYS) -> DataFrame:
    """Keys of `walk_keys` that are forbidden in any case of letters and with any white space around them."""
    return walk_keys(df, json, keep).where(F.lower(F.trim(F.regexp_replace("key", r"^\s+|\s+$", ""))).isin(*forbidden))


def check_manifests(df: DataFrame, json: str, keep: Iterable[str], declared: Mapping[str, object], forbidden: Iterable[str] = FORBIDDEN_KEYS) -> DataFrame:
    """(keep, problem, at): manifests of a JSON column that hold a forbidden key anywhere, with its path, or do not state a
    declaration as it must be; no row means that all hold. A null manifest states nothing."""
    names = quoted(list(keep))
    bad = forbidden_keys(df, json, keep, forbidden).select(*names, F.lit("forbidden key").alias("problem"), F.col("path").alias("at"))
    parsed = df.withColumn("v", F.parse_json(json))
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    drift = [F.when(~F.coalesce(F.try_variant_get("v", f"$.{k}", kinds[type(v)]).eqNullSafe(F.lit(v)) & _is(k, v), F.lit(False)), F.lit(k)) for k, v in declared.items()]
    missing = parsed.select(*names, F.lit("declaration").alias("problem"), F.explode(F.array_compact(F.array(*drift))).alias("at"))
    return bad.unionByName(missing)


def _is(key: str, value: object) -> Column:
    """Whether a declaration has the kind of its value: "false" is not false."""
    kind = F.schema_of_variant(F.try_variant_get("v", f"$.{key}", "variant"))
    return kind == {bool: "BOOLEAN", int: "BIGINT", str: "STRING"}.get(type(value), kind)
