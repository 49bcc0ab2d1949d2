"""Hashes, identity keys and deterministic pseudo-random values as column expressions."""

from __future__ import annotations

import hashlib
import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no spaces; NaN and infinities are errors."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def canonical_sha256(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def canonical_struct(**fields: Column) -> Column:
    """Canonical JSON of string and integer fields: sorted by name, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


#: Control characters whose hex digits JSON writers spell in different cases.
_HEX_LETTERS = [c for c in range(0x20) if c not in (0x08, 0x09, 0x0A, 0x0C, 0x0D) and c % 16 > 9]


def _json_text(text: Column) -> Column:
    """A text as a JSON string: named escapes where there are any, other controls in small hex digits, the rest as it is."""
    quoted = F.to_json(F.array(text))
    quoted = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    spelled = quoted
    for c in _HEX_LETTERS:  # an escape has an even number of backslashes before it
        spelled = F.regexp_replace(spelled, rf"(?i)(?<!\\)((?:\\\\)*)\\u{c:04x}", rf"$1\\u{c:04x}")
    return F.when(text.rlike("[" + "".join(f"\\x{c:02x}" for c in _HEX_LETTERS) + "]"), spelled).otherwise(quoted)


@F.arrow_udf(T.StringType())
def _python_numbers(values: pa.Array) -> pa.Array:
    """Numbers in the shortest form that reads back as the same number; NaN and infinities are errors."""
    return pa.array([None if v is None else json.dumps(v, allow_nan=False) for v in values.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _python_lists(values: pa.Array) -> pa.Array:
    return pa.array([None if x is None else [None if v is None else json.dumps(v, allow_nan=False) for v in x] for x in values.to_pylist()], pa.list_(pa.string()))


def _has_floats(kind: T.DataType) -> bool:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return True
    inner = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else [kind.valueType] if isinstance(kind, T.MapType) else []
    return any(map(_has_floats, inner))


def canonical(value: Column, kind: T.DataType) -> Column:
    """Canonical JSON of a column of any nested type, made by its schema: keys in order at every level, no spaces, nulls kept,
    numbers as Python writes them. The same bytes as `canonical_json` of the value.

    Structs and maps of texts are objects, lists are lists; texts, booleans and whole numbers are themselves. Floats are written
    by an Arrow function, in a column or a list of them; deeper inside lists they are no part of this, nor are other types: an error.
    """
    null = F.lit("null")
    if isinstance(kind, T.StringType):
        out = _json_text(value)
    elif isinstance(kind, T.BooleanType):
        out = value.cast("string")
    elif isinstance(kind, T.IntegralType):
        out = value.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = _python_numbers(value.cast("double"))
    elif isinstance(kind, T.StructType):
        names = sorted(f.name for f in kind.fields)
        if len(set(names)) < len(names):
            raise TypeError(f"keys repeat: {names}")
        fields = [F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ":"), canonical(value.getField(n), kind[n].dataType)) for n in names]
        out = F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.DoubleType, T.FloatType)):
        out = F.concat(F.lit("["), F.array_join(_python_lists(value.cast("array<double>")), ",", "null"), F.lit("]"))
    elif isinstance(kind, T.ArrayType) and not _has_floats(kind):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType) and not _has_floats(kind):
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("k"), canonical(e["value"], kind.valueType).alias("v"))))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_json_text(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))
    else:
        raise TypeError(f"{kind.simpleString()} has no canonical JSON here")
    return F.coalesce(out, null)


def canonical_row(df: DataFrame, *columns: str) -> Column:
    """Canonical JSON of a row's columns, by default all, as one object."""
    kind = T.StructType([df.schema[c] for c in columns or df.columns])
    return canonical(F.struct(*[F.col(f"`{f.name.replace('`', '``')}`").alias(f.name) for f in kind.fields]), kind)


#: Fixed value: the namespace of row ids.
ROW_NAMESPACE = "v108-production-row-v1"


def identity_keys(id_: Column, name: Column, description: Column, gallery: Column) -> dict[str, Column]:
    """Keys of a card from its normalised fields and its images' hashes, in file order: of the text, of the gallery whatever
    its order ("" without images), of both, of the row, and the tie key of the last two."""
    content = F.sha2(canonical_struct(normalized_name=name, normalized_description=description, gallery_sha256=gallery), 256)
    row = F.sha2(canonical_struct(namespace=F.lit(ROW_NAMESPACE), id=id_.cast("string")), 256)
    return {
        "exact_text_key": F.sha2(F.trim(F.concat(name, F.lit(" "), description)), 256),
        "gallery_signature": F.when(F.size(gallery) > 0, F.sha2(F.to_json(F.array_sort(gallery)), 256)).otherwise(F.lit("")),
        "content_hash": content,
        "runtime_uid": row,
        "tie_key": F.sha2(canonical_struct(content=content, row=row), 256),
    }


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC-SHA256 in hex; the key's two pads are constants, so it is two built-in hashes."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in raw) for pad in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), digest), 256)


def stable_rank(seed: str, namespace: str, value: Column) -> Column:
    """The order key of `value` under a seed and namespace."""
    return hmac_sha256(seed, F.concat(F.lit(namespace + "\0"), value))


def hex_fraction(hex_: Column, digits: int = 16) -> Column:
    """The first `digits` hex digits as a share of their greatest value."""
    number = F.conv(F.substring(hex_, 1, digits), 16, 10).cast("decimal(20,0)").cast("double")
    return number / F.lit(float(16**digits - 1))


def mock_margin(namespace: str, *parts: Column) -> Column:
    """A stand-in score in [-1, 1], fixed by its parts. Never a model's output."""
    text = F.concat_ws("\0", F.lit(namespace), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return hex_fraction(F.sha2(text, 256)) * 2 - 1


def odd_hash(value: Column) -> Column:
    """Whether the SHA-256 of a text is an odd number."""
    return F.substring(F.sha2(value, 256), 64, 1).isin(*"13579bdf")


def fold_of(component: Column, folds: int = 5) -> Column:
    """A fold that all rows of a component share."""
    return (F.conv(F.substring(F.sha2(component, 256), 1, 12), 16, 10).cast("bigint") % folds).cast("int")


def warmup_multiplier(step: Column, total: int, warmup: int) -> Column:
    """Linear rise over `warmup` steps, then half a cosine down to 0."""
    done = (step - warmup) / F.lit(float(max(1, total - warmup)))
    cosine = F.lit(0.5) * (1 + F.cos(F.lit(math.pi) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), done))))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(F.greatest(F.lit(0.0), cosine))


def softplus(x: Column) -> Column:
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def expit(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def even_positions(n: Column, wanted: Column) -> Column:
    """`wanted` positions spread evenly over 0..n-1, both ends included."""
    steps = F.greatest(wanted - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0), wanted - 1), lambda i: (i * (n - 1) / steps).cast("int"))
