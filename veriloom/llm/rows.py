"""A caller's columns kept in one struct while an operator works, so that no name of theirs meets one of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The struct's name; an operator's own columns have others.
ROW = "row"


def named(column: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{column.replace('`', '``')}`")


def packed(columns: list[str]) -> Column:
    """Columns as one struct, under the name ROW."""
    return F.struct(*([named(c).alias(c) for c in columns] or [F.lit(True).alias("none")])).alias(ROW)


def hold(df: DataFrame, used: dict[str, str]) -> DataFrame:
    """The columns that an operator looks at, under its own names ({own: caller's}), and ROW with all the others."""
    return df.select(*[named(c).alias(own) for own, c in used.items()], packed([c for c in df.columns if c not in used.values()]))


def release(rows: DataFrame, df: DataFrame, used: dict[str, str], added: dict[str, Column] | None = None, replaced: tuple[str, ...] = ()) -> DataFrame:
    """df's columns in their order, but for those that are added anew or named in `replaced`, and then the added ones."""
    own = {c: k for k, c in reversed(used.items())}
    gone = {*(added or {}), *replaced}
    back = [(F.col(own[c]) if c in own else F.col(ROW).getField(c)).alias(c) for c in df.columns if c not in gone]
    return rows.select(*back, *[v.alias(k) for k, v in (added or {}).items()])
