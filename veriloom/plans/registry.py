"""All queries over the tables of a folder, and their SQL."""

from __future__ import annotations

from veriloom.plans import contract_queries, draw_queries, expert_queries, fold_queries, integrity_queries, policy_queries, relational_queries, score_queries, source_queries, text_queries  # noqa: F401
from veriloom.plans.query import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
