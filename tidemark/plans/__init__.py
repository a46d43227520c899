"""Named queries over a data folder and their SQL twins."""

from __future__ import annotations

from tidemark.plans import data_quality, lifecycle_queries, memory_queries, search_queries

MODULES = [data_quality, memory_queries, search_queries, lifecycle_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
