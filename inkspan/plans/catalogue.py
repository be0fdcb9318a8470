"""The registered queries and their SQL."""

from __future__ import annotations

from . import graph_queries, index_queries, source_queries, text_queries, version_queries  # noqa: F401  each registers its own
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
