"""All registered queries and their SQL."""

from __future__ import annotations

from . import matching_queries, source_queries, store_queries, text_queries, value_queries, vehicle_queries, view_queries  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
