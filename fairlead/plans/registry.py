"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from . import analytics, tracking

_MODULES = (tracking, analytics)


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
