"""Composed pipelines and the registry of queries with their SQL."""

from __future__ import annotations


def all_queries() -> dict:
    from . import more_queries, queries, scan_queries, session_queries, source_queries  # noqa: F401

    return dict(queries.QUERIES)


def all_oracles() -> dict[str, str]:
    from . import more_queries, queries, scan_queries, session_queries, source_queries  # noqa: F401

    return dict(queries.ORACLE_SQL)
