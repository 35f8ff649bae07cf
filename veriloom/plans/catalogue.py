"""All queries of the engine's own operators and their SQL."""

from __future__ import annotations

from veriloom.plans import evidence, raters, registry, relational


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.SQL)


__all__ = ["oracle_sql", "queries", "evidence", "raters", "relational"]
