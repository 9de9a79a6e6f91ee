"""How queries are registered."""

from __future__ import annotations


def registry():
    """(queries, oracles, register): register(sql) names a query after its function."""
    queries, oracles = {}, {}

    def register(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, register
