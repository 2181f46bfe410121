"""Registration of queries next to their SQL."""

from __future__ import annotations


def registry():
    """Two dicts and a decorator that fills them: ``@query(sql)``, or ``@query()`` where SQL can't express it."""
    queries, oracle = {}, {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query
