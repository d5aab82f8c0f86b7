"""A query is a function (spark, sf_dir) -> DataFrame with the SQL of the same result beside it."""

from __future__ import annotations

from collections.abc import Callable


def book() -> tuple[dict, dict[str, str], Callable]:
    queries: dict = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return keep

    return queries, sql, query
