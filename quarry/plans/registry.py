"""Registration of a query beside its SQL."""

from __future__ import annotations

from collections.abc import Callable


def new() -> tuple[dict, dict, Callable]:
    """(queries, sql, decorator): what a module of plans registers, by name."""
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def register(name: str, text: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            queries[name] = f
            if text:
                sql[name] = text
            return f

        return keep

    return queries, sql, register
