"""A module's queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None, name: str | None = None) -> Callable:
        """Register the decorated query under its name, with its SQL twin if there is one."""

        def add(f: Callable) -> Callable:
            self.queries[name or f.__name__] = f
            if sql is not None:
                self.sql[name or f.__name__] = sql
            return f

        return add
