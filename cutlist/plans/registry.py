"""Where query modules file a Spark query together with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from ..sources.adapters import SQL


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, *views: str) -> Callable:
        """Files a function under its name; `views` are stand-ins that its SQL reads, `packets` also over reordered ones."""

        def file(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = with_views(sql, *views)
            return f

        return file

    def also(self, name: str, other: str) -> None:
        """Files a query under a second name."""
        self.queries[other] = self.queries[name]
        if name in self.sql:
            self.sql[other] = self.sql[name]


def with_views(sql: str, *views: str) -> str:
    ctes = ", ".join(f"{'packets' if v == 'reordered' else v} AS ({SQL[v]})" for v in views)
    sql = sql.strip()
    own = sql.removeprefix("WITH ")
    if not ctes:
        return f"WITH RECURSIVE {own}" if own != sql else sql
    return f"WITH RECURSIVE {ctes}, {own}" if own != sql else f"WITH RECURSIVE {ctes} {sql}"
