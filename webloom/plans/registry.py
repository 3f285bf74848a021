"""A register of named queries and their oracle SQL."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, run, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"two queries named {name}")
        self.queries[name] = run
        if sql is not None:
            self.sql[name] = sql
