"""A registry of (name, query, oracle SQL) triples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name; a query whose results SQL can express carries its DuckDB SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")
        self.queries[name] = query
        if sql is not None:
            self.oracles[name] = sql

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def wrap(f: Query) -> Query:
            self.add(name, f, sql)
            return f

        return wrap
