"""Collects the queries of a module with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Decorator: registers a query under ``name`` with its equivalent SQL, if there is one."""

        def keep(f):
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return keep
