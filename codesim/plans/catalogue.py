"""The registry that plan modules fill: name -> (query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalogue:
    """Queries and, where SQL can express them, their SQL."""

    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its own name, with its SQL."""

        def add(f: Query) -> Query:
            key = name or f.__name__
            assert key not in self.queries, key
            self.queries[key] = f
            if sql is not None:
                self.sql[key] = sql
            return f

        return add
