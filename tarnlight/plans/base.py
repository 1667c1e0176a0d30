"""How queries are registered beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    """Queries by name, and for those that SQL can express the equivalent SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep


# Tables of which rows may be written twice, each row once.
MEMORIES = "(SELECT * FROM atomic_memories QUALIFY row_number() OVER (PARTITION BY id) = 1)"
CHUNKS = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id) = 1)"
RECALL = "(SELECT * FROM memory_recall QUALIFY row_number() OVER (PARTITION BY id) = 1)"
#: The instant that stands for now in all queries.
NOW = "2026-03-01 00:00:00"
