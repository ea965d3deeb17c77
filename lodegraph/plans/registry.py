"""Where queries and their SQL are registered once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its name, with the SQL that gives the same rows."""

        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add

    def scalar(self, name: str, source: str, key: str, where: str | None = None, /, **cols: tuple[Callable[[], Column], str]) -> None:
        """A projection of a table: distinct rows of the key and of columns given as (expression, SQL)."""

        def run(spark: SparkSession, d: str) -> DataFrame:
            t = table(spark, d, source)
            t = t.where(where) if where else t
            return t.select(key, *[c().alias(n) for n, (c, _) in cols.items()]).distinct()

        self.queries[name] = run
        picks = ", ".join(f"{s} AS {n}" for n, (_, s) in cols.items())
        self.sql[name] = f"SELECT DISTINCT {key}, {picks} FROM {source}" + (f" WHERE {where}" if where else "")
