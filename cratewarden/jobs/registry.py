"""Where the jobs modules put their queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import inputs

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, make: Callable[..., DataFrame], *tables: str, sql: str | None = None, also: tuple[str, ...] = ()) -> None:
        """Query `name` applies `make` to the derived inputs `tables`; `sql` follows WITH over them and the inputs `also`."""

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(*(inputs.frame(spark, sf_dir, t) for t in tables))

        query.__name__ = name
        self.queries[name] = query
        if sql is not None:
            self.sql[name] = f"{inputs.duck(*tables, *also)} {sql}"
