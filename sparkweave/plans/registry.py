"""How queries are registered: as SQL text in the engine's dialect, or as a DataFrame program, with SQL for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkweave.plans.tables import Tables
from sparkweave.session import Session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def sql(self, name: str, text: str, duck: str | None = None, check: bool = True) -> None:
        """A query whose text both engines read, or with a text of its own for DuckDB; statements before the last one set up."""

        def run(spark: SparkSession, folder: str) -> DataFrame:
            session = Session(spark=spark)
            for table in TABLES:
                if re.search(rf"\b{table}\b", text):
                    session.register_parquet(table, f"{folder}/{table}.parquet")
            return session.run(text)[-1].df

        self.queries[name] = run
        if check:
            self.oracle[name] = duck or text

    def plan(self, name: str, duck: str | None = None):
        """A DataFrame program over the tables."""

        def add(build: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, folder: build(Tables(spark, folder))
            if duck:
                self.oracle[name] = duck
            return build

        return add
