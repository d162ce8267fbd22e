"""Named sources: functions that return rows, with an optional validity rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

Fetch = Callable[..., DataFrame]
Rule = Callable[[DataFrame], Column]


class Sources:
    def __init__(self):
        self._known: dict[str, tuple[Fetch, Rule | None]] = {}

    def register(self, name: str, fetch: Fetch, valid: Rule | None = None) -> None:
        self._known[name] = (fetch, valid)

    def fetch(self, name: str, spark: SparkSession, **query) -> DataFrame:
        """Rows of a source; its invalid rows are refused as a whole."""
        if name not in self._known:
            raise ValueError(f"unknown source: {name}")
        fetch, valid = self._known[name]
        rows = fetch(spark, **query)
        if valid is not None and not rows.filter(~valid(rows)).isEmpty():
            raise ValueError(f"invalid rows from source {name}")
        return rows

    def as_views(self, spark: SparkSession, **query) -> None:
        """One temporary view per source, for SQL."""
        for name in self._known:
            self.fetch(name, spark, **query).createOrReplaceTempView(name)
