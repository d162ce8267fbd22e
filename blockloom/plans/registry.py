"""Registration of queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.plans.standins import CTES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register `fn(tables)` under `name`; `ctes` names the stand-in tables the SQL reads."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_ctes(sql, ctes)
        return fn

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Results that depend on the order of a sum, at a precision on which any order agrees."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def with_ctes(sql: str, names: tuple[str, ...]) -> str:
    if not names:
        return sql.strip()
    head = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in names)
    body = sql.strip()
    if body.lower().startswith("with recursive"):
        return f"WITH RECURSIVE {head},\n{body[len('with recursive'):]}"
    if body.lower().startswith("with "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
