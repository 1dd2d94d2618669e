"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _halves_up(c: str, digits: int) -> Column:
    """A double to its digits as the SQL rounds: scaled first, so a half is what the scaled double shows."""
    scaled = F.col(c) * float(10**digits)
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / float(10**digits)).otherwise(F.col(c))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    doubles = {f.name for f in df.schema if f.dataType.simpleString() == "double"}
    return df.withColumns({c: _halves_up(c, digits) if c in doubles else F.round(c, digits) for c in columns})
