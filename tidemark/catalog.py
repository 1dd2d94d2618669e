"""Every query of the engine and its SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import contracts, courts, evidence, forecasting, identities, invariants, pages, pregame, records, reports, review, trees  # noqa: F401  (importing them registers their queries)
from tidemark.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
