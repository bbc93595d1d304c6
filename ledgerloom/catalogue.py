"""The registered queries of the library and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import QUERIES, SQL, details, domain, offerings, parsers, reads, reports, stores, streams, values  # noqa: F401  importing registers


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
