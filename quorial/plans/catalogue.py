"""All registered queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import markets, people

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**people.QUERIES, **markets.QUERIES}
ORACLE_SQL: dict[str, str] = {**people.ORACLE_SQL, **markets.ORACLE_SQL}
