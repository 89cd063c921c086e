"""All registered queries of the library: each applies one operator to driver tables, with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its operator's inventory id, and its SQL where SQL can express it."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import registered, registered_citing, registered_generation, registered_pages, registered_reports, registered_sessions, registered_text  # noqa: F401  fill the registry

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import registered, registered_citing, registered_generation, registered_pages, registered_reports, registered_sessions, registered_text  # noqa: F401

    return dict(ORACLES)
