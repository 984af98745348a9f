"""All queries over the driver's tables, with equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import bank, base, corpus, exam, ingest, learning, ops, streams, tagging, taxonomy, verify  # noqa: F401  their queries register themselves


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
