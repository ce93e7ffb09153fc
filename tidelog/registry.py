"""Every registered query and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.plans import streams, tables  # noqa: F401  streams registers its queries with tables

FLAGSHIP = "segments_live_bytes"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(tables.FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(tables.SQL)
