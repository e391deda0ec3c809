"""Registered queries of the evaluation-data operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import evaluation_queries, function_queries, packet_queries, registry, suite_queries, task_queries, text_queries  # noqa: F401  they register themselves


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
