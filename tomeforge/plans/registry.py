"""All queries of the engine's own operators, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import evaluation, experiments, history, index, relational, scalar, search

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (search, index, experiments, evaluation, history, scalar, relational)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
