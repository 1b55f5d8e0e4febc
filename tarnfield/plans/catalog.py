"""The registered queries for the engine's own operators, with their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnfield.plans import contract_queries, lexical_queries, planning_queries, projection_queries, relational_queries, result_queries, screening_queries, selection_queries

_MODULES = (lexical_queries, screening_queries, selection_queries, projection_queries, relational_queries, contract_queries, planning_queries, result_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
