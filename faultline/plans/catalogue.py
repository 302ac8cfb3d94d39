"""All queries of the engine by name, with the SQL that states each independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import case_queries, file_queries, model_queries, rule_queries, table_queries, vector_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _part in (vector_queries, table_queries, case_queries, file_queries, model_queries):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
QUERIES |= rule_queries.QUERIES
SQL |= rule_queries.sql(table_queries.HOP_SQL, case_queries.PATHS_SQL)
