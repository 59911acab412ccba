"""Registry of the engine's queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import judge_queries, matrix_queries, persona_queries, run_queries, runtime_queries, source_queries, stats_queries

MODULES = (persona_queries, matrix_queries, judge_queries, runtime_queries, stats_queries, source_queries, run_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents judged by two judges: accuracy by judge."""
    return judge_queries.judge_accuracy(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
