"""Queries on recorded timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom.operators.instants import normalise_instants
from turnloom.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every session and turn timestamp that denotes one instant, in microseconds of UTC."""
    sessions = table(spark, folder, "sessions", "session_no", "session_id", "memory_id", "ts_raw", "home_zone", "date_style")
    return normalise_instants(sessions, table(spark, folder, "turns", "turn_no", "memory_id", "session_id", "ts_raw"))


QUERIES = {"p2_found": p2_found}
SQL: dict[str, str] = {}
