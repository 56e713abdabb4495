"""Queries on conversations rebuilt from message rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import conversations as C
from turnloom.plans.lineage import cut
from turnloom.sources.tables import table


def _inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "turns"), table(spark, folder, "sessions", "memory_id", "session_id", "home_zone", "date_style")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions to drop."""
    turns, sessions = _inputs(spark, folder)
    judged = C.judged_sessions(turns, sessions, cut(C.placed_turns(turns, sessions)))
    return judged.where(F.size("reasons") > 0).select("memory_id", "session_id")


def p4_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Every kept conversation, turn by turn."""
    return C.conversations(*_inputs(spark, folder))


QUERIES = {"p4_found": p4_found, "p4_conversations": p4_conversations}
SQL: dict[str, str] = {}
