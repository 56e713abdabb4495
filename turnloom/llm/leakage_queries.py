"""Queries on leaked evaluation passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom.llm.leakage import leaks
from turnloom.sources.tables import table


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the evaluation items that leaked into them."""
    return leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "passage")).select("doc_id", "item_id")


QUERIES = {"p7_found": p7_found}
SQL: dict[str, str] = {}
