"""Queries on garbled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom.llm.mojibake import garbled_documents
from turnloom.sources.tables import table


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a garbled stretch."""
    return garbled_documents(table(spark, folder, "documents", "doc_id", "text")).select("doc_id")


def p9_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """The garbled documents with their restored text."""
    return garbled_documents(table(spark, folder, "documents", "doc_id", "text"))


QUERIES = {"p9_found": p9_found, "p9_repaired": p9_repaired}
SQL: dict[str, str] = {}
