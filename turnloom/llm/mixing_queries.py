"""Queries on mixing sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom.llm.mixing import mix, shares
from turnloom.sources.tables import table


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents used for the mixture with how often each is."""
    return mix(table(spark, folder, "documents", "doc_id", "text", "source"), table(spark, folder, "source_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of the sources."""
    return shares(p8_mix(spark, folder), table(spark, folder, "source_targets"))


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
