"""Queries on similar vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.neighbours import nearest_vectors
from turnloom.sources.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of keys of which one is among the other's 10 most similar, with a cosine of 0.8 or more."""
    embeddings = table(spark, folder, "query_embeddings", "cache_key", "model_id", "dimension", "vector")
    near = nearest_vectors(embeddings, table(spark, folder, "dense_handles", "model_id", "ids"), k=10, least=0.8)
    return near.select(F.least("cache_key", "other_key").alias("key_a"), F.greatest("cache_key", "other_key").alias("key_b")).distinct()


QUERIES = {"p5_found": p5_found}
SQL: dict[str, str] = {}
