"""Queries on token budgets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import tokens as K
from turnloom.plans.lineage import shared_dir
from turnloom.sources.tables import table


def delivered(ledger: K.TokenLedger, rows: DataFrame, time: str) -> DataFrame:
    """The ledger's cube after two deliveries of ``rows``: all up to the last day of ``time``, then the whole table."""
    until = rows.agg(F.max(time) - F.expr("interval 1 day")).first()[0]
    if until is not None:
        ledger.deliver(rows.where(F.col(time).isNull() | (F.col(time) <= F.lit(until))))
    return ledger.deliver(rows)


def p1_token_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of documents by source, language and topic, and of turns by dataset and language beside the reported evidence tokens.

    Both corpora go through a ledger of their own in the shared folder: the last day's rows are a second
    delivery, of which only contents not counted before are encoded.
    """
    at = f"{shared_dir(spark)}/token-ledger-{uuid.uuid4().hex}"
    documents = table(spark, folder, "documents", "doc_id", "text", "source", "lang", "topic", "fetched_at")
    of_documents = delivered(K.TokenLedger(spark, f"{at}/documents"), K.document_rows(documents, "text", "fetched_at"), "fetched_at")
    turns = table(spark, folder, "turns", "memory_id", "raw_text", "ingested_at")
    by_memory = delivered(K.TokenLedger(spark, f"{at}/turns", dims=("memory_id",)), K.turn_rows(turns, "ingested_at"), "ingested_at")
    of_turns = K.beside_evidence(by_memory, table(spark, folder, "conversation", "memory_id", "dataset", "lang", "registered_at"), table(spark, folder, "answers", "memory_id", "evidence_tokens"))
    kind, none = F.lit("documents").alias("kind"), F.lit(None)
    return of_documents.select(kind, F.col("source").alias("origin"), "language", "topic", "n_rows", "n_tokens", none.cast("bigint").alias("evidence_tokens")).unionByName(
        of_turns.select(F.lit("turns").alias("kind"), F.col("dataset").alias("origin"), "language", none.cast("string").alias("topic"), "n_rows", "n_tokens", "evidence_tokens")
    )


QUERIES = {"p1_token_budget": p1_token_budget}
SQL: dict[str, str] = {}
