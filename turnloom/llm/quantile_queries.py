"""Queries on percentiles of latencies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import quantiles as Q
from turnloom.plans.lineage import shared_dir
from turnloom.sources.tables import table

LEVELS = [0.5, 0.9, 0.95, 0.99]


def latencies(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, answer_model, day, ms): answers sent again count once, in any spelling of the model, as they arrived last; an unknown arrival is the first, null models are unknown."""
    model = F.coalesce(F.lower(F.trim("answer_model")), F.lit("unknown")).alias("answer_model")
    answers = table(spark, folder, "answers", "question_id", "run_id", "answer_model", "answered_at", "arrived_at", "latency_ms")
    measured = F.when(Q.quantised(F.col("latency_ms").cast("double")).isNotNull(), F.col("latency_ms")).alias("ms")
    latest = F.max(F.struct("arrived_at", measured))  # of copies that arrived together the slowest measured; max_by takes any
    once = answers.groupBy("question_id", "run_id", model, "answered_at").agg(latest["ms"].alias("ms"))
    prepared = table(spark, folder, "prepared_answers", "answer_model", "prepared_at", "preparation_latency_ms")
    return once.select(F.lit("answer").alias("kind"), "answer_model", F.to_date("answered_at").alias("day"), "ms").unionByName(
        prepared.select(F.lit("preparation").alias("kind"), model, F.to_date("prepared_at").alias("day"), F.col("preparation_latency_ms").alias("ms"))
    )


def _published(spark: SparkSession, folder: str) -> Q.DigestStore:
    store = Q.DigestStore(spark, f"{shared_dir(spark)}/latency-digests-{uuid.uuid4().hex}", ["kind", "answer_model"])
    store.publish(latencies(spark, folder), "ms")
    return store


def p3_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Median and upper percentiles per model and day (period "day", undated ones under day null), and of all days together ("whole"), read from the stored day digests."""
    store = _published(spark, folder)
    whole = store.of_period(LEVELS).withColumn("day", F.lit(None).cast("date")).withColumn("period", F.lit("whole"))
    return store.by_day(LEVELS).withColumn("period", F.lit("day")).unionByName(whole)


def p3_digests(spark: SparkSession, folder: str) -> DataFrame:
    """The stored day digests themselves, which later days or other parts are merged with."""
    return _published(spark, folder).days().select("kind", "answer_model", "day", "node", "count")


QUERIES = {"p3_percentiles": p3_percentiles, "p3_digests": p3_digests}
SQL: dict[str, str] = {}
