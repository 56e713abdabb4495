"""Queries on defective answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom.llm.answers import defective_answers
from turnloom.sources.tables import table


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every defective answer with its type."""
    answers = table(spark, folder, "answers", "answer_no", "question_id", "prediction", "completion_tokens", "finish_reason", "answer_model")
    return defective_answers(answers, table(spark, folder, "questions", "question_id", "question", "lang"))


QUERIES = {"p6_found": p6_found}
SQL: dict[str, str] = {}
