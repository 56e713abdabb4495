"""Symbolic read-outs over sentences of a memory: sums, latest numbers, counts of events, speakers that do not match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.text import content_terms, sentences

MONEY = r"([$€£]\s*\d+(?:[.,]\d+)*|\d+(?:[.,]\d+)*\s*(?:€|dollars|euros?))"
HOURS = r"(?i)\b(\d{1,2})\s+(?:hours?|days?)\b"


def spoken_sentences(turns: DataFrame) -> DataFrame:
    """(turn_no, memory_id, session_id, turn_index, speaker, pos, sentence) of turns that have text."""
    return turns.where("raw_text is not null").select("turn_no", "memory_id", "session_id", "turn_index", "speaker", F.posexplode(sentences(F.col("raw_text"))).alias("pos", "sentence"))


def matching(said: DataFrame, include: str, exclude: str | None = None) -> DataFrame:
    """Sentences that match one pattern and not another; questions are left out."""
    out = said.where(F.col("sentence").rlike(include) & ~F.col("sentence").rlike(r"\?\s*$"))
    return out if exclude is None else out.where(~F.col("sentence").rlike(exclude))


def sum_quantities(said: DataFrame, include: str, number: str, by: list[str]) -> DataFrame:
    """(by, total, n): first number of each matching sentence, equal sentences of a memory once."""
    n = F.regexp_extract("sentence", number, 1)
    digits = F.regexp_replace(F.regexp_replace(n, r"[^0-9.,]", ""), ",", "")
    rows = matching(said, include).where(n != "").select(*by, "sentence", digits.cast("decimal(18,2)").cast("double").alias("v")).distinct()
    return rows.groupBy(*by).agg(F.round(F.sum("v"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


def latest_number(said: DataFrame, include: str, number: str, by: list[str]) -> DataFrame:
    """(by, value, turn_no): the number of the last matching sentence."""
    n = F.regexp_extract("sentence", number, 1)
    rows = matching(said, include).where(n != "").withColumn("value", n)
    w = Window.partitionBy(*by).orderBy(F.col("turn_no").desc(), F.col("pos").desc())
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").select(*by, F.col("value").cast("int").alias("value"), "turn_no")


def count_events(said: DataFrame, include: str, exclude: str, key: str, by: list[str]) -> DataFrame:
    """(by, events): distinct keys of matching sentences; sentences that say it did not happen do not count."""
    k = F.regexp_extract("sentence", key, 1)
    rows = matching(said, include, exclude).withColumn("key", F.when(k == "", F.left("sentence", F.lit(80))).otherwise(k))
    return rows.groupBy(*by).agg(F.count_distinct("key").alias("events"))


def missing_conjuncts(required: DataFrame, said: DataFrame) -> DataFrame:
    """(query_id, present, missing): of phrases (query_id, memory_id, phrase) of one content term each, which a memory speaks of; only where some are and some are not."""
    words = said.select("memory_id", F.explode(content_terms(F.col("sentence"))).alias("phrase")).distinct().withColumn("there", F.lit(1))
    g = required.distinct().join(words, ["memory_id", "phrase"], "left").groupBy("query_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("there") == 1, F.col("phrase")))).alias("present"), F.array_sort(F.collect_set(F.when(F.col("there").isNull(), F.col("phrase")))).alias("missing")
    )
    return g.where((F.size("present") > 0) & (F.size("missing") > 0))


def speaker_mismatch(asked: DataFrame, said: DataFrame) -> DataFrame:
    """(query_id, target, other): questions (query_id, memory_id, target, term) whose term only speakers other than the target speak of."""
    words = said.where("speaker is not null").select("memory_id", F.lower("speaker").alias("speaker"), F.explode(content_terms(F.col("sentence"))).alias("term")).distinct()
    hit = asked.join(words, ["memory_id", "term"]).groupBy("query_id", "target").agg(F.max(F.col("speaker") == F.col("target")).alias("own"), F.min(F.when(F.col("speaker") != F.col("target"), F.col("speaker"))).alias("other"))
    return hit.where("not own and other is not null").select("query_id", "target", "other")
