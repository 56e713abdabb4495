"""Canonical fact rows from the event table, in Spark and as the SQL the oracles start from.

An event is a fact: its user is the owner, its type the predicate, ``props.k`` the value; errors are
undated and negative, views are plans, sign-ups have no instance of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.sources.tables import table

#: Operand that asks for each predicate.
OPERANDS = {"purchase": "o1", "view": "o2", "click": "o3", "signup": "o4", "error": "o5"}


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts with their binding to the operand of their predicate."""
    e = table(spark, folder, "events").where("event_id is not null")
    operand = F.create_map(*[F.lit(x) for pair in OPERANDS.items() for x in pair])[F.col("event_type")]
    k = F.get_json_object("props", "$.k")
    day = F.date_format("ts", "yyyy-MM-dd")
    w = Window.partitionBy("user_id", day).orderBy("event_id")
    return e.select(
        F.col("event_id").alias("binding_id"),
        F.concat(F.lit("m"), F.pmod("user_id", F.lit(20))).alias("memory_id"),
        F.concat(F.lit("u"), F.col("user_id")).alias("owner_id"),
        operand.alias("operand_id"),
        F.col("event_type").alias("predicate"),
        F.lit("general").alias("scope"),
        F.concat(F.lit("c"), F.pmod(k.cast("int"), F.lit(10))).alias("collection_key"),
        F.when(F.col("event_type") == "error", "negative").otherwise("positive").alias("polarity"),
        F.when(F.col("event_type") == "view", "planned").otherwise("asserted").alias("modality"),
        k.alias("value_key"),
        F.when(F.col("event_type") == "click", k).otherwise(F.concat(F.lit("$"), F.col("value").cast("decimal(12,2)").cast("string"))).alias("value"),
        F.lit("text").alias("value_type"),
        day.alias("session_id"),
        (F.row_number().over(w) - 1).alias("turn_index"),
        F.when(F.col("event_type") != "signup", F.concat(F.lit("e"), F.floor(F.col("event_id") / 2).cast("bigint"))).alias("event_instance_id"),
        F.when(F.col("event_type") != "error", F.col("ts")).alias("ts"),
    )


FACTS = """facts AS (
  SELECT event_id AS binding_id, 'm' || (user_id % 20) AS memory_id, 'u' || user_id AS owner_id,
    CASE event_type WHEN 'purchase' THEN 'o1' WHEN 'view' THEN 'o2' WHEN 'click' THEN 'o3' WHEN 'signup' THEN 'o4' WHEN 'error' THEN 'o5' END AS operand_id,
    event_type AS predicate, 'general' AS scope, 'c' || (CAST(json_extract_string(props, '$.k') AS INT) % 10) AS collection_key,
    CASE WHEN event_type = 'error' THEN 'negative' ELSE 'positive' END AS polarity,
    CASE WHEN event_type = 'view' THEN 'planned' ELSE 'asserted' END AS modality,
    json_extract_string(props, '$.k') AS value_key,
    CASE WHEN event_type = 'click' THEN json_extract_string(props, '$.k') ELSE '$' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END AS value,
    'text' AS value_type, strftime(ts, '%Y-%m-%d') AS session_id,
    row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY event_id) - 1 AS turn_index,
    CASE WHEN event_type <> 'signup' THEN 'e' || (event_id // 2) END AS event_instance_id,
    CASE WHEN event_type <> 'error' THEN ts END AS ts
  FROM events WHERE event_id IS NOT NULL)"""


def closed_operands(spark: SparkSession, folder: str) -> DataFrame:
    """(memory_id, operand_id) whose scope counts as closed: memories with an even number of the operand's facts."""
    return facts(spark, folder).groupBy("memory_id", "operand_id").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 0").select("memory_id", "operand_id")


CLOSED = "closed AS (SELECT memory_id, operand_id FROM facts GROUP BY memory_id, operand_id HAVING count(*) % 2 = 0)"


def asks(spark: SparkSession, folder: str) -> DataFrame:
    """What is asked of each memory: owner, predicate, value, collection and time of its last fact (undated ones first, then by id)."""
    f = facts(spark, folder)
    last = F.struct(F.col("ts").isNotNull(), "ts", "binding_id")
    got = f.groupBy("memory_id").agg(F.max_by(F.struct("owner_id", "predicate", "value_key", "collection_key", "ts"), last).alias("a"))
    return got.select("memory_id", *(F.col(f"a.{c}").alias(f"asked_{n}") for c, n in (("owner_id", "owner"), ("predicate", "predicate"), ("value_key", "value"), ("collection_key", "collection"), ("ts", "ts"))))


ASKS = "asks AS (SELECT memory_id, owner_id AS asked_owner, predicate AS asked_predicate, value_key AS asked_value, collection_key AS asked_collection, ts AS asked_ts FROM facts QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY ts IS NOT NULL DESC, ts DESC, binding_id DESC) = 1)"
