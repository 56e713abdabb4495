"""Reading conversations, gold annotations and references from JSON, with their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HAYSTACK = "question_id string, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<struct<role:string,speaker:string,listener:string,content:string,text:string>>>"
DIALOGUE = "array<struct<speaker:string,dia_id:string,text:string,blip_caption:string>>"


def haystack_turns(rows: DataFrame, json: str) -> DataFrame:
    """Turns of JSON rows with nested sessions: ids fall back to ``session_<n>``, text to ``content`` then ``text``, speakers to their role."""
    r = rows.select(F.from_json(json, HAYSTACK).alias("j")).select("j.*")
    s = r.select("question_id", "haystack_session_ids", "haystack_dates", F.posexplode("haystack_sessions").alias("ordinal", "turns"))
    sid = F.coalesce(F.get("haystack_session_ids", F.col("ordinal")), F.concat(F.lit("session_"), F.col("ordinal") + 1))
    t = s.select("question_id", "ordinal", sid.alias("session_id"), F.get("haystack_dates", F.col("ordinal")).alias("ts_raw"), F.posexplode("turns").alias("turn_index", "t"))
    role = F.coalesce("t.role", F.lit("unknown"))
    return t.select(
        "question_id", "session_id", "ordinal", "turn_index", F.coalesce("t.speaker", role).alias("speaker"), F.coalesce("t.listener", F.lit("")).alias("listener"), role.alias("role"),
        "ts_raw", F.coalesce("t.content", "t.text", F.lit("")).alias("raw_text"),
    )


def dialogue_turns(rows: DataFrame, key: str, json: str) -> DataFrame:
    """Turns of conversations given as one JSON object with ``session_<n>`` arrays: sessions in number order, captions appended, the other speaker as listener."""
    m = rows.select(key, F.from_json(json, "map<string,string>").alias("m"))
    s = m.select(key, F.col("m")["speaker_a"].alias("a"), F.col("m")["speaker_b"].alias("b"), F.explode("m").alias("name", "body")).where(F.col("name").rlike("^session_[0-9]+$"))
    t = s.select(key, "a", "b", F.col("name").alias("session_id"), F.posexplode(F.from_json("body", DIALOGUE)).alias("turn_index", "t"))
    media = F.when(F.col("t.blip_caption").isNotNull(), F.concat(F.lit("\n[Media shared by "), F.col("t.speaker"), F.lit("; caption: "), F.col("t.blip_caption"), F.lit("]"))).otherwise("")
    return t.select(key, "session_id", "turn_index", F.col("t.speaker").alias("speaker"), F.when(F.col("t.speaker") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("listener"), F.concat(F.coalesce("t.text", F.lit("")), media).alias("raw_text"))


def evidence_refs(refs: Column) -> Column:
    """Distinct (session_id, turn_index) of ``D<day>:<turn>`` references; anything else is passed over."""
    part = F.filter(F.transform(F.split(refs, "[;,]"), lambda p: F.trim(p)), lambda p: p.rlike(r"^D\d{1,6}:\d{1,6}$"))
    return F.array_distinct(F.transform(part, lambda p: F.struct(F.concat(F.lit("session_"), F.regexp_extract(p, r"^D0*(\d+):", 1)).alias("session_id"), (F.regexp_extract(p, r":(\d+)$", 1).cast("int") - 1).alias("turn_index"))))


def all_refs_valid(refs: Column) -> Column:
    """Whether every reference has the form, as strict reading demands."""
    return F.forall(F.split(refs, ";"), lambda p: F.trim(p).rlike(r"^D\d{1,6}:\d{1,6}$"))


def gold_problems(rows: DataFrame) -> DataFrame:
    """Rows of gold turns with ``problem``: the first of six checks that fails, or ``duplicate``, or null."""
    twice = F.count(F.lit(1)).over(Window.partitionBy("question_id", "session_id", "turn_index", "span_start"))
    return rows.withColumn(
        "problem",
        F.when(F.col("question_id").isNull() | (F.col("question_id") == ""), "question_id").when(F.col("session_id").isNull(), "session_id").when(F.coalesce("turn_index", F.lit(-1)) < 0, "turn_index")
        .when(F.coalesce("span_start", F.lit(-1)) < 0, "span_start").when(F.coalesce("span_end", F.lit(-1)) <= F.col("span_start"), "span_end").when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence")
        .when(twice > 1, "duplicate"),
    )
