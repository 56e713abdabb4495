"""Operator: recorded timestamps of sessions and turns as unambiguous instants."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import instants as I


def session_clocks(sessions: DataFrame) -> DataFrame:
    """One row per (memory_id, session_id): home_zone and date_style of its clock, over all deliveries."""
    return sessions.groupBy("memory_id", "session_id").agg(F.max("home_zone").alias("home_zone"), F.max("date_style").alias("date_style"))


def usable(text: Column) -> Column:
    """Texts that can hold an instant: those with a digit."""
    return text.rlike("[0-9]")


def to_instants(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and utc_us (null where the text denotes no single instant) of rows with ts_raw, home_zone, date_style.

    Null texts, unknown zones, gaps and repeated hours give null.  Conversion is by Arrow batch; texts of
    one shape share one parser.
    """
    kept = df.select(*keep, "ts_raw", "home_zone", "date_style")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep)

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            us = I.to_utc(*(batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in ("ts_raw", "home_zone", "date_style")))
            yield batch[keep].assign(utc_us=pd.array(us, dtype="Int64"))

    return kept.mapInPandas(convert, f"{fields}, utc_us bigint")


def normalise_instants(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """(record_kind, record_no, utc_us) of every session and turn whose ts_raw denotes exactly one instant.

    A zone in the text holds first, else the home zone of the row's own session; repeated deliveries each
    give a row.  Turns meet their session's clock by one join on (memory_id, session_id); texts without a
    digit leave before it.
    """
    own = sessions.where(usable(F.col("ts_raw"))).select(F.lit("session").alias("record_kind"), F.col("session_no").alias("record_no"), "ts_raw", "home_zone", "date_style")
    of_turns = (
        turns.where(usable(F.col("ts_raw")))
        .select("memory_id", "session_id", F.lit("turn").alias("record_kind"), F.col("turn_no").alias("record_no"), "ts_raw")
        .join(session_clocks(sessions), ["memory_id", "session_id"], "left")
        .select("record_kind", "record_no", "ts_raw", "home_zone", "date_style")
    )
    return to_instants(own.unionByName(of_turns), ["record_kind", "record_no"]).where("utc_us is not null")
