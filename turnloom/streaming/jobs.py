"""Incremental jobs as streams: idempotent appends, a state machine per job, an outbox, windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# States of a job in order.
STATES = ["RECEIVED", "RAW_DURABLE", "FACT_INDEXED", "RELATION_INDEXED", "ROUTE_PUBLISHED"]


class ConflictingPayload(RuntimeError):
    """A job id came again with another payload."""


def new_jobs(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """Jobs (job_id, memory_id, source_offset, payload_hash) not stored yet, repeats dropped.

    Raises if a job id or (memory, offset) comes with another payload: nothing of the batch is kept then.
    """
    batch = arrived.dropDuplicates(["job_id", "memory_id", "source_offset", "payload_hash"])
    both = stored.select("job_id", "memory_id", "source_offset", "payload_hash").unionByName(batch.select("job_id", "memory_id", "source_offset", "payload_hash"))
    for key in (["job_id"], ["memory_id", "source_offset"]):
        if not both.groupBy(*key).agg(F.count_distinct("payload_hash").alias("n")).where("n > 1").isEmpty():
            raise ConflictingPayload(str(key))
    return batch.join(stored.select("job_id"), "job_id", "left_anti")


def append_stream(source: DataFrame, path: str, checkpoint: str):
    """A query that appends a stream of jobs to a Parquet folder, each batch once whatever is repeated.

    Batches are written to a folder of their number, so a batch that is run again overwrites itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = [f"{path}/batch={n}" for n in range(number) if _exists(spark, f"{path}/batch={n}")]
        stored = spark.read.parquet(*earlier) if earlier else batch.limit(0)
        new_jobs(stored, batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def advance(state: str, wanted: str) -> tuple[str, bool]:
    """The state after a transition and whether it was allowed: only the next one is."""
    ok = wanted in STATES and state in STATES and STATES.index(wanted) == STATES.index(state) + 1
    return (wanted if ok else state), ok


def job_states(transitions: DataFrame) -> DataFrame:
    """(job_id, state, attempts, refused) after each batch of a stream of (job_id, seq, wanted), kept in the stream's state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, attempts, refused = state.get if state.exists else (STATES[0], 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for wanted in rows["wanted"]:
            now, ok = advance(now, wanted)
            attempts, refused = attempts + 1, refused + (not ok)
        state.update((now, attempts, refused))
        yield pd.DataFrame([(key[0], now, attempts, refused)], columns=["job_id", "state", "attempts", "refused"])

    return transitions.groupBy("job_id").applyInPandasWithState(step, "job_id bigint, state string, attempts int, refused int", "state string, attempts int, refused int", "update", GroupStateTimeout.NoTimeout)


def run_states(transitions: DataFrame, path: str, checkpoint: str):
    """A query that appends what ``job_states`` gives for a stream to a folder of batches, each batch once; the states live in ``checkpoint``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return job_states(transitions).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replayed(jobs: DataFrame) -> DataFrame:
    """The state each job (job_id, seq, wanted) ends in, in one batch."""

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        now, refused = STATES[0], 0
        for wanted in pdf.sort_values("seq")["wanted"]:
            now, ok = advance(now, wanted)
            refused += not ok
        return pd.DataFrame([(group[0], now, len(pdf), refused)], columns=["job_id", "state", "attempts", "refused"])

    return jobs.groupBy("job_id").applyInPandas(run, "job_id bigint, state string, attempts int, refused int")


def windowed(events: DataFrame, late: str, size: str, slide: str | None = None) -> DataFrame:
    """Extension: counts and sums per event type and window of event time, rows later than ``late`` left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def sessions_of(events: DataFrame, late: str, gap: str) -> DataFrame:
    """Extension: a user's sessions, ended by a pause of ``gap``."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
