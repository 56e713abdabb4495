import math
import random
from datetime import datetime

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from __spark_entry__ import queries
from turnloom.llm import quantiles as Q
from turnloom.llm.quantile_queries import LEVELS, latencies


def error_of(node, count, leaves, level):
    """Rank error of the value the digest gives for ``level``."""
    last = ((node + 1) << (Q.BITS - np.floor(np.log2(node)).astype("i8"))) - 1
    order = np.lexsort((-np.floor(np.log2(node)), last))
    n = len(leaves)
    at = np.searchsorted(np.cumsum(count[order]), max(1, math.ceil(level * n)))
    value = last[order][at]
    below, upto = (leaves < value).sum(), (leaves <= value).sum()
    return max(0, below - level * n, level * n - upto)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, Q.TOP), min_size=1, max_size=3000), st.sampled_from([0.02, 0.1]))
def test_compressed_digest_keeps_counts_and_bounds_the_rank(values, epsilon):
    leaves = np.array(values) + (1 << Q.BITS)
    node, first = np.unique(leaves, return_counts=True)
    node, count = Q.compress(node, first, epsilon)
    assert count.sum() == len(values) and len(np.unique(node)) == len(node)
    for level in (0.1, 0.5, 0.9, 0.99):
        assert error_of(node, count, leaves, level) <= epsilon * len(values) + 1


def test_days_merge_to_the_whole_and_stay_small(spark):
    rnd = random.Random(5)
    rows = [("m", d, rnd.lognormvariate(6, 1)) for d in range(4) for _ in range(3000)] + [("m", 0, v) for v in (None, float("nan"), -1.0, float("inf"))] + [("tiny", 1, 5.0), ("tiny", 1, 5.0)]
    df = spark.createDataFrame(rows, "model string, day int, ms double")
    by_day = Q.digest(df, ["model", "day"], "ms", 0.01)
    assert by_day.where("model = 'm' and day = 0").count() < 3 / 0.01 * Q.BITS
    whole = Q.percentiles(Q.merge(by_day.drop("day"), ["model"], 0.01), ["model"], [0.5, 0.95], 0.02)
    values = sorted(v for m, _, v in rows if m == "m" and v is not None and 0 <= v < math.inf)
    got = {(r.model, r.level): r for r in whole.collect()}
    for level in (0.5, 0.95):
        r = got["m", level]
        rank = np.searchsorted(values, r.value)
        assert r.n == len(values) and abs(rank - level * r.n) <= r.rank_error + 0.005 * r.n
    assert abs(got["tiny", 0.5].value - 5) < 0.01


def test_empty_input(spark):
    df = spark.createDataFrame([], "model string, ms double")
    assert Q.percentiles(Q.digest(df, ["model"], "ms"), ["model"], [0.5]).count() == 0


def test_stored_days_merge_like_the_whole_and_are_replaced_one_by_one(spark, tmp_path):
    rnd = random.Random(6)
    rows = [("m", f"2024-01-0{1 + i % 4}" if i % 50 else None, rnd.lognormvariate(5, 1)) for i in range(4000)]
    df = spark.createDataFrame(rows, "model string, day string, ms double").withColumn("day", F.col("day").cast("date"))
    store = Q.DigestStore(spark, str(tmp_path / "d"), ["model"], 0.02)
    store.publish(df, "ms")
    period = [r[2] for r in rows if r[1] in ("2024-01-02", "2024-01-03")]
    for r in store.of_period([0.5, 0.95], "2024-01-02", "2024-01-03").collect():
        assert r.n == len(period) and abs(np.searchsorted(sorted(period), r.value) - r.level * r.n) <= r.rank_error + 0.005 * r.n
    assert {r.n for r in store.of_period([0.5]).collect()} == {4000} and {(r.day is None, r.n) for r in store.by_day([0.5]).collect() if r.day is None} == {(True, 80)}
    store.publish(df.where("day = '2024-01-02'").limit(10), "ms")
    assert {str(r.day): r.n for r in store.by_day([0.5]).collect()}["2024-01-02"] == 10 and store.of_period([0.5], "2024-01-03", "2024-01-03").first().n == sum(r[1] == "2024-01-03" for r in rows)


def test_percentiles_stand_for_every_answer_once(spark, tmp_path):
    """Sent again in another spelling is one answer, not known to have arrived is one too; a row per model, day and level, and all days."""
    day = [datetime(2024, 1, d, 5) for d in (1, 2)]
    answers = [("q1", "HARROW ", day[0], day[0], 10.0), ("q1", "harrow", day[0], day[1], 30.0), ("q2", "harrow", day[1], None, 20.0)]
    answers += [("q3", "pell", day[1], None, 70.0), ("q3", "pell", day[1], day[1], 50.0), ("q4", "pell", day[1], day[1], None)]
    spark.createDataFrame([("r", *a) for a in answers], "run_id string, question_id string, answer_model string, answered_at timestamp_ntz, arrived_at timestamp_ntz, latency_ms double").write.parquet(f"{tmp_path}/answers.parquet")
    spark.createDataFrame([(None, day[0], 5.0)], "answer_model string, prepared_at timestamp_ntz, preparation_latency_ms double").write.parquet(f"{tmp_path}/prepared_answers.parquet")
    got = queries()["p3_percentiles"](spark, str(tmp_path)).collect()
    first, second = (d.date() for d in day)
    expected = {("answer", "harrow", first): (1, 30), ("answer", "harrow", second): (1, 20), ("answer", "harrow", None): (2, 20), ("answer", "pell", second): (1, 50), ("answer", "pell", None): (1, 50), ("preparation", "unknown", first): (1, 5), ("preparation", "unknown", None): (1, 5)}
    assert {(r.kind, r.answer_model, r.day): (r.n, round(r.value)) for r in got if r.level == 0.5} == expected and len(got) == len(LEVELS) * len(expected)


def test_copies_that_arrived_together_and_undated_answers(spark, tmp_path):
    """Whatever their order, the slowest measured of such copies stands for the answer; undated ones are told from all days together."""
    day = datetime(2024, 1, 1, 5)
    answers = [("q1", day, day, 10.0), ("q1", day, day, 30.0), ("q2", day, day, 30.0), ("q2", day, day, 10.0), ("q3", day, None, 30.0), ("q3", day, None, math.nan), ("q4", day, None, None), ("q4", day, None, 30.0)]
    answers += [("q5", None, day, 90.0)]
    spark.createDataFrame([("r", "pell", *a) for a in answers], "run_id string, answer_model string, question_id string, answered_at timestamp_ntz, arrived_at timestamp_ntz, latency_ms double").coalesce(1).write.parquet(f"{tmp_path}/answers.parquet")
    spark.createDataFrame([], "answer_model string, prepared_at timestamp_ntz, preparation_latency_ms double").write.parquet(f"{tmp_path}/prepared_answers.parquet")
    assert {r.ms for r in latencies(spark, str(tmp_path)).where("day is not null").collect()} == {30.0}
    got = queries()["p3_percentiles"](spark, str(tmp_path)).where("level = 0.5").collect()
    assert sorted((r.period, str(r.day), r.n, round(r.value)) for r in got) == [("day", "2024-01-01", 4, 30), ("day", "None", 1, 90), ("whole", "None", 5, 30)]
