from turnloom.streaming import jobs as J


def test_states_survive_between_runs_of_a_stream(spark, tmp_path):
    rows = [(1, 1, "RAW_DURABLE"), (1, 3, "FACT_INDEXED"), (2, 2, "FACT_INDEXED"), (1, 4, "RAW_DURABLE"), (2, 6, "RAW_DURABLE"), (1, 7, "RELATION_INDEXED"), (2, 8, "unheard of")]
    schema = "job_id bigint, seq bigint, wanted string"
    for part in (rows[:3], rows[3:], []):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        J.run_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("attempts").collect():
        got[r.job_id] = (r.state, r.attempts, r.refused)
    want = {r.job_id: (r.state, r.attempts, r.refused) for r in J.replayed(spark.createDataFrame(rows, schema)).collect()}
    assert got == want == {1: ("RELATION_INDEXED", 4, 1), 2: ("RAW_DURABLE", 3, 2)}
