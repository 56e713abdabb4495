from turnloom.plans.time_queries import judged


def test_verdicts_read_the_predictions_and_unchanged_ones_keep_theirs(spark):
    q = spark.createDataFrame([("a", "t", "5 km"), ("b", "t", "blue"), ("c", "t", "Oslo"), ("d", "t", "x"), ("e", "t", None)], "question_id string, question_type string, gold_answer string")
    rows = [("a", 1, "It is 15 km.", 2), ("a", 2, "It is 5 km.", None), ("b", 1, "A BLUE one", 1), ("b", 2, None, 2), ("c", 1, "In Oslo", 2), ("c", 2, "In Oslo", 3), ("d", 1, "no", 1), ("d", 2, "not", 2), ("e", 1, "no", 1)]
    a = spark.createDataFrame(rows, "question_id string, answer_no int, prediction string, evidence_tokens int")
    assert [tuple(r) for r in judged(q, a).collect()] == [("t", 1, 1)]
