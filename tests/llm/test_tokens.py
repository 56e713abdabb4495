import os

import pytest
from pyspark.sql import functions as F

from turnloom.llm import tokens as K

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(K.FOLDER, K.RANKS)), reason="no vocabulary files")
DOCS = "doc_id bigint, text string, source string, lang string, topic string, n_tokens int"


def plain_count(text):
    return len(K.encoder(K.FOLDER, K.RANKS).encode_ordinary(text))


def cube(rows):
    return {(r.source, r.language, r.topic): (r.n_rows, r.n_tokens) for r in rows.collect()}


def brute(docs):
    out = {}
    for _, text, source, lang, topic, _ in docs:
        code = {"eng": "en", "en": "en", "DE": "de"}.get(lang, "und")
        key = ((source or "").strip().lower() or "unknown", code, (topic or "").strip().lower() or "unknown")
        n, t = out.get(key, (0, 0))
        out[key] = (n + 1, t + (plain_count(text) if text else 0))
    return out


def test_cube_equals_brute_force_with_nulls_empties_and_copies(spark):
    docs = [(1, "Hello there", "Web ", "eng", "x", 7), (2, "Hello there", "web", "en", "x", 7), (3, None, "web", None, None, None), (4, "", None, "DE", "", 1), (5, "längerer Text, " * 5000, "b", "DE", "y", 0)]
    df = spark.createDataFrame(docs, DOCS)
    counts = K.count_tokens(df.select(K.content_hash(F.col("text")).alias("content_hash"), "text"))
    assert cube(K.token_cube(K.document_rows(df), counts, ["source", "language", "topic"])) == brute(docs)


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    counts = K.count_tokens(df.select(K.content_hash(F.col("text")).alias("content_hash"), "text"))
    assert K.token_cube(K.document_rows(df), counts, ["source", "language", "topic"]).count() == 0


def test_ledger_encodes_only_new_contents_and_follows_removals(spark, tmp_path):
    ledger = K.TokenLedger(spark, str(tmp_path))
    first = [(1, "one two", "a", "en", "t", 0), (2, "three", "a", "en", "t", 0), (3, "gone soon", "b", "en", "t", 0)]
    then = [(1, "one two", "a", "en", "t", 0), (2, "three four five", "a", "en", "t", 0), (4, "one two", "c", "en", "t", 0)]
    assert cube(ledger.refresh(spark.createDataFrame(first, DOCS))) == brute(first)
    assert cube(ledger.refresh(spark.createDataFrame(then, DOCS))) == brute(then)
    # "one two" was counted once, in the first version, and the removed source has no cell left.
    assert ledger.read("counts").count() == 4
    assert ledger.version() == 2


def test_known_contents_are_not_encoded_again(spark):
    df = spark.createDataFrame([("a",), ("b",)], "text string").withColumn("content_hash", K.content_hash(F.col("text")))
    known = K.count_tokens(df.where("text = 'a'"))
    assert K.count_tokens(df, known).count() == 1


def test_conversation_budget_sums_turns_and_evidence(spark):
    turns = spark.createDataFrame([("m1", "hi there"), ("m1", None), ("m2", "x"), ("m3", "y")], "memory_id string, raw_text string")
    reg = spark.createDataFrame([("m1", "A ", "en", 1), ("m1", "a", "en", 2), ("m2", None, "de-XX", 1)], "memory_id string, dataset string, lang string, registered_at int")
    answers = spark.createDataFrame([("m1", 5), ("m1", None), ("m4", 7)], "memory_id string, evidence_tokens int")
    got = {(r.dataset, r.language): (r.n_rows, r.n_tokens, r.evidence_tokens) for r in K.conversation_budget(turns, reg, answers).collect()}
    assert got == {("a", "en"): (2, plain_count("hi there"), 5), ("unknown", "de"): (1, plain_count("x"), 0), ("unknown", "und"): (1, plain_count("y"), 7)}


def test_ledger_follows_changed_and_removed_turns(spark, tmp_path):
    schema = "memory_id string, raw_text string, content_hash string"
    ledger = K.TokenLedger(spark, str(tmp_path), dims=("memory_id",))
    first = [("m1", "one two", "x"), ("m1", "one two", "x"), ("m2", None, "x"), (None, "three", "x")]
    then = [("m1", "one two", "x"), ("m2", "one two more", "x"), ("m2", None, "x")]
    for rows in (first, then, [], then):
        got = {r.memory_id: (r.n_rows, r.n_tokens) for r in ledger.deliver(K.turn_rows(spark.createDataFrame(rows, schema).drop("content_hash"))).collect()}
        assert got == {m: (sum(a == m for a, *_ in rows), sum(plain_count(t) for a, t, _ in rows if a == m and t)) for m in {r[0] for r in rows}}
    assert [ledger.spark.read.parquet(f"{tmp_path}/v{v:06d}/counts").count() for v in (1, 2, 3, 4)] == [2, 1, 0, 0]


def test_a_worker_with_other_files_is_refused():
    with pytest.raises(ValueError):
        K.encoder(K.FOLDER, K.RANKS, "other")
