"""Queries of question compilation, symbolic read-outs, incremental jobs and event windows, and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.functions.temporal import PHRASE, first_phrase
from turnloom.operators import algebra as A
from turnloom.operators import compile as C
from turnloom.operators import facts as O
from turnloom.operators import symbolic as Y
from turnloom.plans import search_queries as SQ
from turnloom.plans.graph_queries import SQL_KIND, SQL_OWNERS, answer_kind
from turnloom.plans.lineage import shared_dir
from turnloom.plans.text_queries import _SLOTS, sql_content, sql_terms
from turnloom.plans.text_queries import SQL as _TEXT
from turnloom.sources.tables import table
from turnloom.streaming import jobs as J

FLAGS = ["is_existence", "is_duration", "is_sum", "is_count", "is_latest", "is_list", "is_advice"]


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "questions", "question_id", "memory_id", "question")
    return q.select("question_id", "memory_id", "question", *(c.alias(k) for k, c in T.slots(F.col("question")).items()))


def _operands(spark: SparkSession, folder: str) -> DataFrame:
    """Questions with slots, ``clauses``, the ``named`` owners in order of name, and ``vocabulary``: their predicate candidates, best first."""
    q = _questions(spark, folder).withColumn("clauses", F.when(F.col("is_duration"), C.event_clauses(F.col("question"))))
    named = arr_longest_alias(spark, folder).groupBy(F.col("query_id").alias("question_id")).agg(F.array_sort(F.collect_set("owner")).alias("named"))
    words = topk_predicates(spark, folder).groupBy(F.col("query_id").alias("question_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("w"))
    words = words.select("question_id", F.transform("w", lambda x: x["term"]).alias("vocabulary"))
    empty = F.array().cast("array<string>")
    return q.join(named, "question_id", "left").join(words, "question_id", "left").withColumns({"named": F.coalesce("named", empty), "vocabulary": F.coalesce("vocabulary", empty)})


def _compiled(spark: SparkSession, folder: str, read) -> DataFrame:
    """Each question compiled over its operands, in Arrow batches.

    Two clauses make two operands, else each owner named makes one (none named: one without owner); an
    operand's predicate is the best candidate of the memory's vocabulary.  More owners than one are a warning.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                r["ordinal_index"] = None if pd.isna(r["ordinal_index"]) else int(r["ordinal_index"])
                named, word = list(r["named"]), next(iter(r["vocabulary"]), "")
                who = [named[0] if named else ""] * 2 if r["clauses"] is not None else named or [""]
                ops = [C.Operand(f"o{k + 1}", owner, word) for k, owner in enumerate(who)]
                warn = ["ordinal_with_temporal_relation"] if r["ordinal_index"] is not None and r["temporal_relation"] in ("before", "after") else []
                out.append((r["question_id"], *read(C.compile_question(r, ops, warn, max(0, len(named) - 1)), r)))
            yield pd.DataFrame(out, columns=["question_id", "kind", "text", "n", "confidence"])

    return _operands(spark, folder).drop("memory_id").mapInPandas(run, "question_id string, kind string, text string, n int, confidence double")


def qc_compile(spark: SparkSession, folder: str) -> DataFrame:
    """Kind of answer, plan, number of operands and confidence of each question."""
    return _compiled(spark, folder, lambda c, r: (A.answer_kind(c.plan), A.describe(c.plan), len(c.operands), c.confidence))


def qc_soften(spark: SparkSession, folder: str) -> DataFrame:
    """Plans of low confidence, joined with their filterless form: operands before and after."""

    def read(c: C.Compiled, r: dict) -> tuple:
        s = C.soften(c)
        return A.answer_kind(s.plan), "widened" if len(s.operands) > len(c.operands) else "kept", len(s.operands), s.confidence

    return _compiled(spark, folder, read)


def qc_event_clauses(spark: SparkSession, folder: str) -> DataFrame:
    """The two events each question of a duration names, null where it names no two."""
    q = _questions(spark, folder)
    c = F.when(F.col("is_duration"), C.event_clauses(F.col("question")))
    return q.select("question_id", F.get(c, F.lit(0)).alias("first"), F.get(c, F.lit(1)).alias("second"))


def qc_compose(spark: SparkSession, folder: str) -> DataFrame:
    """Kind of answer of each question with one operand, by precedence."""
    q = _questions(spark, folder)
    return q.select("question_id", answer_kind({c: F.col(c) for c in q.columns}).alias("kind"))


def qc_obligations(spark: SparkSession, folder: str) -> DataFrame:
    """Duties of one plan per kind of node."""
    o1, o2 = A.FactSet("o1"), A.FactSet("o2")
    plans = {"count": A.CountDistinct(A.IntersectionDistinct((o1, o2))), "span": A.DateDifference(o1, o2), "state": A.LatestState(o1), "order": A.CountDistinct(A.Ordinal(o1, 1)), "lookup": A.Lookup(o1)}
    rows = [(name, kind, operand) for name, plan in plans.items() for kind, operand in A.obligations(plan).obligations]
    return spark.createDataFrame(rows, "plan string, kind string, operand_id string")


def qc_views(spark: SparkSession, folder: str) -> DataFrame:
    q = _questions(spark, folder)
    words = T.content_terms(F.col("question"))
    v = C.views(F.get(words, F.lit(0)), F.get(words, F.lit(1)), F.get(words, F.lit(2)), F.col("answer_slot"), F.coalesce(first_phrase(F.col("question")), F.lit("")))
    return q.select("question_id", F.posexplode(v).alias("pos", "v")).select("question_id", "pos", "v.kind", "v.text", "v.dense")


def qc_principals(spark: SparkSession, folder: str) -> DataFrame:
    return C.principals(table(spark, folder, "turns", "memory_id", "speaker"))


def arr_longest_alias(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "questions", "question_id", "memory_id", "question").select(F.col("question_id").alias("query_id"), F.col("memory_id").alias("scope"), F.col("question").alias("query"))
    return C.owners(q, qc_principals(spark, folder))


def _vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """(question_id, memory_id, term, df): content terms of a question that its memory's turns hold, speakers' names aside, with the number of sessions that do."""
    q = table(spark, folder, "questions", "question_id", "memory_id", "question").select("question_id", "memory_id", F.explode(T.content_terms(F.col("question"))).alias("term"))
    t = table(spark, folder, "turns", "memory_id", "session_id", "raw_text").join(q.select("memory_id").distinct(), "memory_id", "left_semi")
    df = t.select("memory_id", "session_id", F.explode(T.content_terms(F.col("raw_text"))).alias("term")).distinct().groupBy("memory_id", "term").agg(F.count(F.lit(1)).alias("df"))
    names = table(spark, folder, "turns", "memory_id", "speaker").where("speaker is not null").select("memory_id", F.explode(T.content_terms(F.col("speaker"))).alias("term")).distinct()
    return q.join(names, ["memory_id", "term"], "left_anti").join(df, ["memory_id", "term"])


def topk_predicates(spark: SparkSession, folder: str) -> DataFrame:
    """Up to four terms of a memory's vocabulary that its question holds, those in fewest sessions first."""
    w = Window.partitionBy("question_id").orderBy("df", "term")
    return _vocabulary(spark, folder).withColumn("rank", F.row_number().over(w)).where("rank <= 4").select(F.col("question_id").alias("query_id"), "term", "df", "rank")


def topk_scopes(spark: SparkSession, folder: str) -> DataFrame:
    """Up to two terms of a question, its predicate aside, by how many sessions of the memory hold them: the scopes it may mean."""
    v = _vocabulary(spark, folder)
    w = Window.partitionBy("question_id")
    rest = v.withColumn("k", F.row_number().over(w.orderBy("df", "term"))).where("k > 1")
    return rest.withColumn("rank", F.row_number().over(w.orderBy(F.col("df").desc(), "term"))).where("rank <= 2").select(F.col("question_id").alias("query_id"), "term", "df", "rank")


def topk_exact_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Best direct hit of each query: 1.4 times the coverage, 0.25 a supporting turn up to three, 0.2 the peak; none under 0.5."""
    c = SQ.num_coverage(spark, folder)
    w = Window.partitionBy("query_id")
    support = F.least(F.lit(3), F.count_if(F.col("coverage") >= 0.5).over(w))
    score = F.round(1.4 * F.col("coverage") + 0.25 * support + 0.2 * F.max("coverage").over(w), 6)
    s = c.withColumn("score", score).where("score >= 0.5")
    return s.withColumn("k", F.row_number().over(w.orderBy(F.col("score").desc(), "id"))).where("k = 1").select("query_id", "id", "score")


def topk_salient_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Up to three sentences of a turn: the longest by terms, and the first with a number or a negation."""
    said = Y.spoken_sentences(table(spark, folder, "turns", "turn_no", "memory_id", "session_id", "turn_index", "speaker", "raw_text"))
    must = F.col("sentence").rlike(r"[0-9]|(?i)\b(not|never|no)\b").cast("int")
    w = Window.partitionBy("turn_no").orderBy(must.desc(), F.size(T.content_terms(F.col("sentence"))).desc(), "pos")
    return said.withColumn("k", F.row_number().over(w)).where("k <= 3").select("turn_no", "pos", "k")


def _said(spark: SparkSession, folder: str) -> DataFrame:
    return Y.spoken_sentences(table(spark, folder, "turns", "turn_no", "memory_id", "session_id", "turn_index", "speaker", "raw_text"))


def op_sum_money(spark: SparkSession, folder: str) -> DataFrame:
    return Y.sum_quantities(_said(spark, folder), r"\b(bought|cost|paid)\b", r"\$(\d+(?:\.\d+)?)", ["memory_id"])


def op_sum_unit_quantities(spark: SparkSession, folder: str) -> DataFrame:
    return Y.sum_quantities(_said(spark, folder), r"\bowns\b", r"\bowns (\d+)", ["memory_id"])


def op_duration_sum(spark: SparkSession, folder: str) -> DataFrame:
    return Y.sum_quantities(_said(spark, folder), r"\bdays\b", r"\b(\d{1,2}) days\b", ["memory_id"])


def op_current_numeric_status(spark: SparkSession, folder: str) -> DataFrame:
    return Y.latest_number(_said(spark, folder), r"\bpages\b", r"\b(\d+) pages\b", ["memory_id"])


def op_count_attended_events(spark: SparkSession, folder: str) -> DataFrame:
    return Y.count_events(_said(spark, folder), r"\b(booked|takes place|attended)\b", r"\b(cancelled|no evidence|not)\b", r"\bthe ([a-z-]+ [a-z]+)\b", ["memory_id"])


def op_missing_required_conjunct(spark: SparkSession, folder: str) -> DataFrame:
    """Content terms of each queried question that its memory never speaks, beside those it does."""
    req = SQ.asked(spark, folder).select("query_id", F.col("scope").alias("memory_id"), F.explode(T.content_terms(F.col("query"))).alias("phrase"))
    m = Y.missing_conjuncts(req, _said(spark, folder))
    return m.select("query_id", F.array_join("present", "|").alias("present"), F.array_join("missing", "|").alias("missing"))


def op_speaker_mismatch_abstain(spark: SparkSession, folder: str) -> DataFrame:
    q = SQ.asked(spark, folder).select("query_id", F.col("scope").alias("memory_id"), T.content_terms(F.col("query")).alias("w"))
    a = q.select("query_id", "memory_id", F.lit("user").alias("target"), F.explode("w").alias("term"))
    return Y.speaker_mismatch(a, _said(spark, folder))


def _transitions(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events", "event_id", "user_id")
    wanted = F.element_at(T.lit_array(J.STATES), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), wanted.alias("wanted"))


def st_states(spark: SparkSession, folder: str) -> DataFrame:
    """The state each job's stream ends in: two runs of one stream, the second over the later half of the transitions and the state the first left."""
    at = f"{shared_dir(spark)}/states-{uuid.uuid4().hex}"
    rows = _transitions(spark, folder)
    half = rows.agg(F.coalesce(F.expr("percentile_approx(seq, 0.5)"), F.lit(0))).first()[0]
    for part in (rows.where(F.col("seq") <= half), rows.where(F.col("seq") > half)):
        part.write.mode("append").parquet(f"{at}/in")
        J.run_states(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    every = spark.read.schema("job_id bigint, state string, attempts int, refused int").parquet(f"{at}/out")
    return every.groupBy("job_id").agg(F.max_by(F.struct("state", "attempts", "refused"), "attempts").alias("s")).select("job_id", "s.*")


def st_append(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs delivered twice, appended once; offsets stay unique per memory."""
    e = table(spark, folder, "events", "event_id", "user_id", "props")
    jobs = e.select(F.concat(F.lit("j"), "event_id").alias("job_id"), F.pmod("user_id", F.lit(20)).cast("string").alias("memory_id"), F.col("event_id").alias("source_offset"), F.sha2("props", 256).alias("payload_hash"))
    stored = jobs.where("source_offset % 3 = 0")
    fresh = J.new_jobs(stored, jobs.unionByName(jobs.where("source_offset % 5 = 0")))
    return stored.unionByName(fresh).groupBy("memory_id").agg(F.count(F.lit(1)).alias("jobs"), F.max("source_offset").alias("last_offset"))


def st_stream_append(spark: SparkSession, folder: str) -> DataFrame:
    """The same through a stream over files, read back from what it wrote."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, folder, "events", "event_id", "user_id", "props")
    jobs = e.select(F.concat(F.lit("j"), "event_id").alias("job_id"), F.pmod("user_id", F.lit(20)).cast("string").alias("memory_id"), F.col("event_id").alias("source_offset"), F.sha2("props", 256).alias("payload_hash"))
    jobs.write.parquet(f"{at}/in")
    jobs.where("source_offset % 4 = 0").write.mode("append").parquet(f"{at}/in")
    source = spark.readStream.schema(jobs.schema).option("maxFilesPerTrigger", 4).parquet(f"{at}/in")
    q = J.append_stream(source, f"{at}/out", f"{at}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("memory_id").agg(F.count(F.lit(1)).alias("jobs"), F.max("source_offset").alias("last_offset"))


def st_outbox(spark: SparkSession, folder: str) -> DataFrame:
    """Pending changes: the newest per memory."""
    t = table(spark, folder, "turns", "memory_id", "turn_no", "ingested_at")
    return O.last_per_key(t, ["memory_id"], ["ingested_at", "turn_no"]).select("memory_id", "turn_no")


def st_window_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    w = J.windowed(table(spark, folder, "events"), "1 day", "1 day")
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def st_window_sliding(spark: SparkSession, folder: str) -> DataFrame:
    w = J.windowed(table(spark, folder, "events"), "1 day", "2 days", "1 day")
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def st_window_session(spark: SparkSession, folder: str) -> DataFrame:
    s = J.sessions_of(table(spark, folder, "events"), "1 day", "1 day")
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def json_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Sorted-key JSON of a question's fields and its digest."""
    q = table(spark, folder, "questions", "question_id", "memory_id", "question_type")
    j = F.to_json(F.struct("memory_id", "question_id", "question_type"))
    return q.select("question_id", F.sha2(j, 256).alias("digest"))


def set_union(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct owners of purchases or views."""
    e = table(spark, folder, "events", "user_id", "event_type")
    return e.where("event_type = 'purchase'").select("user_id").union(e.where("event_type = 'view'").select("user_id")).distinct()


def qc_answer_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of time with two cited turns or more in different sessions: both ends have a witness."""
    q = _questions(spark, folder).where("is_duration or temporal_relation <> '' or answer_slot = 'date'").select("question_id")
    a = table(spark, folder, "answers", "question_id", "evidence_turn_ids").select("question_id", F.explode("evidence_turn_ids").alias("turn_id")).distinct()
    t = table(spark, folder, "turns", "turn_id", "session_id").distinct()
    return q.join(a, "question_id").join(t, "turn_id").groupBy("question_id").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("session_id").alias("sessions")).where("turns >= 2 and sessions >= 2")


def qc_worksheet_route(spark: SparkSession, folder: str) -> DataFrame:
    intent = T.aggregation_intent(F.col("question"))
    route = F.when(intent == "sum", "sum_worksheet").when(intent == "count_distinct", "direct_count").when(intent.isin("mean", "unit_rate"), "ratio_worksheet").when(intent.isin("difference", "date_difference"), "difference_worksheet").when(intent.isNotNull(), "extreme_worksheet")
    return table(spark, folder, "questions", "question_id", "question").select("question_id", route.alias("route"))


QUERIES = {f.__name__: f for f in (
    qc_compile, qc_compose, qc_soften, qc_event_clauses, qc_obligations, qc_views, qc_principals, qc_answer_plan, qc_worksheet_route, arr_longest_alias, topk_predicates, topk_scopes, topk_exact_lookup, topk_salient_spans,
    op_sum_money, op_sum_unit_quantities, op_duration_sum, op_current_numeric_status, op_count_attended_events, op_missing_required_conjunct, op_speaker_mismatch_abstain,
    st_states, st_append, st_stream_append, st_outbox, st_window_tumbling, st_window_sliding, st_window_session, json_canonical, set_union,
)}

_SAID = "s0 AS (SELECT turn_no, memory_id, speaker, list_filter(list_transform(regexp_extract_all(raw_text, '[^.!?\\n]+[.!?]*'), lambda s: regexp_replace(s, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda s: s <> '') AS ss FROM turns WHERE raw_text IS NOT NULL), said AS (SELECT turn_no, memory_id, speaker, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos FROM s0)"


def _sum(include: str, number: str) -> str:
    return f"""WITH {_SAID}, m AS (SELECT DISTINCT memory_id, sentence, CAST(nullif(regexp_extract(sentence, '{number}', 1), '') AS DECIMAL(18,2))::DOUBLE AS v FROM said WHERE regexp_matches(sentence, '{include}') AND NOT regexp_matches(sentence, '\\?\\s*$'))
 SELECT memory_id, round(sum(v), 2) AS total, count(*) AS n FROM m WHERE v IS NOT NULL GROUP BY memory_id"""


_JOBS = "SELECT CAST(user_id % 20 AS VARCHAR) AS memory_id, count(*) AS jobs, max(event_id) AS last_offset FROM events GROUP BY ALL"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_CLAUSES = f"""qs AS (SELECT question_id, is_duration, regexp_replace(trim(question, ' '), '[?.!]+$', '') AS t, regexp_matches(question, {_q(C.MEASURE)}) AS me FROM ({_SLOTS}) JOIN questions USING (question_id)),
 qp AS (SELECT question_id, is_duration AND me AS ok, CASE WHEN regexp_matches(t, {_q(C.BETWEEN)}) THEN [trim(regexp_extract(t, {_q(C.BETWEEN)}, 1), ' '), trim(regexp_extract(t, {_q(C.BETWEEN)}, 2), ' ')] ELSE [regexp_replace(trim(regexp_extract(t, {_q(C.SPLIT)}, 1), ' '), {_q(C.LEAD)}, ''), trim(regexp_extract(t, {_q(C.SPLIT)}, 2), ' ')] END AS c FROM qs),
 cl AS (SELECT question_id, CASE WHEN ok AND len(list_distinct({sql_content('c[1]')})) >= 2 AND len(list_distinct({sql_content('c[2]')})) >= 2 THEN c END AS c FROM qp)"""
_VOCAB = f"""vq AS (SELECT question_id, memory_id, unnest(list_distinct({sql_content('question')})) AS term FROM questions), vd AS (SELECT memory_id, term, count(DISTINCT coalesce(session_id, '')) AS df FROM (SELECT memory_id, session_id, unnest({sql_content('raw_text')}) AS term FROM turns WHERE memory_id IN (SELECT memory_id FROM questions)) GROUP BY ALL),
 vn AS (SELECT DISTINCT memory_id, unnest({sql_content('speaker')}) AS term FROM turns), vo AS (SELECT question_id, term, df FROM vq JOIN vd USING (memory_id, term) WHERE (memory_id, term) NOT IN (SELECT (memory_id, term) FROM vn WHERE memory_id IS NOT NULL AND term IS NOT NULL))"""
_PLANS = f"""{_CLAUSES}, {_VOCAB}, nm AS (SELECT query_id AS question_id, count(DISTINCT owner) AS n FROM ({SQL_OWNERS}) GROUP BY ALL), wd AS (SELECT DISTINCT question_id FROM vo),
 k0 AS (SELECT k.*, c, coalesce(n, 0) AS owners, CASE WHEN c IS NOT NULL THEN 2 ELSE greatest(1, coalesce(n, 0)) END AS m, wd.question_id IS NOT NULL AND NOT is_advice AS worded FROM ({_SLOTS}) k JOIN cl USING (question_id) LEFT JOIN nm USING (question_id) LEFT JOIN wd USING (question_id)),
 k1 AS (SELECT *, list_transform(range(1, m + 1), lambda i: 'FactSet(o' || i || ')') AS fs, quantifier IN ('both', 'either') AS shared, quantifier IN ('each', 'every', 'respectively') AS every FROM k0),
 k2 AS (SELECT *, CASE WHEN m = 1 THEN fs[1] WHEN shared THEN 'IntersectionDistinct(' || array_to_string(fs, ', ') || ', by=' || distinct_by || ')' WHEN every THEN 'GroupByOwner(UnionDistinct(' || array_to_string(fs, ', ') || ', by=' || distinct_by || '))' ELSE 'UnionDistinct(' || array_to_string(fs, ', ') || ', by=' || distinct_by || ')' END AS inn FROM k1),
 k3 AS (SELECT *, CASE WHEN is_existence THEN 'ExistsAll(' || array_to_string(fs, ', ') || ')' WHEN is_duration THEN 'DateDifference(' || fs[1] || ', ' || fs[CASE WHEN m > 1 THEN 2 ELSE 1 END] || ')' WHEN is_sum THEN 'Sum(' || inn || ', unit=)' WHEN is_count THEN 'CountDistinct(' || inn || ', by=' || distinct_by || ')'
  WHEN ordinal_index IS NOT NULL THEN 'Ordinal(' || inn || ', k=' || ordinal_index || ', order=' || CASE WHEN ordinal_index = -1 THEN 'descending' ELSE 'ascending' END || ')' WHEN is_latest THEN 'LatestState(' || inn || ')' WHEN temporal_relation = 'before' THEN 'ArgMinTime(' || inn || ')' WHEN temporal_relation = 'after' THEN 'ArgMaxTime(' || inn || ')'
  WHEN m > 1 THEN inn WHEN is_list AND quantifier <> '' THEN 'UnionDistinct(' || fs[1] || ', by=' || distinct_by || ')' ELSE 'Lookup(' || fs[1] || ')' END AS text FROM k2),
 k4 AS (SELECT *, regexp_matches(text, 'CountDistinct|Sum|GroupByOwner|UnionDistinct|IntersectionDistinct|ExistsAll') AS whole, CASE WHEN starts_with(text, 'GroupByOwner') THEN 'group' ELSE {SQL_KIND} END AS kind FROM k3),
 pl AS (SELECT question_id, kind, text, CAST(m AS INT) AS n, round(greatest(0, 1.0::DOUBLE - CASE WHEN ordinal_index IS NOT NULL AND temporal_relation IN ('before', 'after') THEN 0.10::DOUBLE ELSE 0 END - least(0.35::DOUBLE, 0.12::DOUBLE * greatest(0, owners - 1)) - CASE WHEN whole AND NOT worded THEN 0.15::DOUBLE ELSE 0 END), 4) AS confidence FROM k4)"""

SQL = {
    "qc_compose": f"WITH k AS ({_SLOTS}) SELECT question_id, {SQL_KIND} AS kind FROM k",
    "qc_obligations": """SELECT * FROM (VALUES ('count','binding','o1'), ('count','provenance','o1'), ('count','binding','o2'), ('count','provenance','o2'), ('count','collection','o1'), ('count','collection','o2'),
 ('span','binding','o1'), ('span','provenance','o1'), ('span','binding','o2'), ('span','provenance','o2'), ('span','time_endpoint','o1'), ('span','time_endpoint','o2'), ('state','binding','o1'), ('state','provenance','o1'), ('state','state_history','o1'),
 ('order','binding','o1'), ('order','provenance','o1'), ('order','ordering','o1'), ('order','collection','o1'), ('lookup','binding','o1'), ('lookup','provenance','o1')) t(plan, kind, operand_id)""",
    "qc_principals": "WITH t AS (SELECT memory_id, speaker, count(*) AS turns, lower(trim(speaker)) AS l FROM turns WHERE speaker <> '' GROUP BY ALL) SELECT memory_id, speaker, CASE WHEN l = 'assistant' THEN 'assistant' WHEN l IN ('user', 'human', 'ai', 'system', 'tool') THEN 'memory_user' ELSE 'conversation_participant' END AS role, turns, l NOT IN ('user', 'assistant', 'human', 'ai', 'system', 'tool') AS named, CASE WHEN l IN ('user', 'assistant', 'human', 'ai', 'system', 'tool') THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM t",
    "qc_answer_plan": f"WITH k AS ({_SLOTS}), a AS (SELECT DISTINCT question_id, unnest(evidence_turn_ids) AS turn_id FROM answers) SELECT question_id, count(*) AS turns, count(DISTINCT session_id) AS sessions FROM k JOIN a USING (question_id) JOIN (SELECT DISTINCT turn_id, session_id FROM turns) USING (turn_id) WHERE is_duration OR temporal_relation <> '' OR answer_slot = 'date' GROUP BY question_id HAVING count(*) >= 2 AND count(DISTINCT session_id) >= 2",
    "qc_worksheet_route": "SELECT question_id, CASE WHEN intent = 'sum' THEN 'sum_worksheet' WHEN intent = 'count_distinct' THEN 'direct_count' WHEN intent IN ('mean', 'unit_rate') THEN 'ratio_worksheet' WHEN intent IN ('difference', 'date_difference') THEN 'difference_worksheet' WHEN intent IS NOT NULL THEN 'extreme_worksheet' END AS route FROM (" + _TEXT["str_agg_intent"] + ")",
    "arr_longest_alias": SQL_OWNERS,
    "topk_predicates": f"WITH {_VOCAB} SELECT question_id AS query_id, term, df, row_number() OVER (PARTITION BY question_id ORDER BY df, term) AS rank FROM vo QUALIFY rank <= 4",
    "topk_scopes": f"WITH {_VOCAB}, x AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY df, term) AS k FROM vo) SELECT question_id AS query_id, term, df, row_number() OVER (PARTITION BY question_id ORDER BY df DESC, term) AS rank FROM x WHERE k > 1 QUALIFY rank <= 2",
    "topk_exact_lookup": SQ.SQL["num_coverage"].replace(" SELECT query_id, id,", ", cov AS (SELECT query_id, id,") + "), z AS (SELECT query_id, id, round(1.4::DOUBLE * coverage + 0.25::DOUBLE * least(3, count(*) FILTER (coverage >= 0.5) OVER (PARTITION BY query_id)) + 0.2::DOUBLE * max(coverage) OVER (PARTITION BY query_id), 6) AS score FROM cov) SELECT * FROM z WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1",
    "topk_salient_spans": f"WITH {_SAID} SELECT turn_no, CAST(pos AS INT) AS pos, row_number() OVER (PARTITION BY turn_no ORDER BY regexp_matches(sentence, '[0-9]|(?i)\\b(not|never|no)\\b') DESC, len(list_distinct({sql_content('sentence')})) DESC, pos) AS k FROM said QUALIFY k <= 3",
    "op_sum_money": _sum("\\b(bought|cost|paid)\\b", "\\$(\\d+(?:\\.\\d+)?)"),
    "op_sum_unit_quantities": _sum("\\bowns\\b", "\\bowns (\\d+)"),
    "op_duration_sum": _sum("\\bdays\\b", "\\b(\\d{1,2}) days\\b"),
    "op_current_numeric_status": f"WITH {_SAID}, m AS (SELECT memory_id, turn_no, pos, regexp_extract(sentence, '\\b(\\d+) pages\\b', 1) AS v FROM said WHERE regexp_matches(sentence, '\\bpages\\b') AND NOT regexp_matches(sentence, '\\?\\s*$')) SELECT memory_id, CAST(v AS INT) AS value, turn_no FROM m WHERE v <> '' QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY turn_no DESC, pos DESC) = 1",
    "op_count_attended_events": f"WITH {_SAID}, m AS (SELECT memory_id, sentence, regexp_extract(sentence, '\\bthe ([a-z-]+ [a-z]+)\\b', 1) AS k FROM said WHERE regexp_matches(sentence, '\\b(booked|takes place|attended)\\b') AND NOT regexp_matches(sentence, '\\?\\s*$') AND NOT regexp_matches(sentence, '\\b(cancelled|no evidence|not)\\b')) SELECT memory_id, count(DISTINCT CASE WHEN k = '' THEN left(sentence, 80) ELSE k END) AS events FROM m GROUP BY ALL",
    "op_missing_required_conjunct": f"""WITH {SQ._BASE}, v AS (SELECT DISTINCT memory_id AS scope, unnest({sql_content('raw_text')}) AS term FROM turns WHERE raw_text IS NOT NULL), j AS (SELECT query_id, qt.term, v.term IS NOT NULL AS there FROM qt LEFT JOIN v USING (scope, term))
 SELECT query_id, string_agg(term, '|' ORDER BY term) FILTER (there) AS present, string_agg(term, '|' ORDER BY term) FILTER (NOT there) AS missing FROM j GROUP BY query_id HAVING bool_or(there) AND bool_or(NOT there)""",
    "op_speaker_mismatch_abstain": f"""WITH {SQ._BASE}, v AS (SELECT DISTINCT memory_id AS scope, lower(speaker) AS speaker, unnest({sql_content('raw_text')}) AS term FROM turns WHERE speaker IS NOT NULL)
 SELECT query_id, 'user' AS target, min(speaker) FILTER (speaker <> 'user') AS other FROM qt JOIN v USING (scope, term) GROUP BY query_id HAVING NOT bool_or(speaker = 'user') AND count(*) FILTER (speaker <> 'user') > 0""",
    "st_append": _JOBS,
    "st_stream_append": _JOBS,
    "st_outbox": "SELECT memory_id, turn_no FROM turns QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY ingested_at DESC, turn_no DESC) = 1",
    "st_window_tumbling": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "st_window_sliding": "WITH e AS (SELECT date_trunc('day', ts) - to_days(CAST(k AS INT)) AS d, event_type FROM events, (SELECT unnest([0, 1]) AS k)) SELECT strftime(d, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM e GROUP BY ALL",
    "st_window_session": "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 DAY THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a), c AS (SELECT user_id, g, count(*) AS n FROM b GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY ALL",
    "json_canonical": """SELECT question_id, sha256('{"memory_id":"' || memory_id || '","question_id":"' || question_id || '","question_type":"' || question_type || '"}') AS digest FROM questions""",
    "set_union": "SELECT user_id FROM events WHERE event_type = 'purchase' UNION SELECT user_id FROM events WHERE event_type = 'view'",
    "qc_event_clauses": f"WITH {_CLAUSES} SELECT question_id, c[1] AS first, c[2] AS second FROM cl",
    "qc_compile": f"WITH {_PLANS} SELECT * FROM pl",
    "qc_soften": f"WITH {_PLANS} SELECT question_id, kind, CASE WHEN confidence < 0.80 THEN 'widened' ELSE 'kept' END AS text, CAST(CASE WHEN confidence < 0.80 THEN 2 * n ELSE n END AS INT) AS n, confidence FROM pl",
    "qc_views": f"""WITH w0 AS (SELECT question_id, {sql_content('question')} AS l FROM questions), w AS (SELECT k.question_id, question, list_filter(l, lambda v, i: list_position(l, v) = i) AS w, answer_slot, coalesce(nullif(regexp_replace(regexp_extract(question, {_q(PHRASE)}, 0), '\\s+', ' ', 'g'), ''), '') AS ph FROM ({_SLOTS}) k JOIN questions USING (question_id) JOIN w0 USING (question_id)),
 v AS (SELECT question_id, unnest([{{'k': 'owner', 't': w[1], 'd': false, 'on': len(w) > 0}}, {{'k': 'predicate', 't': w[2], 'd': false, 'on': len(w) > 1}}, {{'k': 'owner_predicate', 't': w[1] || ' ' || w[2], 'd': true, 'on': len(w) > 1}}, {{'k': 'predicate_answer_slot', 't': w[2] || ' ' || answer_slot, 'd': false, 'on': len(w) > 1 AND answer_slot <> ''}},
  {{'k': 'scope_predicate', 't': w[3] || ' ' || w[2], 'd': false, 'on': len(w) > 2}}, {{'k': 'temporal_event', 't': ph, 'd': false, 'on': ph <> ''}}]) AS x, unnest(range(6)) AS i FROM w),
 n AS (SELECT question_id, x.k AS kind, array_to_string({sql_terms('x.t')}, ' ') AS text, x.d AS dense, i FROM v WHERE x.on), f AS (SELECT * FROM n WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY question_id, text ORDER BY i) = 1)
 SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY i) - 1 AS INT) AS pos, kind, text, dense FROM f""",
    "st_states": f"""WITH e AS (SELECT user_id AS job_id, event_id AS seq, event_id % 5 AS w FROM events), n AS (SELECT job_id, count(*) AS n FROM e GROUP BY ALL), a1 AS (SELECT job_id, min(seq) AS s FROM e WHERE w = 1 GROUP BY ALL), a2 AS (SELECT e.job_id, min(seq) AS s FROM e JOIN a1 ON a1.job_id = e.job_id AND seq > a1.s WHERE w = 2 GROUP BY ALL),
 a3 AS (SELECT e.job_id, min(seq) AS s FROM e JOIN a2 ON a2.job_id = e.job_id AND seq > a2.s WHERE w = 3 GROUP BY ALL), a4 AS (SELECT e.job_id, min(seq) AS s FROM e JOIN a3 ON a3.job_id = e.job_id AND seq > a3.s WHERE w = 4 GROUP BY ALL),
 k AS (SELECT n.job_id, n.n, CASE WHEN a4.s IS NOT NULL THEN 4 WHEN a3.s IS NOT NULL THEN 3 WHEN a2.s IS NOT NULL THEN 2 WHEN a1.s IS NOT NULL THEN 1 ELSE 0 END AS k FROM n LEFT JOIN a1 USING (job_id) LEFT JOIN a2 USING (job_id) LEFT JOIN a3 USING (job_id) LEFT JOIN a4 USING (job_id))
 SELECT job_id, ['{"', '".join(J.STATES)}'][k + 1] AS state, CAST(n AS INT) AS attempts, CAST(n - k AS INT) AS refused FROM k""",
}
