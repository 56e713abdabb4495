"""Queries of time phrases, numbers and retrieval metrics, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import numbers as N
from turnloom.functions import temporal as D
from turnloom.operators import algebra as A
from turnloom.operators import metrics as M
from turnloom.sources.canonical import FACTS, facts
from turnloom.sources.tables import table


def _spoken(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "turns", "turn_no", "raw_text", "ingested_at")


def dt_extract(spark: SparkSession, folder: str) -> DataFrame:
    return _spoken(spark, folder).select("turn_no", D.first_phrase(F.col("raw_text")).alias("phrase"))


def dt_extract_all(spark: SparkSession, folder: str) -> DataFrame:
    return _spoken(spark, folder).select("turn_no", F.array_join(F.array_sort(D.all_phrases(F.col("raw_text"))), "|").alias("phrases"))


def _recorded(spark: SparkSession, folder: str) -> DataFrame:
    p = D.parsed(F.col("ts_raw"))
    return table(spark, folder, "sessions", "session_no", "ts_raw").select("session_no", p["start"].alias("start"), p["precision"].alias("precision"))


def dt_parse(spark: SparkSession, folder: str) -> DataFrame:
    return _recorded(spark, folder)


def dt_end(spark: SparkSession, folder: str) -> DataFrame:
    return _recorded(spark, folder).where("start is not null").select("session_no", D.end_of(F.col("start"), F.col("precision")).alias("end"))


def dt_observed(spark: SparkSession, folder: str) -> DataFrame:
    r = _recorded(spark, folder).where("start is not null")
    return r.select("session_no", "start", D.end_of(F.col("start"), F.col("precision")).alias("end"), F.lit("observed").alias("kind"), F.lit(1.0).alias("confidence"))


def dt_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """First phrase of each turn seen from the day it came in."""
    t = _spoken(spark, folder).select("turn_no", D.first_phrase(F.col("raw_text")).alias("phrase"), F.to_date("ingested_at").alias("day")).where("phrase is not null")
    r = D.relative(F.col("phrase"), F.col("day"))
    return t.select("turn_no", "phrase", r["start"].alias("start"), r["precision"].alias("precision"))


def dt_sort_key(spark: SparkSession, folder: str) -> DataFrame:
    r = _recorded(spark, folder).withColumn("end", D.end_of(F.col("start"), F.col("precision")))
    w = Window.partitionBy(F.pmod("session_no", F.lit(50))).orderBy(*D.sort_key(F.col("start"), F.col("end"), F.col("precision")), "session_no")
    return r.select("session_no", F.row_number().over(w).alias("place"))


def dt_days_between(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "sessions", "session_no", "ts_raw", "ingested_at")
    return s.select("session_no", F.datediff(F.to_date("ingested_at"), F.to_date(D.parsed(F.col("ts_raw"))["start"])).alias("days"))


def dt_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a session's recorded span meets the day before it came in."""
    s = table(spark, folder, "sessions", "session_no", "ts_raw", "ingested_at").withColumn("p", D.parsed(F.col("ts_raw"))).where("p is not null")
    day = F.date_trunc("DAY", F.col("ingested_at")).cast("timestamp_ntz") - F.expr("INTERVAL '1' DAY")
    return s.select("session_no", D.overlaps(F.col("p.start"), D.end_of(F.col("p.start"), F.col("p.precision")), day, day + F.expr("INTERVAL '1' DAY")).alias("meets"))


def dt_scalars(spark: SparkSession, folder: str) -> DataFrame:
    d = F.regexp_replace("question_date", "/", "-")
    part = F.pmod(F.split("question_id", "_")[2].cast("int"), F.lit(3))
    v = F.when(part == 0, F.substring(d, 1, 4)).when(part == 1, F.substring(d, 1, 7)).otherwise(d)
    return table(spark, folder, "questions", "question_id", "question_date").select("question_id", D.epoch_days(v).alias("days"))


def dt_kernel(spark: SparkSession, folder: str) -> DataFrame:
    """Closeness of an owner's first purchase and first view."""
    f = facts(spark, folder).groupBy("owner_id").agg(F.min(F.when(F.col("operand_id") == "o1", F.col("ts"))).alias("a"), F.min(F.when(F.col("operand_id") == "o2", F.col("ts"))).alias("b"))
    return f.where("a is not null and b is not null").select("owner_id", F.round(D.closeness(F.abs(F.datediff(F.to_date("a"), F.to_date("b")))), 6).alias("kernel"))


def num_scalar(spark: SparkSession, folder: str) -> DataFrame:
    s = A.scalar(F.col("value"), F.col("value_type"))
    return facts(spark, folder).select("binding_id", s["number"].alias("number"), s["unit"].alias("unit"))


def num_list(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of each answer; the twin takes the sign before a number along in place of the lookbehind."""
    return table(spark, folder, "answers", "answer_no", "prediction").select("answer_no", F.array_join(N.number_list(F.col("prediction")), "|").alias("numbers"))


def num_rate_pair(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    text = F.concat(F.lit("Bought "), F.col("l_quantity").cast("int").cast("string"), F.lit(" lamps at $"), (F.col("l_extendedprice") / 100).cast("int").cast("string"), F.lit(" each."))
    p = N.rate_pair(text)
    return e.select("l_orderkey", "l_linenumber", p["count"].alias("n"), p["rate"].alias("rate"))


def num_fact_cap(spark: SparkSession, folder: str) -> DataFrame:
    t = _spoken(spark, folder).where("raw_text is not null")
    n = F.size(F.regexp_extract_all("raw_text", F.lit(r"[.!?]"), F.lit(0)))
    m = F.size(F.regexp_extract_all("raw_text", F.lit(r"[0-9]+"), F.lit(0)))
    return t.select("turn_no", N.fact_cap(n, m, F.lit(1)).alias("cap"))


def _gold(spark: SparkSession, folder: str) -> DataFrame:
    """Gold turns of the query set: turns cited by the question's first answer."""
    a = table(spark, folder, "answers", "question_id", "answer_no", "evidence_turn_ids").groupBy("question_id").agg(F.min_by("evidence_turn_ids", "answer_no").alias("ids"))
    t = table(spark, folder, "turns", "turn_id", "turn_no").groupBy("turn_id").agg(F.min("turn_no").alias("id"))
    return a.select(F.col("question_id").alias("query_id"), F.explode("ids").alias("turn_id")).join(t, "turn_id").select("query_id", "id")


def _found(spark: SparkSession, folder: str) -> DataFrame:
    """Cited turns of the question's last answer, in order."""
    a = table(spark, folder, "answers", "question_id", "answer_no", "evidence_turn_ids").groupBy("question_id").agg(F.max_by("evidence_turn_ids", "answer_no").alias("ids"))
    t = table(spark, folder, "turns", "turn_id", "turn_no").groupBy("turn_id").agg(F.min("turn_no").alias("id"))
    rows = a.select(F.col("question_id").alias("query_id"), F.posexplode("ids").alias("pos", "turn_id")).join(t, "turn_id").groupBy("query_id", "id").agg(F.min("pos").alias("pos"))
    return rows.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")).alias("rank"))


def _six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def ev_set(spark: SparkSession, folder: str) -> DataFrame:
    return _six(M.set_metrics(_gold(spark, folder), _found(spark, folder).select("query_id", "id")), "precision", "recall", "f1")


def ev_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return _six(M.ranked_metrics(_gold(spark, folder), _found(spark, folder), 8), "reciprocal_rank", "average_precision", "r_precision", "recall", "ndcg")


def _strata(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "questions", "question_id", "question_type").select(F.col("question_id").alias("query_id"), F.col("question_type").alias("stratum"))
    return ev_set(spark, folder).join(q, "query_id")


def agg_metrics_macro(spark: SparkSession, folder: str) -> DataFrame:
    return _six(M.macro(_strata(spark, folder), "stratum", ["precision", "recall", "f1"]), "precision", "recall", "f1")


def agg_metrics_micro(spark: SparkSession, folder: str) -> DataFrame:
    s = _strata(spark, folder).groupBy("stratum").agg(F.sum("hits").alias("hits"), F.sum("turns").alias("turns"), F.sum("gold").alias("gold"))
    p, r = M.ratio(F.col("hits"), F.col("turns")), M.ratio(F.col("hits"), F.col("gold"))
    return s.select("stratum", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(M.ratio(2 * p * r, p + r), 6).alias("f1"))


def ev_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    """Macro and micro means side by side."""
    a = agg_metrics_macro(spark, folder).select("stratum", F.col("f1").alias("macro_f1"), "n")
    return a.join(agg_metrics_micro(spark, folder).select("stratum", F.col("f1").alias("micro_f1")), "stratum", "left")


def ev_failure_stage(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "turns", "turn_no", "session_id").select(F.col("turn_no").alias("id"), "session_id")
    g, f = _gold(spark, folder).join(t, "id"), _found(spark, folder).select("query_id", "id").join(t, "id")
    gs = g.select("query_id", "session_id").distinct().join(f.select("query_id", "session_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "session_id"], "left").groupBy("query_id").agg(F.count("hit").alias("session_hits"), F.count(F.lit(1)).alias("sessions"))
    m = ev_set(spark, folder).where("gold > 0").join(gs, "query_id")
    stage = M.failure_stage(F.col("all_hit"), F.col("session_hits"), F.col("session_hits") == F.col("sessions"), F.col("recall") >= 0.5, F.col("turns") >= 4)
    return m.select("query_id", stage.alias("stage"))


def ev_navigation(spark: SparkSession, folder: str) -> DataFrame:
    """How narrow a search is: found and gold turns against all turns of the memory."""
    q = table(spark, folder, "questions", "question_id", "memory_id").select(F.col("question_id").alias("query_id"), "memory_id")
    n = table(spark, folder, "turns", "memory_id").groupBy("memory_id").agg(F.count(F.lit(1)).alias("all_turns"))
    m = ev_set(spark, folder).join(q, "query_id").join(n, "memory_id")
    return m.select("query_id", F.round(M.ratio(F.col("turns"), F.col("all_turns")), 6).alias("selectivity"), F.round(M.ratio(F.col("all_turns"), F.col("turns")), 6).alias("compression"))


def ev_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """Ten questions per type, by seed."""
    q = table(spark, folder, "questions", "question_id", "question_type")
    w = Window.partitionBy("question_type").orderBy(M.seeded_rank(F.col("question_id"), "17"))
    return q.withColumn("k", F.row_number().over(w)).where("k <= 10").select("question_id", "question_type")


def ev_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """Memories into train, validation and test, 6 to 2 to 2, by seed."""
    m = table(spark, folder, "questions", "memory_id").distinct()
    share = F.conv(F.substring(M.seeded_rank(F.col("memory_id"), "23"), 1, 8), 16, 10).cast("bigint") / 4294967296.0
    return m.select("memory_id", F.when(share < 0.6, "train").when(share < 0.8, "validation").otherwise("test").alias("split"))


def ev_paired(spark: SparkSession, folder: str) -> DataFrame:
    """Gains and losses of the last predictions against the first, judged by the gold answer."""
    return judged(table(spark, folder, "questions", "question_id", "question_type", "gold_answer"), table(spark, folder, "answers", "question_id", "answer_no", "prediction"))


def _words(text: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " ")), F.lit(" "))


def judged(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(question_type, gains, losses) of the last predictions against the first: a verdict is that the gold answer stands in the text, word by word.

    An unchanged prediction keeps its verdict; a null one is wrong. A gold answer without a word is looked for as it is.
    """
    q = questions.where("gold_answer is not null").select("question_id", "question_type", "gold_answer")
    text = F.struct("prediction")
    p = answers.groupBy("question_id").agg(F.min_by(text, "answer_no")["prediction"].alias("first"), F.max_by(text, "answer_no")["prediction"].alias("last"))
    gold = _words(F.col("gold_answer"))

    def right(text: Column) -> Column:
        return F.coalesce(F.when(F.trim(gold) == "", text.contains(F.col("gold_answer"))).otherwise(_words(text).contains(gold)), F.lit(False))

    v = q.join(p, "question_id").withColumn("base", right(F.col("first")))
    v = v.withColumn("candidate", F.when(F.col("first").eqNullSafe(F.col("last")), F.col("base")).otherwise(right(F.col("last"))))
    return v.groupBy("question_type").agg(F.count_if(~F.col("base") & F.col("candidate")).alias("gains"), F.count_if(F.col("base") & ~F.col("candidate")).alias("losses"))


def agg_mcnemar(spark: SparkSession, folder: str) -> DataFrame:
    """Exact p-value per question type; one row per type is read out in Arrow batches."""

    def test(batches):
        for b in batches:
            yield b.assign(p_value=[round(M.mcnemar(int(g), int(x)), 6) for g, x in zip(b["gains"], b["losses"])])

    pairs = judged(table(spark, folder, "questions", "question_id", "question_type", "gold_answer"), table(spark, folder, "answers", "question_id", "answer_no", "prediction"))
    return pairs.mapInPandas(test, "question_type string, gains bigint, losses bigint, p_value double")


QUERIES = {f.__name__: f for f in (
    dt_extract, dt_extract_all, dt_parse, dt_end, dt_observed, dt_normalize, dt_sort_key, dt_days_between, dt_overlaps, dt_scalars, dt_kernel, num_scalar, num_list, num_rate_pair, num_fact_cap,
    ev_set, ev_ranked, agg_metrics_macro, agg_metrics_micro, ev_aggregate, ev_failure_stage, ev_navigation, ev_calibration, ev_holdout, ev_paired, agg_mcnemar,
)}


def _r(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\\([^)]*\\)', ' ', 'g'), '(?i)(\\d)(st|nd|rd|th)\\b', '\\1', 'g'), '(?i)\\b(on|at)\\b', ' ', 'g'), ',', ' ', 'g'), '\\s+', ' ', 'g'))"
_PARSE = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(v, {_r('(?i)' + shape)}) THEN try_strptime(v, '{fmt}') END" for shape, _, fmt, _ in D.FORMS) + ")"
_PREC = "CASE " + " ".join(f"WHEN regexp_matches(v, {_r('(?i)' + shape)}) AND try_strptime(v, '{fmt}') IS NOT NULL THEN '{p}'" for shape, _, fmt, p in D.FORMS) + " END"
_REC = f"v AS (SELECT session_no, ingested_at, {_CLEAN.format('ts_raw')} AS v FROM sessions), r AS (SELECT session_no, ingested_at, CAST({_PARSE} AS TIMESTAMP) AS start, {_PREC} AS precision FROM v)"
_END = "CASE precision WHEN 'year' THEN start + INTERVAL 1 YEAR - INTERVAL 1 MICROSECOND WHEN 'month' THEN start + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND WHEN 'day' THEN start + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND WHEN 'minute' THEN start + INTERVAL 1 MINUTE - INTERVAL 1 MICROSECOND ELSE start END"
_PH = f"nullif(regexp_replace(regexp_extract(raw_text, {_r(D.PHRASE)}, 0), '\\s+', ' ', 'g'), '')"
_WD = "list_position(['" + "','".join(d.lower() for d in D.DAY.split("|")) + "'], {0}) - 1"
_GF = """lo AS (SELECT question_id AS query_id, arg_min(evidence_turn_ids, answer_no) AS g, arg_max(evidence_turn_ids, answer_no) AS f FROM answers GROUP BY ALL), tt AS (SELECT turn_id, min(turn_no) AS id FROM turns GROUP BY ALL),
 gold AS (SELECT DISTINCT query_id, id FROM (SELECT query_id, unnest(g) AS turn_id FROM lo) JOIN tt USING (turn_id)),
 found AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM (SELECT query_id, id, min(pos) AS pos FROM (SELECT query_id, unnest(f) AS turn_id, generate_subscripts(f, 1) AS pos FROM lo) JOIN tt USING (turn_id) GROUP BY ALL)),
 b AS (SELECT query_id, count(g.id) AS gold, count(f.id) AS turns, count(*) FILTER (g.id IS NOT NULL AND f.id IS NOT NULL) AS hits FROM gold g FULL JOIN found f USING (query_id, id) GROUP BY query_id),
 s AS (SELECT *, round(coalesce(hits / nullif(turns, 0), 0), 6) AS precision, round(coalesce(hits / nullif(gold, 0), 0), 6) AS recall, round(CASE WHEN hits = 0 THEN 0 ELSE 2 * (hits / turns) * (hits / gold) / (hits / turns + hits / gold) END, 6) AS f1, hits > 0 AS any_hit, hits = gold AS all_hit FROM b)"""
_STRATA = f"{_GF}, st AS (SELECT s.*, question_type AS stratum FROM s JOIN questions ON question_id = query_id)"
_MACRO = "m AS (SELECT stratum, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, count(*) AS n FROM st GROUP BY ALL), mm AS (SELECT * FROM m UNION ALL SELECT 'overall', avg(precision), avg(recall), avg(f1), count(*) FROM st UNION ALL SELECT 'equal_stratum', avg(precision), avg(recall), avg(f1), count(*) FROM m)"
_MICRO = "mi AS (SELECT stratum, sum(hits) AS h, sum(turns) AS t, sum(gold) AS g FROM st GROUP BY ALL), mk AS (SELECT stratum, round(coalesce(h / nullif(t, 0), 0), 6) AS precision, round(coalesce(h / nullif(g, 0), 0), 6) AS recall, round(CASE WHEN h = 0 THEN 0 ELSE 2 * (h / t) * (h / g) / (h / t + h / g) END, 6) AS f1 FROM mi)"

_BARE = "' ' || trim(regexp_replace(lower({0}), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g'), ' ') || ' '"
_RIGHT = f"coalesce(CASE WHEN trim(g, ' ') = '' THEN contains(@, gold_answer) ELSE contains({_BARE.replace('{0}', '@')}, g) END, false)"
_JUDGED = f"""an AS (SELECT question_id, arg_min({{'p': prediction}}, answer_no).p AS a, arg_max({{'p': prediction}}, answer_no).p AS z FROM answers GROUP BY ALL), gd AS (SELECT question_id, question_type, gold_answer, {_BARE.replace('{0}', 'gold_answer')} AS g FROM questions WHERE gold_answer IS NOT NULL),
 vd AS (SELECT question_type, {_RIGHT.replace('@', 'a')} AS base, CASE WHEN a IS NOT DISTINCT FROM z THEN {_RIGHT.replace('@', 'a')} ELSE {_RIGHT.replace('@', 'z')} END AS cand FROM gd JOIN an USING (question_id)), jd AS (SELECT question_type, count(*) FILTER (NOT base AND cand) AS gains, count(*) FILTER (base AND NOT cand) AS losses FROM vd GROUP BY ALL)"""

SQL = {
    "dt_extract": f"SELECT turn_no, {_PH} AS phrase FROM turns",
    "dt_extract_all": f"SELECT turn_no, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(raw_text, {_r(D.PHRASE)}), lambda p: regexp_replace(p, '\\s+', ' ', 'g')))), '|') AS phrases FROM turns",
    "dt_parse": f"WITH {_REC} SELECT session_no, start, precision FROM r",
    "dt_end": f"WITH {_REC} SELECT session_no, {_END} AS \"end\" FROM r WHERE start IS NOT NULL",
    "dt_observed": f"WITH {_REC} SELECT session_no, start, {_END} AS \"end\", 'observed' AS kind, 1.0::DOUBLE AS confidence FROM r WHERE start IS NOT NULL",
    "dt_normalize": f"""WITH t AS (SELECT turn_no, {_PH} AS phrase, CAST(ingested_at AS DATE) AS a FROM turns), u AS (SELECT *, lower(phrase) AS p, isodow(a) - 1 AS wd, {_WD.format('lower(phrase)')} AS bare, {_WD.format("regexp_extract(lower(phrase), '^last ([a-z]+)$', 1)")} AS la, {_WD.format("regexp_extract(lower(phrase), '^next ([a-z]+)$', 1)")} AS ne,
 CAST(date_trunc('month', a) AS DATE) AS mo, CAST(date_trunc('year', a) AS DATE) AS ye, regexp_matches(lower(phrase), {_r(D.AGO)}) AS ago, coalesce(TRY_CAST(nullif(regexp_extract(lower(phrase), '(\\d+)', 1), '') AS INT), 1) AS n, regexp_extract(lower(phrase), '(day|week|month|year)s?', 1) AS un, CASE WHEN regexp_matches(lower(phrase), 'just under|almost|nearly') THEN 1 ELSE 0 END AS sh FROM t WHERE phrase IS NOT NULL),
 v AS (SELECT *, regexp_matches(p, {_r(D.AGO)}) OR regexp_matches(p, {_r(D.LASTED)}) AS cnt, n <= CASE un WHEN 'day' THEN 36500 WHEN 'week' THEN 5200 WHEN 'month' THEN 1200 WHEN 'year' THEN 100 END AS small FROM u)
 SELECT turn_no, phrase, CAST(CASE WHEN p = 'today' THEN a WHEN p = 'yesterday' THEN a - 1 WHEN p = 'tomorrow' THEN a + 1 WHEN bare >= 0 THEN a + CAST((bare - wd + 7) % 7 AS INT) WHEN la >= 0 THEN a - CAST(CASE WHEN wd = la THEN 7 ELSE (wd - la + 7) % 7 END AS INT) WHEN ne >= 0 THEN a + CAST(CASE WHEN wd = ne THEN 7 ELSE (ne - wd + 7) % 7 END AS INT)
 WHEN p = 'last week' THEN a - CAST(wd AS INT) - 7 WHEN p = 'next week' THEN a - CAST(wd AS INT) + 7 WHEN p = 'last month' THEN mo - INTERVAL 1 MONTH WHEN p = 'next month' THEN mo + INTERVAL 1 MONTH WHEN p = 'last year' THEN ye - INTERVAL 1 YEAR WHEN p = 'next year' THEN ye + INTERVAL 1 YEAR
 WHEN cnt AND small THEN CASE un WHEN 'day' THEN a - n WHEN 'week' THEN a - 7 * n WHEN 'month' THEN mo - to_months(n) ELSE CASE WHEN ago THEN ye - to_years(n) ELSE mo - to_months(CAST(greatest(1, 12 * n - sh) AS INT)) END END END AS DATE) AS start,
 CASE WHEN p IN ('today', 'yesterday', 'tomorrow') OR bare >= 0 OR la >= 0 OR ne >= 0 THEN 'day' WHEN p IN ('last week', 'next week') THEN 'week' WHEN p IN ('last month', 'next month') THEN 'month' WHEN p IN ('last year', 'next year') THEN 'year' WHEN cnt AND small THEN CASE WHEN un = 'year' AND NOT ago THEN 'month' ELSE un END END AS precision FROM v""",
    "dt_sort_key": f"WITH {_REC}, e AS (SELECT *, {_END} AS en, coalesce(list_position(['second', 'minute', 'day', 'week', 'month', 'year'], precision) - 1, 6) AS pr FROM r) SELECT session_no, row_number() OVER (PARTITION BY session_no % 50 ORDER BY start IS NULL, start, en, pr, session_no) AS place FROM e",
    "dt_days_between": f"WITH {_REC} SELECT session_no, CAST(CAST(ingested_at AS DATE) - CAST(start AS DATE) AS INT) AS days FROM r",
    "dt_overlaps": f"WITH {_REC}, e AS (SELECT *, {_END} AS en, CAST(CAST(ingested_at AS DATE) - 1 AS TIMESTAMP) AS d FROM r WHERE start IS NOT NULL) SELECT session_no, start <= d + INTERVAL 1 DAY AND d <= en AS meets FROM e",
    "dt_scalars": "WITH v AS (SELECT question_id, replace(question_date, '/', '-') AS d, CAST(split_part(question_id, '_', 3) AS INT) % 3 AS k FROM questions) SELECT question_id, CAST(CAST(CASE k WHEN 0 THEN left(d, 4) || '-07-01' WHEN 1 THEN left(d, 7) || '-15' ELSE left(d, 10) END AS DATE) - DATE '1970-01-01' AS INT) AS days FROM v",
    "dt_kernel": f"WITH {FACTS}, g AS (SELECT owner_id, min(ts) FILTER (operand_id = 'o1') AS a, min(ts) FILTER (operand_id = 'o2') AS b FROM facts GROUP BY ALL) SELECT owner_id, round(exp(-abs(datediff('day', CAST(b AS DATE), CAST(a AS DATE))) / 90.0::DOUBLE), 6) AS kernel FROM g WHERE a IS NOT NULL AND b IS NOT NULL",
    "num_scalar": f"WITH {FACTS} SELECT binding_id, CAST(replace(value, '$', '') AS DOUBLE) AS number, CASE WHEN value LIKE '$%' THEN 'USD' ELSE '' END AS unit FROM facts",
    "num_rate_pair": "SELECT l_orderkey, l_linenumber, CAST(CAST(trunc(l_quantity) AS INT) AS VARCHAR) AS n, '$' || CAST(trunc(l_extendedprice / 100) AS INT) AS rate FROM lineitem",
    "num_fact_cap": "SELECT turn_no, CAST(least(32, greatest(4, ceil(0.6::DOUBLE * len(regexp_extract_all(raw_text, '[.!?]')) + 0.4::DOUBLE * len(regexp_extract_all(raw_text, '[0-9]+')) + 0.2::DOUBLE))) AS INT) AS cap FROM turns WHERE raw_text IS NOT NULL",
    "ev_set": f"WITH {_GF} SELECT * FROM s",
    "ev_ranked": f"""WITH {_GF}, n AS (SELECT query_id, count(*) AS gold FROM gold GROUP BY ALL), h AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM found JOIN gold USING (query_id, id)),
 p AS (SELECT query_id, min(rank) AS a, max(rank) AS z, count(*) AS hits, sum(nth / rank) AS ap, count(*) FILTER (rank <= gold) AS inr, count(*) FILTER (rank <= 8) AS inc, sum(CASE WHEN rank <= 8 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM h JOIN n USING (query_id) GROUP BY query_id)
 SELECT query_id, gold, round(coalesce(1 / a, 0), 6) AS reciprocal_rank, CAST(CASE WHEN hits = gold THEN z ELSE 0 END AS INT) AS last_gold_rank, round(coalesce(ap, 0) / gold, 6) AS average_precision, round(coalesce(inr, 0) / gold, 6) AS r_precision, round(coalesce(inc, 0) / gold, 6) AS recall,
 round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(gold, 8) + 1), lambda k: 1 / log2(k + 1))), 6) AS ndcg FROM n LEFT JOIN p USING (query_id)""",
    "agg_metrics_macro": f"WITH {_STRATA}, {_MACRO} SELECT stratum, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, n FROM mm",
    "agg_metrics_micro": f"WITH {_STRATA}, {_MICRO} SELECT * FROM mk",
    "ev_aggregate": f"WITH {_STRATA}, {_MACRO}, {_MICRO} SELECT stratum, round(mm.f1, 6) AS macro_f1, n, mk.f1 AS micro_f1 FROM mm LEFT JOIN mk USING (stratum)",
    "ev_failure_stage": f"""WITH {_GF}, gs AS (SELECT DISTINCT query_id, session_id FROM gold JOIN turns ON turn_no = id), fs AS (SELECT DISTINCT query_id, session_id, 1 AS hit FROM found JOIN turns ON turn_no = id), x AS (SELECT query_id, count(hit) AS sh, count(*) AS ns FROM gs LEFT JOIN fs USING (query_id, session_id) GROUP BY query_id)
 SELECT query_id, CASE WHEN all_hit THEN 'success' WHEN sh = 0 THEN 'seed_miss' WHEN sh <> ns THEN 'routing_miss' WHEN NOT recall >= 0.5 THEN 'within_session_candidate_miss' WHEN turns >= 4 THEN 'pack_drop_or_budget_exhausted' ELSE 'pack_drop' END AS stage FROM s JOIN x USING (query_id) WHERE gold > 0""",
    "ev_navigation": f"WITH {_GF}, n AS (SELECT memory_id, count(*) AS a FROM turns GROUP BY ALL) SELECT query_id, round(turns / a, 6) AS selectivity, round(coalesce(a / nullif(turns, 0), 0), 6) AS compression FROM s JOIN questions ON question_id = query_id JOIN n USING (memory_id)",
    "ev_calibration": "SELECT question_id, question_type FROM questions QUALIFY row_number() OVER (PARTITION BY question_type ORDER BY sha256('17:' || question_id)) <= 10",
    "ev_holdout": "WITH m AS (SELECT DISTINCT memory_id, CAST(('0x' || substr(sha256('23:' || memory_id), 1, 8)) AS UBIGINT) / 4294967296.0::DOUBLE AS x FROM questions) SELECT memory_id, CASE WHEN x < 0.6 THEN 'train' WHEN x < 0.8 THEN 'validation' ELSE 'test' END AS split FROM m",
    "ev_paired": f"WITH {_JUDGED} SELECT * FROM jd",
    "agg_mcnemar": f"WITH {_JUDGED}, x AS (SELECT *, gains + losses AS n, unnest(range(least(gains, losses) + 1)) AS i FROM jd) SELECT question_type, gains, losses, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0::DOUBLE)))), 6) END AS p_value FROM x GROUP BY question_type, gains, losses, n",
    "num_list": f"WITH a AS (SELECT answer_no, list_filter(list_transform(regexp_extract_all(prediction, {_r('(?i)(?:^|[^' + chr(92) + 'w])(' + N.NUMBER.split('])', 1)[1] + ')')}, 1), lambda n: trim(regexp_replace(n, '\\s+', ' ', 'g'), ' ')), lambda n: NOT regexp_matches(n, '^(19|20)[0-9][0-9]$')) AS l FROM answers) SELECT answer_no, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), '|') AS numbers FROM a",
}
