"""Queries of the text functions over turns and questions, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.sources.tables import table


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _per(name: str, key: str, column: str, /, **columns: Callable[[Column], Column]):
    """Query of functions of one text column, by the row's key."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return table(spark, folder, name, key, column).select(key, *(f(F.col(column)).alias(c) for c, f in columns.items()))

    return query


def joined(f: Callable[[Column], Column], sep: str = "|") -> Callable[[Column], Column]:
    return lambda x: F.array_join(f(x), sep)


#: SQL of the terms of ``x``.
def sql_terms(x: str) -> str:
    return f"list_transform(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_''-]+'), lambda t: regexp_replace(t, '''s$', ''))"


def sql_content(x: str) -> str:
    return f"list_filter({sql_terms(x)}, lambda t: length(t) > 1 AND NOT list_contains({_list(T.STOPWORDS)}, t))"


def _ordered_distinct(x: str) -> str:
    return f"(SELECT string_agg(w, '|' ORDER BY p) FROM (SELECT w, min(p) AS p FROM (SELECT unnest({x}) AS w, generate_subscripts({x}, 1) AS p) GROUP BY w))"


def str_predicate_family(spark: SparkSession, folder: str) -> DataFrame:
    """Family and head stem of every distinct English word of the turns."""
    w = table(spark, folder, "turns", "raw_text").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("raw_text"), F.lit("[a-z]+"), F.lit(0)))).alias("word")).distinct()
    return w.select("word", T.predicate_family(F.col("word")).alias("family"), T.head_stem(F.col("word")).alias("head"))


def str_head_stem(spark: SparkSession, folder: str) -> DataFrame:
    """How many distinct words of the turns fold to each head stem."""
    return str_predicate_family(spark, folder).groupBy("head").agg(F.count(F.lit(1)).alias("words"), F.min("word").alias("first_word"))


_UN = "CASE WHEN length({0}) > 3 AND {0}[-1:] = {0}[-2:-2] AND NOT {0}[-1:] IN ('l', 's', 'z') THEN {0}[:-2] ELSE {0} END"
_IRREGULAR = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.IRREGULAR.items()) + " END"
_WORDS = "w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(raw_text), '[a-z]+')) AS w FROM turns)"
_FAMILY = f"""WITH {_WORDS}, r AS (SELECT w, length(w) AS n, left(w, length(w) - 3) AS i, left(w, length(w) - 2) AS e, {_IRREGULAR} AS irr FROM w),
 u AS (SELECT *, {_UN.format('i')} AS iu, {_UN.format('e')} AS eu FROM r)
SELECT w AS word, CASE WHEN list_contains({_list(T.FUNCTION_WORDS)}, w) THEN '' WHEN irr IS NOT NULL THEN irr WHEN n <= 3 THEN w WHEN w LIKE '%ies' AND n > 4 THEN i || 'y'
 WHEN w LIKE '%ing' AND n > 5 THEN CASE WHEN regexp_matches(iu, '(at|bl|iz)$') THEN iu || 'e' ELSE iu END WHEN w LIKE '%ied' AND n > 4 THEN i || 'y'
 WHEN w LIKE '%ed' AND n > 4 THEN CASE WHEN regexp_matches(w, '(amed|ared|ated|aved|eived|ired|ized|oved|ured|used)$') THEN left(w, n - 1) ELSE eu END
 WHEN regexp_matches(w, '(ches|shes|sses|xes|zes)$') AND n > 5 THEN left(w, n - 2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND n > 4 THEN left(w, n - 1) ELSE w END AS family,
 CASE WHEN list_contains({_list(T.CHAIN_STOPWORDS)}, w) THEN w WHEN w LIKE '%ies' AND n >= 6 THEN i || 'y' WHEN w LIKE '%ing' AND n >= 6 THEN left(w, n - 3) WHEN w LIKE '%ed' AND n >= 5 THEN left(w, n - 2)
 WHEN w LIKE '%es' AND n >= 5 THEN left(w, n - 2) WHEN w LIKE '%s' AND n >= 4 THEN left(w, n - 1) ELSE w END AS head FROM u"""


def str_fold_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Likeness of each question to its gold answer."""
    q = table(spark, folder, "questions", "question_id", "question", "gold_answer").where("gold_answer is not null")
    a, b = T.content_terms(F.col("question")), T.content_terms(F.col("gold_answer"))
    return q.select("question_id", F.round(T.jaccard(a, b), 6).alias("jaccard"), F.round(T.overlap_coefficient(a, b), 6).alias("overlap"), T.contained(a, b).alias("contained"))


def str_slots(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "questions", "question_id", "question")
    return q.select("question_id", *(c.alias(k) for k, c in T.slots(F.col("question")).items()))


STOP_NAMES = ["the", "what", "when", "where", "which", "who", "how", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "christmas"]

QUERIES = {
    "str_terms": _per("turns", "turn_no", "raw_text", terms=joined(T.terms)),
    "str_content_terms": _per("turns", "turn_no", "raw_text", content=joined(lambda x: F.array_sort(T.content_terms(x)))),
    "str_normalize_key": _per("questions", "question_id", "question", key=T.normalize_key),
    "str_estimate_tokens": _per("turns", "turn_no", "raw_text", tokens=T.estimate_tokens),
    "str_predicate_family": str_predicate_family,
    "str_head_stem": str_head_stem,
    "str_merge_surface": _per("questions", "question_id", "gold_answer", surface=T.merge_surface),
    "str_normalize_agg": _per("questions", "question_id", "question", agg_terms=joined(T.normalize_aggregation)),
    "str_sentences": _per("turns", "turn_no", "raw_text", n_sentences=lambda x: F.size(T.sentences(x)).cast("bigint"), sentences=joined(T.sentences)),
    "str_summary": _per("turns", "turn_no", "raw_text", summary=lambda x: T.summary(x, 8)),
    "str_names": _per("turns", "turn_no", "raw_text", names=joined(lambda x: T.names(x, STOP_NAMES))),
    "str_fold_overlap": str_fold_overlap,
    "str_slots": str_slots,
    "str_agg_intent": _per("questions", "question_id", "question", intent=T.aggregation_intent),
    "str_question_kind": _per("questions", "question_id", "question", kind=T.question_kind),
    "str_surface_status": _per("turns", "turn_no", "raw_text", status=T.surface_status),
    "str_modality": _per("turns", "turn_no", "raw_text", modality=T.modality),
    "qc_advice": _per("turns", "turn_no", "raw_text", advice=T.is_advice),
}


def _rx(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _m(x: str, p: str) -> str:
    return f"regexp_matches({x}, {_rx(p)})"


_INTENT_CASES = " ".join(f"WHEN {' AND '.join(_m('l', p) for p in ps)} THEN '{k}'" for k, ps in T.INTENTS)
_KIND_CASES = " ".join("WHEN " + " OR ".join(f"contains(l, '{p}')" for p in ps) + f" THEN '{k}'" for k, ps in T.KINDS)
_AGG = "list_transform(list_filter(regexp_extract_all(lower(question), '[a-z0-9]+(?:''[a-z0-9]+)?'), lambda t: length(t) > 2 AND NOT list_contains({stop}, t) AND NOT regexp_matches(t, '^[0-9]+$')), lambda t: CASE WHEN length(t) > 5 AND t LIKE '%ies' THEN left(t, length(t) - 3) || 'y' WHEN length(t) > 4 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END)".replace("{stop}", _list(T.AGGREGATION_STOPWORDS))
_FAMILIES = " || ".join(f"CASE WHEN list_has_any(f, {_list(x)}) THEN {_list(x)} ELSE [] END" for x in T.ALIAS_FAMILIES)


def _any(words: list[str]) -> str:
    return f"list_has_any(t, {_list(words)})"


def _classes(classes: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {_any(w)} THEN '{k}'" for k, w in classes.items()) + " ELSE '' END"


_S = T.SLOT_WORDS


def _advice(x: str) -> str:
    return _m(f"regexp_replace(trim(lower({x})), '\\s+', ' ', 'g')", T.ADVICE)


_SLOTS = f"""WITH b AS (SELECT question_id, question, lower(question) AS low, trim(regexp_replace(regexp_replace(lower(question), {_rx(T.INDIRECT)}, ''), {_rx(T.POLITE)}, '')) AS bare0 FROM questions),
 c AS (SELECT *, CASE WHEN bare0 = '' THEN low ELSE bare0 END AS bare FROM b), d AS (SELECT *, {sql_terms('bare')} AS t FROM c),
 e AS (SELECT *, coalesce(t[1], '') AS lead, {_any(['how'])} AND {_any(['much'])} AS hm, {_classes(T.TEMPORAL_WORDS)} AS temporal_relation, {_any(['how'])} AND {_any(_S['duration'])} AS lng,
  CASE {" ".join(f"WHEN {_any([w])} THEN {k}" for w, k in T.ORDINALS.items())} WHEN contains(bare, 'most recent') THEN -1 ELSE TRY_CAST(nullif(regexp_extract(low, '\\b(\\d{{1,6}})(st|nd|rd|th)\\b', 1), '') AS INT) END AS ordinal_index FROM d),
 f AS (SELECT *, hm AND {_any(['each', 'per'])} AND {_any(_S['spending'])} AS is_unit_rate FROM e),
 g AS (SELECT *, NOT is_unit_rate AND (({_any(['sum', 'total', 'altogether', 'combined'])} AND {_any(['amount', 'amounts', 'spent', 'spend', 'paid', 'pay', 'cost', 'costs', 'sum', 'total'])}) OR (hm AND {_any(['spent', 'spend', 'paid', 'pay', 'altogether', 'total'])})) AS is_sum FROM f),
 h AS (SELECT *, (({_any(['how'])} AND {_any(_S['count_heads'])}) OR lead = 'count') AND NOT lng AND NOT is_sum AND NOT is_unit_rate AS cnt FROM g),
 i AS (SELECT *, cnt AND {_any(_S['units'])} AND (temporal_relation <> '' OR {_any(['passed', 'lapsed', 'elapsed'])}) AS timed FROM h)
SELECT question_id, cnt AND NOT timed AS is_count, is_sum, is_unit_rate, lng OR timed AS is_duration,
 list_contains({_list(_S['exist_leads'])}, lead) AND NOT cnt AND NOT is_sum AND NOT lng AND NOT {_advice('question')} AS is_existence, {_any(_S['latest'])} AND ordinal_index IS NULL AS is_latest,
 (list_contains({_list(_S['list_heads'])}, lead) OR {_any(['list'])}) AND NOT (cnt AND NOT timed) AND NOT is_sum AND NOT (lng OR timed) AS is_list, {_advice('question')} AS is_advice, {_any(_S['negation'])} AS negation,
 ordinal_index, CASE {" ".join(f"WHEN {_any([q])} THEN '{q}'" for q in T.QUANTIFIERS)} ELSE '' END AS quantifier, temporal_relation, {_classes(T.ANSWER_WORDS)} AS answer_slot,
 CASE WHEN {_any(_S['event_distinct'])} THEN 'event_instance' ELSE 'value' END AS distinct_by FROM i"""

_SENT = "list_filter(list_transform(regexp_extract_all(raw_text, '[^.!?\\n]+[.!?]*'), lambda s: regexp_replace(s, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda s: s <> '')"
_FOLD = "regexp_replace(regexp_replace(w, '''s$', ''), 's''$', '')"

SQL = {
    "str_terms": f"SELECT turn_no, array_to_string({sql_terms('raw_text')}, '|') AS terms FROM turns",
    "str_content_terms": f"SELECT turn_no, array_to_string(list_sort(list_distinct({sql_content('raw_text')})), '|') AS content FROM turns",
    "str_normalize_key": f"SELECT question_id, array_to_string({sql_terms('question')}, ' ') AS key FROM questions",
    "str_estimate_tokens": f"SELECT turn_no, CAST(greatest(1, ceil(len({sql_terms('raw_text')}) * 1.3::DOUBLE)) AS INT) AS tokens FROM turns",
    "str_predicate_family": _FAMILY,
    "str_head_stem": f"SELECT head, count(*) AS words, min(word) AS first_word FROM ({_FAMILY}) GROUP BY head",
    "str_merge_surface": f"""WITH a AS (SELECT question_id, regexp_extract_all(lower(gold_answer), '[\\p{{L}}\\p{{N}}_''-]+') AS w FROM questions), b AS (SELECT question_id, CASE WHEN list_contains({_list(T.ARTICLES)}, w[1]) THEN w[2:] ELSE w END AS w FROM a)
 SELECT question_id, array_to_string(list_filter(list_transform(list_transform(w, lambda w: {_FOLD}), lambda v: CASE WHEN length(v) > 4 AND v LIKE '%s' AND NOT regexp_matches(v, '(ss|us|is)$') THEN left(v, length(v) - 1) ELSE v END), lambda v: v <> ''), ' ') AS surface FROM b""",
    "str_normalize_agg": f"WITH a AS (SELECT question_id, {_AGG} AS f FROM questions) SELECT question_id, array_to_string(list_sort(list_distinct(f || {_FAMILIES})), '|') AS agg_terms FROM a",
    "str_sentences": f"SELECT turn_no, len({_SENT}) AS n_sentences, array_to_string({_SENT}, '|') AS sentences FROM turns",
    "str_summary": "SELECT turn_no, array_to_string(list_filter(regexp_split_to_array(raw_text, '\\s+'), lambda w: w <> '')[:8], ' ') AS summary FROM turns",
    "str_names": f"SELECT turn_no, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(raw_text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[A-Z][a-z]{{2,}}$')), lambda w: lower(w)), lambda w: NOT list_contains({_list(STOP_NAMES)}, w)))), '|') AS names FROM turns",
    "str_fold_overlap": f"""WITH a AS (SELECT question_id, list_distinct({sql_content('question')}) AS a, list_distinct({sql_content('gold_answer')}) AS b FROM questions WHERE gold_answer IS NOT NULL),
 c AS (SELECT question_id, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS i FROM a)
 SELECT question_id, round(CASE WHEN na + nb - i = 0 THEN 0 ELSE i / (na + nb - i) END, 6) AS jaccard, round(CASE WHEN least(na, nb) = 0 THEN 0 ELSE i / least(na, nb) END, 6) AS overlap, na > 0 AND nb > 0 AND (i = na OR i = nb) AS contained FROM c""",
    "str_slots": _SLOTS,
    "str_agg_intent": f"WITH a AS (SELECT question_id, regexp_replace(trim(lower(question)), '\\s+', ' ', 'g') AS l FROM questions) SELECT question_id, CASE {_INTENT_CASES} END AS intent FROM a",
    "str_question_kind": f"WITH a AS (SELECT question_id, lower(question) AS l FROM questions) SELECT question_id, CASE WHEN l LIKE 'count%' THEN 'count' {_KIND_CASES} ELSE 'fact' END AS kind FROM a",
    "str_surface_status": f"""WITH a AS (SELECT turn_no, lower(raw_text) AS l FROM turns) SELECT turn_no, CASE WHEN {_m('l', T.NEGATED_EVENT)} THEN 'negated_or_cancelled' WHEN {_m('l', T.DONE_EVENT)} AND {_m('l', T.PLANNED_EVENT)} THEN 'mixed_completed_and_planned'
 WHEN {_m('l', T.DONE_EVENT)} THEN 'completed_or_realized' WHEN {_m('l', T.PLANNED_EVENT)} THEN 'planned_or_hypothetical' ELSE 'direct_statement' END AS status FROM a""",
    "str_modality": f"WITH a AS (SELECT turn_no, lower(raw_text) AS l FROM turns) SELECT turn_no, CASE WHEN {_m('l', T.CURRENT)} THEN 'current' WHEN {_m('l', T.PLANNED)} THEN 'planned' ELSE 'asserted' END AS modality FROM a",
    "qc_advice": f"SELECT turn_no, {_advice('raw_text')} AS advice FROM turns",
}
