"""Queries of the operator algebra over the event facts, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators import algebra as A
from turnloom.sources.canonical import CLOSED, FACTS, closed_operands, facts

G = ["memory_id"]
P, V, C, E = (A.FactSet(o) for o in ("o1", "o2", "o3", "o5"))
_W = "array_to_string(list_sort(list(DISTINCT binding_id)), ',')"


def _members(node: object, group: list[str] = G):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        m = A.members(A.rows_of(node, facts(spark, folder), group), group)
        return m.select(*group, "member_key", "value", F.array_join(F.transform("witnesses", lambda x: x.cast("string")), ",").alias("witnesses"), F.array_join("operand_ids", ",").alias("operand_ids"))

    return query


def _members_sql(rows: str) -> str:
    return (
        f"WITH {FACTS}, r AS ({rows}) SELECT memory_id, member_key, arg_min(value, binding_id) AS value, {_W} AS witnesses, "
        "array_to_string(list_sort(list(DISTINCT operand_id)), ',') AS operand_ids FROM r GROUP BY memory_id, member_key"
    )


def _counts(node: object, group: list[str] = G):
    return lambda spark, folder: A.counts(node, facts(spark, folder), group)


def alg_sum(spark: SparkSession, folder: str) -> DataFrame:
    s = A.sums(A.Sum(A.UnionDistinct((P, C))), facts(spark, folder), ["owner_id"])
    return s.select("owner_id", F.round("numeric_total", 4).alias("numeric_total"), "unit", F.array_join("degradations", ",").alias("degradations"))


def alg_exists_all(spark: SparkSession, folder: str) -> DataFrame:
    rows, group = facts(spark, folder), ["memory_id"]
    return A.exists_all(A.ExistsAll((P, E)), rows.where("(operand_id = 'o1' and owner_id in ('u1', 'u2', 'u3')) or (operand_id = 'o5' and owner_id <> 'u4')"), rows, closed_operands(spark, folder), group)


def alg_date_difference(spark: SparkSession, folder: str) -> DataFrame:
    return A.date_difference(A.DateDifference(P, V), facts(spark, folder), ["owner_id"]).select("owner_id", "days_signed", "days_abs")


def alg_latest_state(spark: SparkSession, folder: str) -> DataFrame:
    return A.latest_state(A.LatestState(A.UnionDistinct((P, E))), facts(spark, folder), ["owner_id"])


def alg_group_by_owner(spark: SparkSession, folder: str) -> DataFrame:
    rows = A.rows_of(A.GroupByOwner(P), facts(spark, folder), G)
    return rows.groupBy("memory_id", "owner_id").agg(F.array_join(F.array_sort(F.collect_set("value_key")), ",").alias("group_values"))


def _picked(node: object):
    return lambda spark, folder: A.rows_of(node, facts(spark, folder), ["owner_id"]).select("owner_id", "binding_id", "value_key")


def alg_inspect(spark: SparkSession, folder: str) -> DataFrame:
    """Typed count with the reasons it may not be given out unchecked."""
    rows = facts(spark, folder)
    group = ["owner_id", "memory_id"]
    counted = A.counts(A.CountDistinct(P), rows, group).join(closed_operands(spark, folder).where("operand_id = 'o1'").select("memory_id", F.lit(True).alias("closed")), "memory_id", "left")
    reasons = F.array_compact(F.array(F.when(F.col("count") == 1, "single_member_closed_world_unproven"), F.when(F.col("closed").isNull(), "scope_incomplete")))
    return counted.select("owner_id", F.col("count").alias("typed_value"), F.lit("items").alias("unit"), F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("safe"))


def alg_compose(spark: SparkSession, folder: str) -> DataFrame:
    """Closed-form text: certified counts only, lists always."""
    rows = facts(spark, folder)
    counted = alg_inspect(spark, folder).where("safe").select("owner_id", F.lit("count").alias("kind"), F.col("typed_value").cast("string").alias("text"))
    listed = A.members(A.rows_of(P, rows, ["owner_id"]), ["owner_id"]).groupBy("owner_id").agg(F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("text")).select("owner_id", F.lit("list").alias("kind"), "text")
    return counted.unionByName(listed)


def alg_certificate_pre(spark: SparkSession, folder: str) -> DataFrame:
    rows = facts(spark, folder)
    return A.certificate_pre(A.CountDistinct(A.IntersectionDistinct((P, E))), rows, rows, closed_operands(spark, folder), G)


def alg_certificate_post(spark: SparkSession, folder: str) -> DataFrame:
    """Bindings keep a whole evidence group only if every turn of one of its groups is packed; packed are turns under index 2."""
    rows = facts(spark, folder).where("operand_id = 'o1'")
    turn = rows.select("owner_id", "binding_id", F.col("session_id").alias("group_id"), (F.col("turn_index") < 2).alias("packed"))
    whole = turn.groupBy("owner_id", "group_id").agg(F.min("packed").alias("whole"))
    kept = turn.join(whole, ["owner_id", "group_id"]).groupBy("owner_id", "binding_id").agg(F.max("whole").alias("kept"))
    return kept.groupBy("owner_id").agg(F.count_if("kept").alias("covered"), F.count(F.lit(1)).alias("bindings"), F.min("kept").alias("complete"))


def alg_legacy_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct by operand and value: the first binding of each stands."""
    rows = facts(spark, folder)
    return rows.groupBy("memory_id", "operand_id", "value_key").agg(F.min("binding_id").alias("binding_id"))


def set_except(spark: SparkSession, folder: str) -> DataFrame:
    """Values an owner bought but never viewed."""
    rows = facts(spark, folder)
    bought, viewed = (rows.where(F.col("operand_id") == o).select("owner_id", "value_key") for o in ("o1", "o2"))
    return bought.subtract(viewed)


_UNION = "SELECT *, value_key AS member_key FROM facts WHERE operand_id IN ('o1', 'o2')"
_INTERSECT = """SELECT *, owner_id || ':' || value_key AS member_key FROM facts WHERE operand_id IN ('o1', 'o2') AND (memory_id, owner_id || ':' || value_key) IN
 (SELECT memory_id, owner_id || ':' || value_key FROM facts WHERE operand_id = 'o1' INTERSECT SELECT memory_id, owner_id || ':' || value_key FROM facts WHERE operand_id = 'o2')"""
_RANKED = "SELECT owner_id, binding_id, value_key, row_number() OVER (PARTITION BY owner_id ORDER BY ts {0}, session_id {0}, turn_index {0}, binding_id {0}) AS rk FROM facts WHERE operand_id = 'o1' AND ts IS NOT NULL"


def _ranked_sql(order: str, k: int) -> str:
    return f"WITH {FACTS}, r AS ({_RANKED.format(order)}) SELECT owner_id, binding_id, value_key FROM r WHERE rk = {k}"


_BOTH = A.IntersectionDistinct((P, V), by="owner_value")

QUERIES = {
    "alg_factset": _members(P),
    "alg_lookup": _members(A.Lookup(V)),
    "alg_union_distinct": _members(A.UnionDistinct((P, V))),
    "alg_intersection_distinct": _members(_BOTH),
    "alg_group_by_owner": alg_group_by_owner,
    "alg_count_distinct": _counts(A.CountDistinct(P, by="event_instance")),
    "alg_sum": alg_sum,
    "alg_exists_all": alg_exists_all,
    "alg_ordinal": _picked(A.Ordinal(P, 2)),
    "alg_ordinal_last": _picked(A.Ordinal(P, -1, "descending")),
    "alg_argmin_time": _picked(A.ArgMinTime(P)),
    "alg_argmax_time": _picked(A.ArgMaxTime(P)),
    "alg_date_difference": alg_date_difference,
    "alg_latest_state": alg_latest_state,
    "alg_legacy_dedup": alg_legacy_dedup,
    "alg_nested_count_intersection": _counts(A.CountDistinct(_BOTH, by="owner_value")),
    "alg_nested_count_union": _counts(A.CountDistinct(A.UnionDistinct((P, V)), by="owner_value")),
    "alg_inspect": alg_inspect,
    "alg_compose": alg_compose,
    "alg_certificate_pre": alg_certificate_pre,
    "alg_certificate_post": alg_certificate_post,
    "set_except": set_except,
}

_STATE = """r AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY ts DESC NULLS LAST, session_id DESC, turn_index DESC, binding_id DESC) AS rk FROM facts WHERE operand_id IN ('o1', 'o5')),
 h AS (SELECT owner_id, value_key AS v, ts AS t, binding_id AS b FROM r WHERE rk = 1)"""
_COUNTED = f"""{FACTS}, {CLOSED}, n AS (SELECT owner_id, memory_id, count(DISTINCT value_key) AS c FROM facts WHERE operand_id = 'o1' GROUP BY ALL),
 i AS (SELECT owner_id, c AS typed_value, 'items' AS unit, concat_ws(',', CASE WHEN c = 1 THEN 'single_member_closed_world_unproven' END, CASE WHEN k.memory_id IS NULL THEN 'scope_incomplete' END) AS reasons
 FROM n LEFT JOIN (SELECT memory_id FROM closed WHERE operand_id = 'o1') k USING (memory_id))"""

SQL = {
    "alg_factset": _members_sql("SELECT *, value_key AS member_key FROM facts WHERE operand_id = 'o1'"),
    "alg_lookup": _members_sql("SELECT *, value_key AS member_key FROM facts WHERE operand_id = 'o2'"),
    "alg_union_distinct": _members_sql(_UNION),
    "alg_intersection_distinct": _members_sql(_INTERSECT),
    "alg_group_by_owner": f"WITH {FACTS} SELECT memory_id, owner_id, array_to_string(list_sort(list(DISTINCT value_key)), ',') AS group_values FROM facts WHERE operand_id = 'o1' GROUP BY ALL",
    "alg_count_distinct": f"WITH {FACTS} SELECT memory_id, count(DISTINCT coalesce(event_instance_id, value_key)) AS count FROM facts WHERE operand_id = 'o1' GROUP BY memory_id",
    "alg_sum": f"WITH {FACTS} SELECT owner_id, round(sum(CAST(replace(value, '$', '') AS DOUBLE)), 4) AS numeric_total, CASE WHEN count(*) FILTER (operand_id = 'o1') > 0 THEN 'USD' ELSE '' END AS unit, '' AS degradations FROM facts WHERE operand_id IN ('o1', 'o3') GROUP BY owner_id",
    "alg_exists_all": f"""WITH {FACTS}, {CLOSED}, m AS (SELECT DISTINCT memory_id FROM facts),
 p AS (SELECT DISTINCT memory_id FROM facts WHERE operand_id = 'o1' AND owner_id IN ('u1', 'u2', 'u3')), x AS (SELECT DISTINCT memory_id FROM facts WHERE operand_id = 'o5' AND owner_id <> 'u4')
 SELECT memory_id, CASE WHEN memory_id IN (SELECT memory_id FROM p) THEN true WHEN memory_id IN (SELECT memory_id FROM closed WHERE operand_id = 'o1') THEN false END
 AND CASE WHEN memory_id IN (SELECT memory_id FROM x) THEN true WHEN memory_id IN (SELECT memory_id FROM closed WHERE operand_id = 'o5') THEN false END AS truth FROM m""",
    "alg_ordinal": _ranked_sql("ASC", 2),
    "alg_ordinal_last": _ranked_sql("DESC", 1),
    "alg_argmin_time": _ranked_sql("ASC", 1),
    "alg_argmax_time": _ranked_sql("DESC", 1),
    "alg_date_difference": f"""WITH {FACTS}, l AS (SELECT owner_id, min(ts) AS a FROM facts WHERE operand_id = 'o1' GROUP BY owner_id), r AS (SELECT owner_id, max(ts) AS b FROM facts WHERE operand_id = 'o2' GROUP BY owner_id)
 SELECT owner_id, CAST(datediff('day', CAST(a AS DATE), CAST(b AS DATE)) AS INT) AS days_signed, CAST(abs(datediff('day', CAST(a AS DATE), CAST(b AS DATE))) AS INT) AS days_abs FROM l JOIN r USING (owner_id)""",
    "alg_latest_state": f"""WITH {FACTS}, {_STATE} SELECT owner_id, any_value(v) AS current_value, any_value(b) AS current_binding_id, count(*) - 1 AS priors,
 CASE WHEN bool_or(value_key <> v AND ts IS NOT DISTINCT FROM t) THEN 'conflicting_latest' WHEN bool_or(value_key <> v) THEN 'superseded_history' ELSE 'none' END AS contradiction,
 CASE WHEN any_value(t) IS NULL THEN 'unresolved' ELSE 'exact' END AS uncertainty FROM r JOIN h USING (owner_id) GROUP BY owner_id""",
    "alg_legacy_dedup": f"WITH {FACTS} SELECT memory_id, operand_id, value_key, min(binding_id) AS binding_id FROM facts GROUP BY ALL",
    "alg_nested_count_intersection": f"WITH {FACTS}, r AS ({_INTERSECT}) SELECT memory_id, count(DISTINCT member_key) AS count FROM r GROUP BY memory_id",
    "alg_nested_count_union": f"WITH {FACTS} SELECT memory_id, count(DISTINCT owner_id || ':' || value_key) AS count FROM facts WHERE operand_id IN ('o1', 'o2') GROUP BY memory_id",
    "alg_inspect": f"WITH {_COUNTED} SELECT *, reasons = '' AS safe FROM i",
    "alg_compose": f"WITH {_COUNTED} SELECT owner_id, 'count' AS kind, CAST(typed_value AS VARCHAR) AS text FROM i WHERE reasons = '' UNION ALL SELECT owner_id, 'list', array_to_string(list_sort(list(DISTINCT v)), ', ') FROM (SELECT owner_id, value_key, arg_min(value, binding_id) AS v FROM facts WHERE operand_id = 'o1' GROUP BY ALL) GROUP BY owner_id",
    "alg_certificate_pre": f"""WITH {FACTS}, {CLOSED}, d AS (SELECT * FROM (SELECT DISTINCT memory_id FROM facts), (SELECT unnest(['binding', 'provenance', 'collection']) AS kind), (SELECT unnest(['o1', 'o5']) AS operand_id)),
 t AS (SELECT memory_id, CASE WHEN kind = 'collection' THEN (memory_id, operand_id) IN (SELECT memory_id, operand_id FROM closed) ELSE (memory_id, operand_id) IN (SELECT memory_id, operand_id FROM facts) END AS met FROM d)
 SELECT memory_id, count(*) FILTER (met) AS covered, count(*) AS obligations, bool_and(met) AS complete FROM t GROUP BY memory_id""",
    "alg_certificate_post": f"""WITH {FACTS}, w AS (SELECT owner_id, session_id, bool_and(turn_index < 2) AS whole FROM facts WHERE operand_id = 'o1' GROUP BY ALL)
 SELECT owner_id, count(*) FILTER (whole) AS covered, count(*) AS bindings, bool_and(whole) AS complete FROM (SELECT DISTINCT owner_id, binding_id, session_id FROM facts WHERE operand_id = 'o1') JOIN w USING (owner_id, session_id) GROUP BY owner_id""",
    "set_except": f"WITH {FACTS} SELECT owner_id, value_key FROM facts WHERE operand_id = 'o1' EXCEPT SELECT owner_id, value_key FROM facts WHERE operand_id = 'o2'",
}
