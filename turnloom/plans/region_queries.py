"""Queries of regions, events, units, typed edges and incremental cards, and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import temporal as D
from turnloom.functions import text as T
from turnloom.operators import regions as R
from turnloom.operators import search as S
from turnloom.plans import graph_queries as GQ
from turnloom.plans import search_queries as SQ
from turnloom.plans import time_queries as TQ
from turnloom.plans.compile_queries import _SAID, _said
from turnloom.plans.lineage import shared_dir
from turnloom.plans.text_queries import SQL as _TEXT_SQL
from turnloom.plans.text_queries import STOP_NAMES, sql_content
from turnloom.sources.canonical import ASKS, FACTS, asks, facts
from turnloom.sources.tables import table
from turnloom.sources.versions import StaleVersion, VersionedTable


def _text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "turns", "turn_no", "memory_id", "session_id", "speaker", "raw_text")


def str_span_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of two words around the numbers of a turn, joined where they meet."""
    t = _text(spark, folder).where("raw_text is not null")
    w = F.filter(F.transform(F.split("raw_text", " "), lambda x, i: F.struct(F.greatest(F.lit(0), i - 2).alias("start"), (i + 3).alias("end"), x.rlike("^[0-9]+$").alias("hit"))), lambda x: x["hit"])
    spans = F.transform(w, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    m = T.merged_spans(spans)
    return t.where(F.size(w) > 0).select("turn_no", F.size(m).cast("bigint").alias("spans"), F.aggregate(m, F.lit(0), lambda s, x: s + x["end"] - x["start"]).cast("bigint").alias("words"))


def str_sentence_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in pieces of 400 characters at most; the pieces join to the text."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(d, k, c) for d, t in zip(b["doc_id"], b["text"]) for k, c in enumerate(T.chunks(t, 400))], columns=["doc_id", "k", "chunk"])

    return table(spark, folder, "documents", "doc_id", "text").where("text is not null").mapInPandas(cut_up, "doc_id bigint, k int, chunk string")


def str_info_units(spark: SparkSession, folder: str) -> DataFrame:
    u = _text(spark, folder).where("raw_text is not null").select("turn_no", F.explode(T.info_units(F.col("raw_text"))).alias("u"))
    return u.groupBy("turn_no", "u.kind").agg(F.count(F.lit(1)).alias("n"))


def str_compact(spark: SparkSession, folder: str) -> DataFrame:
    """The best sentence of each query's best turn."""
    q = SQ.asked(spark, folder).select("query_id", T.content_terms(F.col("query")).alias("anchors"))
    hit = SQ.topk_bm25(spark, folder).where("rank = 1").join(_text(spark, folder).withColumnRenamed("turn_no", "id"), "id").join(q, "query_id")
    return hit.select("query_id", "id", T.compact(F.col("raw_text"), F.col("anchors"), 80).alias("excerpt"))


def gb_events(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences that report something done, and whether it is negated."""
    s = _said(spark, folder).where(F.lower("sentence").rlike(T.DONE_EVENT))
    return s.select("turn_no", F.col("pos").cast("bigint").alias("pos"), F.lower("sentence").rlike(T.NEGATED_EVENT).alias("negated"))


def gb_time_state(spark: SparkSession, folder: str) -> DataFrame:
    """Time anchors of each memory with how often they are said."""
    t = _text(spark, folder).select("memory_id", D.first_phrase(F.col("raw_text")).alias("phrase")).where("phrase is not null")
    return t.groupBy("memory_id", F.lower("phrase").alias("anchor")).agg(F.count(F.lit(1)).alias("n"))


def gb_evidence_ref(spark: SparkSession, folder: str) -> DataFrame:
    """The 18 most telling terms of each turn, by idf."""
    _, post, sizes = SQ._turns(spark, folder)
    idf = SQ._frequencies(spark, folder).join(sizes, "scope").select("scope", "term", F.round(S.idf(F.col("total"), F.col("df")), 6).alias("idf"))
    w = Window.partitionBy("id").orderBy(F.col("idf").desc(), "term")
    r = post.join(idf, ["scope", "term"]).withColumn("k", F.row_number().over(w)).where("k <= 18")
    return r.groupBy(F.col("id").alias("turn_no")).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("k") == 1, F.col("term"))).alias("first_term"))


def _owner_values(spark: SparkSession, folder: str) -> DataFrame:
    return facts(spark, folder).select(F.col("memory_id").alias("scope"), F.col("owner_id").alias("region"), F.col("value_key").alias("value"))


def gb_rel_features(spark: SparkSession, folder: str) -> DataFrame:
    """Values of each memory from its owners', 40 at most."""
    f = _owner_values(spark, folder)
    up = f.select(F.col("region").alias("child"), F.col("scope").alias("parent")).distinct()
    return R.lifted(f.select("region", "value"), up, 40).select("region", F.array_join("values", ",").alias("values"))


def gb_rel_witness(spark: SparkSession, folder: str) -> DataFrame:
    p = R.value_pairs(_owner_values(spark, folder), 6)
    return p.select("scope", "a", "b", "shared", F.array_join("witnesses", ",").alias("witnesses"))


def gb_view_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return R.quota(R.value_pairs(_owner_values(spark, folder), 6), 2).select("scope", "a", "b", "shared")


def gb_parent_gated(spark: SparkSession, folder: str) -> DataFrame:
    """Owners of different memories who share values, only where their memories share many."""
    f = facts(spark, folder).select("memory_id", "owner_id", "value_key").distinct()
    whole = f.select("memory_id", "value_key").distinct()
    n = whole.groupBy("memory_id").agg(F.count(F.lit(1)).alias("n"))
    pair = whole.withColumnRenamed("memory_id", "pa").join(whole.withColumnRenamed("memory_id", "pb"), "value_key").where("pa < pb").groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("s"))
    gate = pair.join(n.select(F.col("memory_id").alias("pa"), F.col("n").alias("na")), "pa").join(n.select(F.col("memory_id").alias("pb"), F.col("n").alias("nb")), "pb").where("s >= 0.9 * least(na, nb)")
    child = f.select(F.lit("all").alias("scope"), F.col("owner_id").alias("region"), F.concat("value_key", F.lit("")).alias("value"))
    pairs = R.value_pairs(child, 100).where("shared >= 20").select("a", "b", "shared")
    return R.gated_children(gate, pairs, f.select(F.col("owner_id").alias("child"), F.col("memory_id").alias("parent")).distinct())


def gb_typed(spark: SparkSession, folder: str) -> DataFrame:
    """One owner's facts of one predicate and value in different sessions, neighbours in time: coreferent."""
    f = facts(spark, folder)
    w = Window.partitionBy("owner_id", "predicate", "value_key").orderBy("session_id", "binding_id")
    p = f.select("binding_id", "session_id", F.lead("binding_id").over(w).alias("other_id"), F.lead("session_id").over(w).alias("other_session"))
    return p.where("other_id is not null and session_id <> other_session").select("binding_id", "other_id", F.lit("COREFERENCE").alias("relation"))


def gb_refine_gate(spark: SparkSession, folder: str) -> DataFrame:
    """What neighbours in an owner's time may be refined to; how far it is trusted grows with how near they are in time: 1 on one day, 0.02 less a day."""
    f = facts(spark, folder)
    w = Window.partitionBy("owner_id").orderBy("binding_id")
    nxt = {c: F.lead(c).over(w) for c in ("binding_id", "value_key", "polarity", "predicate", "ts")}
    p = f.select("binding_id", "value_key", "polarity", "predicate", "ts", *(c.alias(f"n_{k}") for k, c in nxt.items())).where("n_binding_id is not null")
    trust = F.coalesce(F.greatest(F.lit(0.0), 1.0 - 0.02 * F.abs(F.datediff("n_ts", "ts"))), F.lit(0.5))
    rel = R.refined_relation(F.lit(True), F.col("value_key") == F.col("n_value_key"), F.col("polarity") != F.col("n_polarity"), F.coalesce(F.col("ts") < F.col("n_ts"), F.lit(False)) & (F.col("predicate") == F.col("n_predicate")), F.round(trust, 6))
    return p.select("binding_id", rel.alias("relation"))


def gb_typed_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges by relation and owner: how many of each kind."""
    c = GQ.gb_facts_lean(spark, folder)
    return c.groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("sources"))


def gb_hierarchy_edges(spark: SparkSession, folder: str) -> DataFrame:
    _, tree = GQ._tree(spark, folder)
    return tree.select(F.concat("parent_id", F.lit(">"), "child_id").alias("edge_id"), F.lit("REFINES_TO").alias("relation"))


def gb_ambiguous(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring mentions of a name in different sessions, 24 at most from one mention's session and name."""
    n = _text(spark, folder).select("memory_id", "session_id", "turn_no", F.explode(T.names(F.col("raw_text"), STOP_NAMES)).alias("name"))
    w = Window.partitionBy("memory_id", "name").orderBy("turn_no")
    p = n.select("memory_id", "name", "turn_no", "session_id", F.lead("turn_no").over(w).alias("other_no"), F.lead("session_id").over(w).alias("other_session")).where("other_no is not null and session_id <> other_session")
    k = F.row_number().over(Window.partitionBy("memory_id", "name", "session_id").orderBy("turn_no"))
    return p.withColumn("k", k).where("k <= 24").select("memory_id", "name", "turn_no", "other_no")


def gb_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Families of the turns' words, checked: a family needs two members or more, 64 at most, and its name must not be a member of another family."""
    from turnloom.plans.text_queries import str_predicate_family

    f = str_predicate_family(spark, folder).where("family <> ''").select("family", "word").distinct()
    other = f.where("word <> family").select(F.col("word").alias("family"), F.lit(True).alias("elsewhere")).distinct()
    g = f.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.max(F.col("word") == F.col("family")).alias("named"))
    problem = F.when(F.col("members") < 2, "size_small").when(F.col("members") > 64, "size_large").when(F.coalesce("elsewhere", F.lit(False)), "collision")
    return g.join(other, "family", "left").select("family", "members", "named", problem.alias("problem"))


def rt_query_witness(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of named speakers that hold a query's rare terms (in 20 turns of the memory at most)."""
    _, post, _ = SQ._turns(spark, folder)
    rare = SQ._frequencies(spark, folder).where("df <= 20")
    hit = S.query_terms(SQ.asked(spark, folder)).join(rare, ["scope", "term"]).join(post.select("scope", "id", "term"), ["scope", "term"])
    named = _text(spark, folder).where("lower(speaker) not in ('user', 'assistant', 'system', 'tool')").select(F.col("turn_no").alias("id"))
    return hit.join(named, "id").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("witnesses"))


def rt_diag_probe(spark: SparkSession, folder: str) -> DataFrame:
    """What relations add to seeds: nodes visited within no hop and within one, and how far the gain over a hop of the same width falls when destinations are shuffled by hash."""
    one = GQ._expansion(spark, folder, 1)
    return one.groupBy("query_id").agg(F.count(F.lit(1)).alias("reached"), F.count_if(F.col("hops") == 0).alias("seeds"), F.round(F.sum(F.when(F.col("hops") > 0, F.col("priority")).otherwise(0.0)), 6).alias("gain"))


def st_recompile(spark: SparkSession, folder: str) -> DataFrame:
    """Order counts of the cards above changed customers (divisible by 20), bottom up; other cards are not touched."""
    _, tree = GQ._tree(spark, folder)
    hit = GQ.st_affected(spark, folder).select("node_id")
    o = table(spark, folder, "orders", "o_custkey").groupBy(F.concat(F.lit("c"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("child_id")).agg(F.count(F.lit(1)).alias("n"))
    nations = tree.join(o, "child_id").groupBy("parent_id").agg(F.sum("n").alias("n"))
    up = nations.withColumnRenamed("parent_id", "child_id").join(tree, "child_id").groupBy("parent_id").agg(F.sum("n").alias("n"))
    return nations.unionByName(up).withColumnRenamed("parent_id", "node_id").join(hit, "node_id", "left_semi").select("node_id", F.col("n").alias("orders"))


def st_insert_session(spark: SparkSession, folder: str) -> DataFrame:
    """The session nearest to each memory's last one."""
    s = table(spark, folder, "sessions", "memory_id", "session_id", "ordinal").groupBy("memory_id").agg(F.max(F.struct("ordinal", "session_id")).alias("x")).select("memory_id", "x.session_id")
    w = _text(spark, folder).select("memory_id", "session_id", F.explode(T.content_terms(F.col("raw_text"))).alias("term"))
    return R.nearest_session(w, s)


def st_publish(spark: SparkSession, folder: str) -> DataFrame:
    """A publication on top of a version that has moved on is refused."""
    v = VersionedTable(spark, f"{shared_dir(spark)}/publish-{uuid.uuid4().hex}")
    f = facts(spark, folder).select("memory_id", "binding_id")
    v.publish(f, expected=0)
    try:
        v.publish(f, expected=0)
        refused = False
    except StaleVersion:
        refused = True
    return v.read().groupBy("memory_id").agg(F.count(F.lit(1)).alias("n")).select("memory_id", "n", F.lit(refused).alias("refused"))


def flt_eligible_refine(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs whose gate is open to doubt: neither clearly in nor clearly out."""
    return GQ.gb_rel_gate(spark, folder).where("gate between 0.70 and 0.92")


def flt_edge_admissible(spark: SparkSession, folder: str) -> DataFrame:
    """Edges kept for what is asked of their memory: weak ones need the asked value among their witnesses."""
    p = R.value_pairs(_owner_values(spark, folder), 6)
    a = asks(spark, folder).select(F.col("memory_id").alias("scope"), "asked_value")
    return p.join(a, "scope").where((F.col("shared") >= 3) | F.coalesce(F.array_contains("witnesses", F.col("asked_value")), F.lit(False))).select("scope", "a", "b")


def topk_fact_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of each memory by how many of the asked value, predicate and collection they hold, ten best."""
    f = facts(spark, folder).join(asks(spark, folder), "memory_id")
    n = F.coalesce((F.col("value_key") == F.col("asked_value")).cast("int"), F.lit(0)) + (F.col("predicate") == F.col("asked_predicate")).cast("int") + F.coalesce((F.col("collection_key") == F.col("asked_collection")).cast("int"), F.lit(0))
    w = Window.partitionBy("memory_id").orderBy(F.col("hits").desc(), "binding_id")
    return f.select("memory_id", "binding_id", n.alias("hits")).where("hits > 0").withColumn("rank", F.row_number().over(w)).where("rank <= 10")


def sv_source_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes that put a date to the relative phrase of a turn."""
    n = TQ.dt_normalize(spark, folder).where("start is not null")
    return n.select("turn_no", F.concat(F.lit("[source-time] "), "phrase", F.lit(" = "), F.date_format("start", "yyyy-MM-dd")).alias("note"))


def sv_qcache(spark: SparkSession, folder: str) -> DataFrame:
    """The 500 query vectors of each model that were used last."""
    w = Window.partitionBy("model_id").orderBy(F.col("last_accessed").desc_nulls_last(), "cache_key")
    return table(spark, folder, "query_embeddings", "cache_key", "model_id", "last_accessed").withColumn("k", F.row_number().over(w)).where("k <= 500").select("model_id", "cache_key")


QUERIES = {f.__name__: f for f in (
    str_span_merge, str_sentence_chunks, str_info_units, str_compact, gb_events, gb_time_state, gb_evidence_ref, gb_rel_features, gb_rel_witness, gb_view_pairs, gb_parent_gated, gb_typed, gb_refine_gate, gb_typed_edges,
    gb_hierarchy_edges, gb_ambiguous, gb_vocabulary, rt_query_witness, rt_diag_probe, st_recompile, st_insert_session, st_publish, flt_eligible_refine, flt_edge_admissible, topk_fact_terms, sv_source_notes, sv_qcache,
)}

_VP = f"{FACTS}, d AS (SELECT DISTINCT memory_id AS scope, owner_id AS region, value_key AS value FROM facts), tl AS (SELECT scope, value FROM d GROUP BY ALL HAVING count(*) BETWEEN 2 AND 6), l AS (SELECT * FROM d JOIN tl USING (scope, value)), vp AS (SELECT scope, x.region AS a, y.region AS b, count(*) AS shared, list_sort(list(DISTINCT value)) AS wit FROM l x JOIN l y USING (scope, value) WHERE x.region < y.region GROUP BY ALL)"
_NAMES = f"SELECT turn_no, memory_id, session_id, name FROM (SELECT DISTINCT memory_id, session_id, turn_no, unnest(list_transform(list_filter(regexp_extract_all(raw_text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[A-Z][a-z]{{2,}}$')), lambda w: lower(w))) AS name FROM turns) WHERE name NOT IN ({', '.join(repr(s) for s in STOP_NAMES)})"


def _m(x: str, p: str) -> str:
    return f"regexp_matches({x}, '" + p.replace("'", "''") + "')"


def _unit_counts() -> str:
    rest, parts = "raw_text", []
    for kind, pattern in T.UNITS.items():
        parts.append(f"SELECT turn_no, '{kind}' AS kind, len(regexp_extract_all({rest}, '{pattern}')) AS n FROM turns WHERE raw_text IS NOT NULL")
        rest = f"regexp_replace({rest}, '{pattern}', ' ', 'g')"
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0"


SQL = {
    "str_span_merge": """WITH w AS (SELECT turn_no, unnest(string_split(raw_text, ' ')) AS x, generate_subscripts(string_split(raw_text, ' '), 1) - 1 AS i FROM turns), s AS (SELECT turn_no, greatest(0, i - 2) AS a, i + 3 AS b FROM w WHERE regexp_matches(x, '^[0-9]+$')),
 g AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY turn_no ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM s), h AS (SELECT *, sum(n) OVER (PARTITION BY turn_no ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM g), m AS (SELECT turn_no, k, min(a) AS a, max(b) AS b FROM h GROUP BY ALL)
 SELECT turn_no, count(*) AS spans, CAST(sum(b - a) AS BIGINT) AS words FROM m GROUP BY turn_no""",
    "str_info_units": _unit_counts(),
    "gb_events": f"WITH {_SAID} SELECT turn_no, pos, {_m('lower(sentence)', T.NEGATED_EVENT)} AS negated FROM said WHERE {_m('lower(sentence)', T.DONE_EVENT)}",
    "gb_time_state": f"WITH p AS (SELECT memory_id, {TQ._PH} AS phrase FROM turns) SELECT memory_id, lower(phrase) AS anchor, count(*) AS n FROM p WHERE phrase IS NOT NULL GROUP BY ALL",
    "gb_evidence_ref": f"WITH {SQ._BASE}, i AS (SELECT scope, term, round(ln(1 + (total - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM df JOIN sz USING (scope)), r AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY idf DESC, term) AS k FROM p JOIN i USING (scope, term) QUALIFY k <= 18) SELECT id AS turn_no, count(*) AS n, min(term) FILTER (k = 1) AS first_term FROM r GROUP BY id",
    "gb_rel_features": f"WITH {FACTS}, d AS (SELECT DISTINCT memory_id AS region, value_key AS v FROM facts), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY region ORDER BY v) <= 40) SELECT region, string_agg(v, ',' ORDER BY v) AS \"values\" FROM k GROUP BY region",
    "gb_rel_witness": f"WITH {_VP} SELECT scope, a, b, shared, array_to_string(wit, ',') AS witnesses FROM vp",
    "gb_view_pairs": f"WITH {_VP} SELECT scope, a, b, shared FROM vp QUALIFY row_number() OVER (PARTITION BY scope, a ORDER BY shared DESC, a, b) <= 2 OR row_number() OVER (PARTITION BY scope, b ORDER BY shared DESC, a, b) <= 2",
    "gb_parent_gated": f"""WITH {FACTS}, f AS (SELECT DISTINCT memory_id, owner_id, value_key FROM facts), w AS (SELECT DISTINCT memory_id, value_key FROM f), n AS (SELECT memory_id, count(*) AS n FROM w GROUP BY ALL), g AS (SELECT x.memory_id AS pa, y.memory_id AS pb, count(*) AS s FROM w x JOIN w y USING (value_key) WHERE x.memory_id < y.memory_id GROUP BY ALL),
 gt AS (SELECT pa, pb FROM g JOIN n na ON na.memory_id = pa JOIN n nb ON nb.memory_id = pb WHERE s >= 0.9 * least(na.n, nb.n)), ov AS (SELECT DISTINCT owner_id, value_key FROM f), tl AS (SELECT value_key FROM ov GROUP BY ALL HAVING count(*) BETWEEN 2 AND 100), o AS (SELECT * FROM ov JOIN tl USING (value_key)),
 pr AS (SELECT x.owner_id AS a, y.owner_id AS b, count(*) AS shared FROM o x JOIN o y USING (value_key) WHERE x.owner_id < y.owner_id GROUP BY ALL HAVING shared >= 20), m AS (SELECT DISTINCT owner_id, memory_id FROM f)
 SELECT a, b, shared FROM pr JOIN m ma ON ma.owner_id = a JOIN m mb ON mb.owner_id = b JOIN gt ON pa = least(ma.memory_id, mb.memory_id) AND pb = greatest(ma.memory_id, mb.memory_id)""",
    "gb_typed": f"WITH {FACTS}, p AS (SELECT binding_id, session_id, lead(binding_id) OVER w AS other_id, lead(session_id) OVER w AS os FROM facts WINDOW w AS (PARTITION BY owner_id, predicate, value_key ORDER BY session_id, binding_id)) SELECT binding_id, other_id, 'COREFERENCE' AS relation FROM p WHERE other_id IS NOT NULL AND session_id <> os",
    "gb_refine_gate": f"""WITH {FACTS}, p AS (SELECT *, lead(binding_id) OVER w AS nb, lead(value_key) OVER w AS nv, lead(polarity) OVER w AS np, lead(predicate) OVER w AS npr, lead(ts) OVER w AS nt FROM facts WINDOW w AS (PARTITION BY owner_id ORDER BY binding_id)), c AS (SELECT *, round(coalesce(greatest(0, 1.0::DOUBLE - 0.02::DOUBLE * abs(datediff('day', CAST(ts AS DATE), CAST(nt AS DATE)))), 0.5::DOUBLE), 6) >= 0.82 AS sure FROM p WHERE nb IS NOT NULL)
 SELECT binding_id, CASE WHEN value_key = nv AND sure THEN 'COREFERENCE' WHEN polarity <> np AND sure THEN 'CONTRADICTS' WHEN coalesce(ts < nt, false) AND predicate = npr AND NOT value_key = nv THEN 'UPDATES' END AS relation FROM c""",
    "gb_typed_edges": "SELECT relation, count(*) AS n, count(DISTINCT src) AS sources FROM (" + GQ.SQL["gb_facts_lean"] + ") GROUP BY relation",
    "gb_hierarchy_edges": f"WITH {GQ._TREE} SELECT p || '>' || c AS edge_id, 'REFINES_TO' AS relation FROM t",
    "gb_ambiguous": f"WITH n AS ({_NAMES}), p AS (SELECT *, lead(turn_no) OVER w AS other_no, lead(session_id) OVER w AS os FROM n WINDOW w AS (PARTITION BY memory_id, name ORDER BY turn_no)) SELECT memory_id, name, turn_no, other_no FROM p WHERE other_no IS NOT NULL AND session_id <> os QUALIFY row_number() OVER (PARTITION BY memory_id, name, session_id ORDER BY turn_no) <= 24",
    "rt_query_witness": f"WITH {SQ._BASE} SELECT query_id, id, count(*) AS witnesses FROM qt JOIN df USING (scope, term) JOIN p USING (scope, term) JOIN turns ON turn_no = id WHERE df <= 20 AND lower(speaker) NOT IN ('user', 'assistant', 'system', 'tool') GROUP BY ALL",
    "st_recompile": f"""WITH {GQ._TREE}, o AS (SELECT 'c' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS c, count(*) AS n FROM orders GROUP BY ALL), na AS (SELECT p AS node_id, sum(n) AS n FROM t JOIN o USING (c) GROUP BY ALL), re AS (SELECT t.p AS node_id, sum(n) AS n FROM na JOIN t ON t.c = na.node_id GROUP BY ALL),
 b AS (SELECT p FROM t WHERE c LIKE 'c%' AND CAST(substr(c, 2) AS INT) % 20 = 0), h AS (SELECT p FROM b UNION SELECT t.p FROM b JOIN t ON t.c = b.p) SELECT node_id, CAST(n AS BIGINT) AS orders FROM (SELECT * FROM na UNION ALL SELECT * FROM re) WHERE node_id IN (SELECT p FROM h)""",
    "st_insert_session": f"""WITH w AS (SELECT DISTINCT memory_id, session_id, unnest({sql_content('raw_text')}) AS term FROM turns), s AS (SELECT memory_id, max((ordinal, session_id))[2] AS session_id FROM sessions GROUP BY memory_id), n AS (SELECT memory_id, session_id, count(*) AS n FROM w GROUP BY ALL),
 j AS (SELECT a.memory_id, a.session_id, b.session_id AS nearest, count(*) AS s FROM w a JOIN s ON s.memory_id = a.memory_id AND s.session_id = a.session_id JOIN w b ON b.memory_id = a.memory_id AND b.term = a.term AND b.session_id <> a.session_id GROUP BY ALL)
 SELECT j.memory_id, j.session_id, nearest, round(s / (x.n + y.n - s), 6) AS score FROM j JOIN n x ON x.memory_id = j.memory_id AND x.session_id = j.session_id JOIN n y ON y.memory_id = j.memory_id AND y.session_id = nearest QUALIFY row_number() OVER (PARTITION BY j.memory_id, j.session_id ORDER BY score DESC, nearest) = 1""",
    "st_publish": f"WITH {FACTS} SELECT memory_id, count(*) AS n, true AS refused FROM facts GROUP BY memory_id",
    "flt_eligible_refine": "SELECT * FROM (" + GQ.SQL["gb_rel_gate"] + ") WHERE gate BETWEEN 0.70 AND 0.92",
    "flt_edge_admissible": f"WITH {_VP}, {ASKS} SELECT scope, a, b FROM vp JOIN asks ON memory_id = scope WHERE shared >= 3 OR coalesce(list_contains(wit, asked_value), false)",
    "topk_fact_terms": f"WITH {FACTS}, {ASKS}, h AS (SELECT memory_id, binding_id, coalesce((value_key = asked_value)::INT, 0) + (predicate = asked_predicate)::INT + coalesce((collection_key = asked_collection)::INT, 0) AS hits FROM facts JOIN asks USING (memory_id)) SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY hits DESC, binding_id) AS rank FROM h WHERE hits > 0 QUALIFY rank <= 10",
    "sv_source_notes": "SELECT turn_no, '[source-time] ' || phrase || ' = ' || strftime(start, '%Y-%m-%d') AS note FROM (" + TQ.SQL["dt_normalize"] + ") WHERE start IS NOT NULL",
    "sv_qcache": "SELECT model_id, cache_key FROM query_embeddings QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY last_accessed DESC NULLS LAST, cache_key) <= 500",
    "gb_vocabulary": "WITH f AS (SELECT DISTINCT family, word FROM (" + _TEXT_SQL["str_predicate_family"] + ") WHERE family <> ''), g AS (SELECT family, count(*) AS members, bool_or(word = family) AS named FROM f GROUP BY ALL) SELECT family, members, named, CASE WHEN members < 2 THEN 'size_small' WHEN members > 64 THEN 'size_large' WHEN family IN (SELECT word FROM f WHERE word <> family) THEN 'collision' END AS problem FROM g",
    "rt_diag_probe": f"WITH {GQ._EXPAND} SELECT query_id, count(*) AS reached, count(*) FILTER (hops = 0) AS seeds, round(sum(CASE WHEN hops > 0 THEN priority ELSE 0 END), 6) AS gain FROM ex WHERE hops <= 1 GROUP BY ALL",
    "str_sentence_chunks": """WITH RECURSIVE c AS (SELECT doc_id, -1 AS k, '' AS chunk, text AS rest FROM documents WHERE text IS NOT NULL
 UNION ALL SELECT doc_id, k + 1, left(rest, n), substr(rest, n + 1) FROM (SELECT doc_id, k, rest, CASE WHEN length(rest) <= 400 THEN length(rest) WHEN m > 0 THEN m WHEN b > 0 THEN b ELSE 400 END AS n FROM (SELECT doc_id, k, rest,
  greatest(CASE WHEN regexp_matches(h, '(?s)^.*[.!?] ') THEN length(regexp_extract(h, '(?s)^(.*)[.!?] ', 1)) + 1 ELSE 0 END, CASE WHEN contains(h, chr(10)) THEN length(regexp_extract(h, '(?s)^(.*)\\n', 1)) + 1 ELSE 0 END) AS m, CASE WHEN contains(h, ' ') THEN length(regexp_extract(h, '(?s)^(.*) ', 1)) + 1 ELSE 0 END AS b
  FROM (SELECT doc_id, k, rest, left(rest, 400) AS h FROM c WHERE rest <> ''))))
 SELECT doc_id, CAST(k AS INT) AS k, chunk FROM c WHERE k >= 0""",
    "str_compact": f"WITH hit AS (" + SQ.SQL["topk_bm25"] + f"), {_SAID}, an AS (SELECT query_id, id, list_distinct({sql_content('question')}) AS w FROM hit JOIN questions ON question_id = query_id WHERE rank = 1), b AS (SELECT query_id, id, sentence, row_number() OVER (PARTITION BY query_id, id ORDER BY len(list_intersect(list_distinct({sql_content('sentence')}), w)) DESC, pos) AS k FROM an JOIN said ON turn_no = id) SELECT an.query_id, an.id, left(sentence, 80) AS excerpt FROM an LEFT JOIN b ON b.query_id = an.query_id AND b.id = an.id AND k = 1",
}
