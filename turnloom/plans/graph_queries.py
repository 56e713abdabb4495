"""Queries of ingestion, storage, traversal, packing and building, and their SQL twins where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions.text import ARTICLES, content_terms, estimate_tokens, merge_surface, names, slots
from turnloom.operators import build as B
from turnloom.operators import compile as C
from turnloom.operators import facts as O
from turnloom.operators import graph as G
from turnloom.operators import packing as P
from turnloom.operators import storage as S
from turnloom.operators import symbolic as Y
from turnloom.plans import search_queries as SQ
from turnloom.plans.lineage import cut, ranked, shared_dir
from turnloom.plans.text_queries import _SLOTS, STOP_NAMES, sql_content, sql_terms
from turnloom.sources import ingest as I
from turnloom.sources.canonical import ASKS, FACTS, asks, facts
from turnloom.sources.tables import table
from turnloom.sources.versions import VersionedTable

LATE = "late AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY ingested_at DESC, turn_no DESC) = 1)"


#: SQL of the kind of answer of rows with the slots.
SQL_KIND = "CASE WHEN is_existence THEN 'existence' WHEN is_duration THEN 'date_difference' WHEN is_sum THEN 'sum' WHEN is_count THEN 'count' WHEN ordinal_index IS NOT NULL THEN 'ordinal' WHEN is_latest THEN 'state' WHEN temporal_relation IN ('before', 'after') THEN 'ordinal' ELSE 'list' END"


def answer_kind(s: dict[str, Column]) -> Column:
    """Kind of answer that a question's slots ask for, by precedence."""
    return (
        F.when(s["is_existence"], "existence").when(s["is_duration"], "date_difference").when(s["is_sum"], "sum").when(s["is_count"], "count")
        .when(s["ordinal_index"].isNotNull(), "ordinal").when(s["is_latest"], "state").when(s["temporal_relation"].isin("before", "after"), "ordinal").otherwise("list")
    )


def _late(spark: SparkSession, folder: str) -> DataFrame:
    return O.last_per_key(table(spark, folder, "turns"), ["turn_id"], ["ingested_at", "turn_no"])


# Sources


def _haystacks(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON row per session, its turns nested as benchmark files hold them."""
    t = _late(spark, folder)
    item = F.struct("turn_index", "turn_no", F.lower("role").alias("role"), "speaker", "listener", F.col("raw_text").alias("content"))
    s = t.groupBy("memory_id", "session_id").agg(F.array_sort(F.collect_list(item)).alias("turns"))
    return s.select(F.to_json(F.struct(F.col("memory_id").alias("question_id"), F.array("session_id").alias("haystack_session_ids"), F.array("turns").alias("haystack_sessions"))).alias("json"))


def src_json_lme(spark: SparkSession, folder: str) -> DataFrame:
    t = I.haystack_turns(_haystacks(spark, folder), "json")
    return t.select(F.col("question_id").alias("memory_id"), "session_id", "turn_index", "speaker", "role", "raw_text")


def src_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """The same turns with ids made from their place, as ingestion stores them."""
    t = I.haystack_turns(_haystacks(spark, folder), "json")
    key = F.sha2(F.concat_ws("|", F.lit("turn"), "question_id", "session_id", F.col("turn_index").cast("string")), 256).substr(1, 32)
    return t.select(F.concat(F.lit("turn:"), key).alias("turn_id"), F.col("question_id").alias("memory_id"), "ordinal", F.sha2("raw_text", 256).alias("content_hash"))


def src_locomo(spark: SparkSession, folder: str) -> DataFrame:
    t = _late(spark, folder).withColumn("memory_id", F.concat_ws("/", "memory_id", "session_id"))
    first = t.groupBy("memory_id").agg(F.min("speaker").alias("a"), F.max("speaker").alias("b"))
    item = F.struct("turn_index", "turn_no", "speaker", F.col("raw_text").alias("text"), F.when(F.col("turn_index") % 5 == 0, "a lamp").alias("blip_caption"))
    s = t.groupBy("memory_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("body"))
    j = s.join(first, "memory_id").select("memory_id", F.to_json(F.create_map(F.lit("speaker_a"), F.col("a"), F.lit("speaker_b"), F.col("b"), F.lit("session_1"), F.col("body"), F.lit("session_1_date_time"), F.lit("x"))).alias("json"))
    return I.dialogue_turns(j, "memory_id", "json")


def src_evidence_ref(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders", "o_orderkey", "o_custkey")
    refs = F.concat(F.lit("D"), F.pmod("o_orderkey", F.lit(30)) + 1, F.lit(":"), F.pmod("o_custkey", F.lit(20)) + 1, F.when(F.col("o_orderkey") % 3 == 0, F.lit("; D2:4;oops")).otherwise("; D1:1"))
    return o.select("o_orderkey", I.all_refs_valid(refs).alias("strict"), F.explode(I.evidence_refs(refs)).alias("r")).select("o_orderkey", "strict", "r.*").groupBy("o_orderkey", "strict").agg(F.count(F.lit(1)).alias("n"), F.min("session_id").alias("first_session"), F.max("turn_index").alias("last_index"))


def _gold(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "answers", "answer_no", "question_id", "evidence_tokens", "completion_tokens", "prompt_tokens")
    return a.select(
        F.when(F.col("answer_no") % 50 != 0, F.col("question_id")).alias("question_id"), F.lit("session_1").alias("session_id"), (F.col("evidence_tokens") % 40 - 1).alias("turn_index"), (F.col("completion_tokens") % 9).alias("span_start"),
        (F.col("prompt_tokens") % 11).alias("span_end"), (F.col("evidence_tokens") % 13 / 10.0).alias("confidence"), "answer_no",
    )


def src_gold(spark: SparkSession, folder: str) -> DataFrame:
    return I.gold_problems(_gold(spark, folder)).select("answer_no", "problem")


def src_by_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of a request in the order of its ids."""
    a = table(spark, folder, "answers", "answer_no", "evidence_turn_ids").select("answer_no", F.posexplode("evidence_turn_ids").alias("pos", "turn_id"))
    t = _late(spark, folder).select("turn_id", "turn_no")
    got = a.join(t, "turn_id").groupBy("answer_no").agg(F.array_sort(F.collect_list(F.struct("pos", "turn_no"))).alias("t"))
    return got.select("answer_no", F.array_join(F.transform("t", lambda x: x["turn_no"].cast("string")), ",").alias("turn_nos"))


def src_sqlite(spark: SparkSession, folder: str) -> DataFrame:
    """What each memory holds, by owner, from one snapshot."""
    f = facts(spark, folder)
    return f.groupBy("memory_id", "owner_id").agg(F.count(F.lit(1)).alias("n_facts"), F.count_distinct("session_id").alias("n_sessions"), F.count_distinct("value_key").alias("n_values"))


# Sinks


def sink_upsert(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "turns", "turn_id", "turn_no", "content_hash", "ingested_at")
    late = t.where("turn_no % 2 = 0")
    once = S.upsert(t.where("turn_no % 2 = 1"), late, ["turn_id"], ["ingested_at", "turn_no"])
    return S.upsert(once, late, ["turn_id"], ["ingested_at", "turn_no"]).select("turn_id", "turn_no", "content_hash")


def _nodes_edges(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, folder, "lineitem", "l_partkey", "l_suppkey").distinct()
    e = li.select(F.concat("l_partkey", F.lit("-"), "l_suppkey").alias("edge_id"), F.concat(F.lit("p"), "l_partkey").alias("src_id"), F.concat(F.lit("s"), "l_suppkey").alias("dst_id"), F.lit(1).alias("weight"))
    n = e.select(F.col("src_id").alias("node_id")).unionByName(e.select(F.col("dst_id").alias("node_id"))).distinct().withColumn("rev", F.lit(1))
    return n, e


def sink_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Parts divisible by 7 leave with their edges; parts divisible by 5 are renewed; edges of part 10 gain weight."""
    n, e = _nodes_edges(spark, folder)
    number = F.regexp_extract("node_id", "^p([0-9]+)$", 1)
    up = n.where((number != "") & (F.when(number != "", number).cast("int") % 5 == 0)).where(F.when(number != "", number).cast("int") % 7 != 0).withColumn("rev", F.lit(2))
    gone = n.where((number != "") & (F.when(number != "", number).cast("int") % 7 == 0)).select("node_id")
    renewed = e.where("src_id = 'p10'").withColumn("weight", F.lit(5))
    nodes, edges, _ = S.apply_delta(n, e, up, renewed, gone, e.where("dst_id = 's3'").select("edge_id"))
    got = edges.groupBy(F.col("dst_id").alias("node_id")).agg(F.sum("weight").alias("weight"))
    return nodes.join(got, "node_id", "left").select("node_id", "rev", F.coalesce("weight", F.lit(0)).alias("weight"))


def sink_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Turns left when every first session is deleted."""
    first = table(spark, folder, "sessions", "memory_id", "session_id", "ordinal").where("ordinal = 0")
    return S.without(table(spark, folder, "turns", "turn_no", "memory_id", "session_id"), first, ["memory_id", "session_id"]).groupBy("memory_id").agg(F.count(F.lit(1)).alias("turns"))


def sink_shard(spark: SparkSession, folder: str) -> DataFrame:
    """One memory split off, doubled in value, and merged back."""
    f = facts(spark, folder).select("memory_id", "binding_id", "turn_index")
    shard = f.where("memory_id = 'm3'").withColumn("turn_index", F.col("turn_index") + 1000)
    return S.merge_shard(f, shard).groupBy("memory_id").agg(F.count(F.lit(1)).alias("n"), F.sum("turn_index").alias("places"))


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def sink_replace(spark: SparkSession, folder: str) -> DataFrame:
    """A table published twice; the second snapshot is what is read."""
    v = VersionedTable(spark, _scratch(spark, "replace"))
    f = facts(spark, folder).select("memory_id", "binding_id", "value_key")
    v.publish(f, expected=0)
    v.publish(f.where("memory_id <> 'm1'"), expected=1)
    return v.read().groupBy("memory_id").agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit(v.version()))


def src_replica(spark: SparkSession, folder: str) -> DataFrame:
    """A replica catches up and holds the same rows."""
    a, b = (VersionedTable(spark, _scratch(spark, n)) for n in ("first", "second"))
    a.publish(facts(spark, folder).select("memory_id", "binding_id"))
    lag = a.replicate(b)
    return b.read().groupBy("memory_id").agg(F.count(F.lit(1)).alias("n")).withColumn("lag", F.lit(lag))


def sink_reports(spark: SparkSession, folder: str) -> DataFrame:
    """A report written as CSV and JSON lines, read back and compared."""
    r = facts(spark, folder).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))
    at = _scratch(spark, "report")
    r.write.csv(f"{at}/csv", header=True)
    r.write.json(f"{at}/json")
    c = spark.read.csv(f"{at}/csv", header=True, schema="predicate string, n bigint")
    return c.join(spark.read.json(f"{at}/json", schema="predicate string, n bigint"), ["predicate", "n"])


# Traversal


def _tree(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    region, nation, customer = table(spark, folder, "region"), table(spark, folder, "nation"), table(spark, folder, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    nid = lambda p, c: F.concat(F.lit(p), F.lpad(F.col(c).cast("string"), 8, "0"))
    nodes = (
        region.select(nid("r", "r_regionkey").alias("node_id"), content_terms(F.col("r_name")).alias("terms"), F.lit(0.5).alias("confidence"))
        .unionByName(nation.select(nid("n", "n_nationkey").alias("node_id"), content_terms(F.col("n_name")).alias("terms"), F.lit(0.7).alias("confidence")))
        .unionByName(customer.select(nid("c", "c_custkey").alias("node_id"), content_terms(F.col("c_mktsegment")).alias("terms"), F.lit(0.9).alias("confidence")))
    )
    tree = nation.select(nid("r", "n_regionkey").alias("parent_id"), nid("n", "n_nationkey").alias("child_id")).unionByName(customer.select(nid("n", "c_nationkey").alias("parent_id"), nid("c", "c_custkey").alias("child_id")))
    return nodes, tree


def rt_route_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """The query set of customers divisible by 20, each by its nation's name and market segment, down the tree of regions, nations and customers."""
    nodes, tree = _tree(spark, folder)
    n = table(spark, folder, "nation", "n_nationkey", "n_name")
    c = table(spark, folder, "customer", "c_custkey", "c_nationkey", "c_mktsegment").where("c_custkey % 20 = 0").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    q = c.select(F.concat(F.lit("q"), "c_custkey").alias("query_id"), content_terms(F.concat_ws(" ", "n_name", "c_mktsegment")).alias("terms"))
    return G.beam_route(q, nodes, tree).select("query_id", "node_id", "depth", "score")


def rt_route_closure(spark: SparkSession, folder: str) -> DataFrame:
    """How much lies under each region, by distance."""
    _, tree = _tree(spark, folder)
    roots = tree.where("parent_id like 'r%'").select(F.col("parent_id").alias("root_id")).distinct()
    return G.descend(roots, tree, 3).groupBy("root_id", "hops").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("first_node"))


def st_affected(spark: SparkSession, folder: str) -> DataFrame:
    """Ancestors of changed leaves (customers divisible by 20): what an update recomputes."""
    _, tree = _tree(spark, folder)
    leaf = tree.where("child_id like 'c%'").where(F.substring("child_id", 2, 8).cast("int") % 20 == 0).select(F.col("child_id").alias("leaf_id"))
    return G.ancestors(leaf, tree, 3).where("hops > 0").groupBy("node_id").agg(F.count(F.lit(1)).alias("changed_leaves"))


def rt_owner_terminals(spark: SparkSession, folder: str) -> DataFrame:
    """An owner's facts by value, 20 each."""
    w = Window.partitionBy("owner_id").orderBy(F.col("value_key").desc(), "binding_id")
    return facts(spark, folder).select("owner_id", "binding_id", F.row_number().over(w).alias("rank")).where("rank <= 20")


def _node(kind: str, key: str) -> Column:
    return F.concat(F.lit(kind), F.lpad(F.col(key).cast("string"), 6, "0"))


def _capped(spark: SparkSession, folder: str) -> DataFrame:
    """(l_partkey, l_suppkey): each part with the four suppliers it has most of."""
    li = table(spark, folder, "lineitem", "l_partkey", "l_suppkey", "l_quantity").repartition("l_partkey").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").cast("double").alias("confidence"))
    return O.degree_capped(li.withColumn("edge_id", F.col("l_suppkey")), 4, ["l_partkey"]).select("l_partkey", "l_suppkey")


def _steps(spark: SparkSession, folder: str) -> DataFrame:
    """Parts and suppliers in both directions, each part with the four suppliers it has most of."""
    return G.both_ways(_capped(spark, folder).select(F.concat("l_partkey", F.lit("-"), "l_suppkey").alias("edge_id"), _node("p", "l_partkey").alias("src_id"), F.lit("MEMBER_OF").alias("relation"), _node("s", "l_suppkey").alias("dst_id")))


def rt_node_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Shortest paths of up to two steps from every part divisible by 20."""
    steps = _steps(spark, folder)
    sources = steps.where("node like 'p%'").where(F.substring("node", 2, 6).cast("int") % 20 == 0).select(F.col("node").alias("source_id")).distinct()
    return G.shortest_paths(sources, steps, 2).select("source_id", "node_id", "hops", F.array_join("path", ">").alias("path"))


def _part_terms(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part", "p_partkey", "p_name", "p_brand", "p_type")
    return p.select("p_partkey", _node("p", "p_partkey").alias("node"), content_terms(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("terms"))


def _expansion(spark: SparkSession, folder: str, hops: int) -> DataFrame:
    """From every part divisible by 20, by the words of its brand and type."""
    held = cut(_capped(spark, folder)).select(_node("p", "l_partkey").alias("node"), _node("s", "l_suppkey").alias("next"), F.lit("MEMBER_OF").alias("relation"))
    steps = held.unionByName(held.select(F.col("next").alias("node"), F.col("node").alias("next"), "relation"))
    p = _part_terms(spark, folder)
    seeds = p.where("p_partkey % 20 = 0").join(held.select("node").distinct(), "node", "left_semi")
    return G.expand(seeds.select(F.concat(F.lit("q"), "node").alias("query_id"), F.col("node").alias("node_id"), F.col("terms").alias("query_terms")), steps, p, 25, hops)


def rt_priority_expand(spark: SparkSession, folder: str) -> DataFrame:
    return _expansion(spark, folder, 2)


def rt_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Obligations first: of each query's visits within two hops, per term of the query the first node that holds it, then the rest by place, ten in all."""
    got = _expansion(spark, folder, 2)
    p = _part_terms(spark, folder)
    asked = p.groupBy(F.concat(F.lit("q"), "node").alias("query_id")).agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("asked"))
    holds = got.where("hops > 0").join(p.select(F.col("node").alias("node_id"), "terms"), "node_id").select("query_id", "place", "terms").join(asked, "query_id")
    first = holds.select("query_id", "place", F.explode(F.array_intersect("asked", "terms")).alias("term")).groupBy("query_id", "term").agg(F.min("place").alias("place"))
    first = first.groupBy("query_id", "place").agg(F.count(F.lit(1)).alias("proves"))
    both = got.join(first, ["query_id", "place"], "left").withColumn("proves", F.coalesce("proves", F.lit(0)))
    w = Window.partitionBy("query_id").orderBy(F.col("proves").desc(), "place")
    return both.select("query_id", "node_id", "hops", "proves", F.row_number().over(w).alias("turn")).where("turn <= 10")


def rt_provenance(spark: SparkSession, folder: str) -> DataFrame:
    """Turns behind each question's answers."""
    a = table(spark, folder, "answers", "question_id", "evidence_turn_ids").select("question_id", F.explode("evidence_turn_ids").alias("turn_id")).distinct()
    return a.join(_late(spark, folder).select("turn_id", "turn_no"), "turn_id").groupBy("question_id").agg(F.count(F.lit(1)).alias("turns"), F.min("turn_no").alias("first_no"))


def rt_session_router(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 hits kept if their session is among the query's two best."""
    best = SQ.topk_session_bm25(spark, folder).where("rank <= 2").select("query_id", F.col("id").alias("session_id"))
    hits = SQ.topk_bm25(spark, folder).select("query_id", "id").join(table(spark, folder, "turns", "turn_no", "session_id").withColumnRenamed("turn_no", "id"), "id")
    return hits.join(best, ["query_id", "session_id"], "left_semi").select("query_id", "id")


def rt_session_flood(spark: SparkSession, folder: str) -> DataFrame:
    """All turns of the query's best session."""
    best = SQ.topk_session_bm25(spark, folder).where("rank = 1").join(SQ.asked(spark, folder), "query_id").select("query_id", F.col("scope").alias("memory_id"), F.col("id").alias("session_id"))
    return table(spark, folder, "turns", "turn_no", "memory_id", "session_id").join(best, ["memory_id", "session_id"]).select("query_id", "turn_no")


def rt_speaker_bonus(spark: SparkSession, folder: str) -> DataFrame:
    """Turns whose speaker's name stands in the question, of the query set."""
    q = SQ.asked(spark, folder).select("query_id", "scope", F.explode(content_terms(F.col("query"))).alias("name"))
    t = table(spark, folder, "turns", "turn_no", "memory_id", "speaker").where("lower(speaker) not in ('user', 'assistant', 'system', 'tool')").select("turn_no", F.col("memory_id").alias("scope"), F.lower("speaker").alias("name"))
    return q.join(t, ["scope", "name"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("bonus_turns"))


def rt_manifest_match(spark: SparkSession, folder: str) -> DataFrame:
    """Chains whose predicate, collection or a value is what is asked of their memory: they close its operand."""
    m = O.manifests(facts(spark, folder), ["owner_id", "predicate", "collection_key"]).join(asks(spark, folder), "memory_id")
    hit = (F.col("predicate") == F.col("asked_predicate")) | (F.col("collection_key") == F.col("asked_collection")) | F.array_contains("value_keys", F.col("asked_value"))
    return m.where(F.coalesce(hit, F.lit(False))).select("memory_id", "owner_id", "predicate", "collection_key", "member_count")


def rt_fact_reservoir(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of each memory by reciprocal ranks over five channels, 30 each: newest, of the asked owner, of the asked predicate, of the asked collection, of the asked value.

    A channel ranks only its own hits, newest first.  Places come from ranges, so a memory's facts never meet in one task; of the fused ones only each task's 30 best do.
    """
    f = facts(spark, folder).where("polarity = 'positive'").join(asks(spark, folder), "memory_id").select("memory_id", "binding_id", "ts", *(F.col(c) for c in ("owner_id", "predicate", "collection_key", "value_key", "asked_owner", "asked_predicate", "asked_collection", "asked_value")))
    hits = {"new": F.lit(True), "owner": F.col("owner_id") == F.col("asked_owner"), "predicate": F.col("predicate") == F.col("asked_predicate"), "collection": F.col("collection_key") == F.col("asked_collection"), "value": F.col("value_key") == F.col("asked_value")}
    rows = f.select("memory_id", "binding_id", "ts", F.explode(F.array_compact(F.array(*[F.when(h, F.lit(c)) for c, h in hits.items()]))).alias("channel"))
    r = ranked(rows, ["memory_id", "channel"], [F.col("ts").desc_nulls_last(), F.col("binding_id")], "k")
    s = r.groupBy("memory_id", "binding_id").agg(F.round(F.sum(1.0 / (60 + F.col("k"))), 9).alias("rrf"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("memory_id").orderBy(F.col("rrf").desc(), "binding_id"))).where("rank <= 30")


def rt_active_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Of the reservoir, eight per operand."""
    r = rt_fact_reservoir(spark, folder).join(facts(spark, folder).select("binding_id", "operand_id"), "binding_id")
    w = Window.partitionBy("memory_id", "operand_id").orderBy("rank")
    return r.withColumn("k", F.row_number().over(w)).where("k <= 8").select("memory_id", "operand_id", "binding_id", "k")


def rt_seed(spark: SparkSession, folder: str) -> DataFrame:
    """Wide reservoir: all channels' hits, strongest score per channel, reciprocal ranks, first 20."""
    from turnloom.operators.fusion import reciprocal_ranks

    c = SQ.channels(spark, folder)
    fused = reciprocal_ranks(c)
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), "id"))).where("rank <= 20")


def rt_seed_narrow(spark: SparkSession, folder: str) -> DataFrame:
    """Narrow reservoir: 8 exact and 24 BM25 hits by reciprocal ranks, 96 at most."""
    from turnloom.operators import search as L
    from turnloom.operators.fusion import reciprocal_ranks

    turns = SQ._turns(spark, folder)
    q, (t, post, sizes) = SQ.asked(spark, folder), turns
    hits = L.exact(q, post, t.select(F.col("turn_no").alias("id"), F.col("raw_text").alias("text")), 8).withColumn("channel", F.lit("exact"))
    both = hits.unionByName(L.bm25(q, post, sizes, 24, SQ._frequencies(spark, folder)).withColumn("channel", F.lit("bm25")))
    w = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), "id")
    return reciprocal_ranks(both).withColumn("rank", F.row_number().over(w)).where("rank <= 96")


def sv_focus(spark: SparkSession, folder: str) -> DataFrame:
    """The three sentences of a query's ten BM25 turns that hold most idf of its terms."""
    from turnloom.operators import search as L

    _, _, sizes = SQ._turns(spark, folder)
    hits = SQ.topk_bm25(spark, folder).select("query_id", F.col("id").alias("turn_no"))
    said = Y.spoken_sentences(table(spark, folder, "turns", "turn_no", "memory_id", "session_id", "turn_index", "speaker", "raw_text").join(hits.select("turn_no").distinct(), "turn_no", "left_semi"))
    terms = L.query_terms(SQ.asked(spark, folder)).join(SQ._frequencies(spark, folder), ["scope", "term"]).join(sizes, "scope").select("query_id", "term", L.idf(F.col("total"), F.col("df")).alias("idf"))
    words = said.join(hits, "turn_no").select("query_id", "turn_no", "pos", F.explode(content_terms(F.col("sentence"))).alias("term"))
    scored = words.join(terms, ["query_id", "term"]).groupBy("query_id", "turn_no", "pos").agg(F.round(F.sum("idf"), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "turn_no", "pos")
    return scored.withColumn("k", F.row_number().over(w)).where("k <= 3")


def rt_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Operand turns of the query set: twice the idf coverage, 0.5 for a number, 0.3 over the place by coverage; twelve each."""
    cov = SQ.num_coverage(spark, folder).join(table(spark, folder, "turns", "turn_no", "raw_text").withColumnRenamed("turn_no", "id"), "id")
    w = Window.partitionBy("query_id")
    place = F.row_number().over(w.orderBy(F.col("coverage").desc(), "id"))
    score = F.round(2 * F.col("coverage") + F.when(F.col("raw_text").rlike("[0-9]"), 0.5).otherwise(0.0) + 0.3 / place, 6)
    return cov.select("query_id", "id", score.alias("score")).withColumn("rank", F.row_number().over(w.orderBy(F.col("score").desc(), "id"))).where("rank <= 12")


# Packing


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    f = SQ._fused(spark, folder).join(table(spark, folder, "turns", "turn_no", "raw_text").withColumnRenamed("turn_no", "id"), "id")
    held = F.array_compact(F.array(F.when(F.col("raw_text").rlike("[0-9]"), "number"), F.when(F.col("raw_text").contains("?"), "question")))
    return f.select("query_id", "id", "session_id", "fused", estimate_tokens(F.col("raw_text")).cast("bigint").alias("token_cost"), held.alias("slots"), (F.col("exact") >= 0.5).alias("mandatory"))


def pack_rank(spark: SparkSession, folder: str) -> DataFrame:
    """With two turns reserved for mandatory ones."""
    return P.pack_rank(_candidates(spark, folder), 6, 150, 2)


def pack_set_cover(spark: SparkSession, folder: str) -> DataFrame:
    """A new session weighs 0.9 where the question asks for a count or a list."""
    s = slots(F.col("query"))
    kinds = SQ.asked(spark, folder).select("query_id", (s["is_count"] | s["is_list"]).alias("many"))
    return P.pack_set_cover(_candidates(spark, folder).join(kinds, "query_id"), 6, 150, F.when(F.col("many"), 0.9).otherwise(0.2))


def pack_obligation(spark: SparkSession, folder: str) -> DataFrame:
    return P.pack_obligation(_candidates(spark, folder), 6, 150)


def pack_units(spark: SparkSession, folder: str) -> DataFrame:
    return P.pack_units(_candidates(spark, folder), 6, 150)


def pack_render(spark: SparkSession, folder: str) -> DataFrame:
    return P.pack_render(_candidates(spark, folder), 150)


def rt_topology_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Packed turns in reading order, sessions in order of their best turn."""
    p = pack_rank(spark, folder).join(table(spark, folder, "turns", "turn_no", "session_id", "turn_index").withColumnRenamed("turn_no", "id"), "id")
    best = F.min("place").over(Window.partitionBy("query_id", "session_id"))
    q = p.withColumn("best", best)
    return q.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("best", "session_id", "turn_index", "id")).alias("line"))


def rt_navigate(spark: SparkSession, folder: str) -> DataFrame:
    """Question to packed evidence: compiled, seeded, fused, packed by obligation, and certified.

    Per query: the kind of answer its slots ask for, the owners it names, seeds, turns and tokens of the
    pack, how many of its content terms the pack's texts hold, and whether all are (its certificate).
    """
    q = SQ.asked(spark, folder)
    kind = answer_kind(slots(F.col("query"))).alias("kind")
    people = C.principals(table(spark, folder, "turns", "memory_id", "speaker"))
    named = C.owners(q, people).groupBy("query_id").agg(F.count_distinct("owner").alias("owners"))
    cand = cut(_candidates(spark, folder))
    seeds = cand.groupBy("query_id").agg(F.count(F.lit(1)).alias("seeds"))
    pack = P.pack_obligation(cand, 6, 150)
    texts = table(spark, folder, "turns", "turn_no", "raw_text").select(F.col("turn_no").alias("id"), F.explode(content_terms(F.col("raw_text"))).alias("term"))
    wanted = q.select("query_id", F.explode(content_terms(F.col("query"))).alias("term"))
    covered = pack.select("query_id", "id").join(texts, "id").select("query_id", "term").distinct().join(wanted, ["query_id", "term"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("covered"))
    terms = F.size(content_terms(F.col("query")))
    sizes = pack.groupBy("query_id").agg(F.count(F.lit(1)).alias("turns"), F.max("used_tokens").alias("tokens"))
    got = q.select("query_id", kind, terms.alias("terms")).join(named, "query_id", "left").join(seeds, "query_id", "left").join(sizes, "query_id", "left").join(covered, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return got.select("query_id", "kind", *map(zero, ("owners", "seeds", "turns", "tokens", "covered")), (F.coalesce("covered", F.lit(0)) >= F.col("terms")).alias("complete"))


# Building


def gb_segment(spark: SparkSession, folder: str) -> DataFrame:
    t = _late(spark, folder)
    t = t.select("memory_id", "session_id", "turn_no", "turn_index", F.lower(F.trim("role")).alias("role"), "speaker", "listener", content_terms(F.coalesce("raw_text", F.lit(""))).alias("terms"), names(F.coalesce("raw_text", F.lit("")), STOP_NAMES).alias("names"))
    return B.segment(t)


def gb_rare_terms(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "turns", "memory_id", "session_id", "raw_text").select("memory_id", "session_id", F.explode(content_terms(F.col("raw_text"))).alias("term"))
    return B.rare_terms(t)


def gb_merge_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Capitalised words of turns that fold to one key in several spellings."""
    t = table(spark, folder, "turns", "memory_id", "session_id", "raw_text")
    s = t.select("memory_id", "session_id", F.explode(F.regexp_extract_all("raw_text", F.lit(r"[\p{L}\p{N}_'-]+"), F.lit(0))).alias("surface")).distinct()
    return B.alias_groups(s, merge_surface(F.col("surface"))).select("memory_id", "key", F.array_join("forms", "|").alias("forms"))


def gb_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Names of a memory with their sessions and first turn."""
    t = table(spark, folder, "turns", "turn_no", "memory_id", "session_id", "raw_text")
    n = t.select("memory_id", "session_id", "turn_no", F.explode(names(F.col("raw_text"), STOP_NAMES)).alias("name"))
    return n.groupBy("memory_id", "name").agg(F.count_distinct("session_id").alias("sessions"), F.min("turn_no").alias("first_no"))


def gb_facts_lean(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of facts: owner to fact, fact to collection, and to the next state of its chain."""
    f = facts(spark, folder)
    has = f.select(F.col("owner_id").alias("src"), F.lit("HAS_FACT").alias("relation"), F.col("binding_id").cast("string").alias("dst"))
    member = f.select(F.col("binding_id").cast("string").alias("src"), F.lit("MEMBER_OF").alias("relation"), F.concat("owner_id", F.lit(":"), "collection_key").alias("dst"))
    nxt = O.next_in_chain(f, ["owner_id", "predicate"]).where("next_id is not null and value_key <> next_value").select(F.col("binding_id").cast("string").alias("src"), F.lit("STATE_NEXT").alias("relation"), F.col("next_id").cast("string").alias("dst"))
    return has.unionByName(member).unionByName(nxt)


def gb_portals(spark: SparkSession, folder: str) -> DataFrame:
    """A session's portal to the memory's next session by ordinal."""
    s = table(spark, folder, "sessions", "memory_id", "session_id", "ordinal").distinct()
    w = Window.partitionBy("memory_id").orderBy("ordinal", "session_id")
    return s.select("memory_id", "session_id", F.lead("session_id").over(w).alias("next_session")).where("next_session is not null")


def _pair_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Signals of neighbouring owners (u, u + 1) by their purchases and views."""
    f = facts(spark, folder).groupBy("owner_id").agg(F.array_sort(F.collect_set("value_key")).alias("v"), F.min("ts").alias("t"), F.count_if(F.col("operand_id") == "o1").alias("n"))
    a = f.select((F.substring("owner_id", 2, 9).cast("int")).alias("u"), "v", "t", "n")
    b = a.select((F.col("u") - 1).alias("u"), F.col("v").alias("v2"), F.col("t").alias("t2"), F.col("n").alias("n2"))
    j = a.join(b, "u")
    shared = F.size(F.array_intersect("v", "v2"))
    return j.select("u", F.round(shared / F.size(F.array_union("v", "v2")), 6).alias("entity"), F.round(F.exp(-F.abs(F.datediff(F.to_date("t"), F.to_date("t2"))) / 90.0), 6).alias("near"), F.round(F.least("n", "n2") / F.greatest(F.lit(1), F.greatest("n", "n2")), 6).alias("state"))


def _signals() -> dict:
    return {"SHARED_ENTITY": F.col("entity"), "TEMPORAL_NEAR": F.col("near"), "STATE_COMPATIBLE": F.col("state")}


def gb_rel_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _pair_scores(spark, folder)


def gb_rel_mask(spark: SparkSession, folder: str) -> DataFrame:
    return _pair_scores(spark, folder).select("u", F.array_join(B.signal_mask(_signals()), ",").alias("signals"))


def gb_rel_gate(spark: SparkSession, folder: str) -> DataFrame:
    return _pair_scores(spark, folder).select("u", F.round(B.gate_score(_signals()), 6).alias("gate"))


def gb_knn_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each queried vector's five nearest others of another label, as undirected pairs with the higher score: each label is searched by the queries of all others."""
    from turnloom.operators.search import dense

    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    q = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector", F.col("label").alias("not_label"))
    near = dense(q, e, 5, apart=("not_label", "label"))
    return near.groupBy(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b")).agg(F.max("score").alias("score"))


def gb_sparse_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Owners of one memory who share five values or more."""
    return B.sparse_pairs(facts(spark, folder).select("memory_id", "owner_id", "value_key"), 5)


def gb_canonicalize(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of predicates within their slot: vectors of one label, linked where one divisible by 20 has the other among its three nearest of the label with a cosine of 0.25 or more, and closed over the links."""
    from turnloom.operators.search import dense

    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    q = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector", F.col("label").alias("slot"))
    near = dense(q, e, 4, together=("slot", "label")).where("query_id <> id and score >= 0.25")
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))).where("k <= 3")
    return G.components(near.select(F.col("query_id").alias("a"), F.col("id").alias("b")))


def gb_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Recursive cards over each memory's sessions, eight to a card; sessions stand by the content term most of their turns hold, so that cards hold like ones."""
    t = table(spark, folder, "turns", "memory_id", "session_id", "raw_text")
    n = t.select("memory_id", "session_id", F.explode(content_terms(F.col("raw_text"))).alias("term")).groupBy("memory_id", "session_id", "term").agg(F.count(F.lit(1)).alias("n"))
    sign = n.groupBy("memory_id", "session_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "term"))["term"].alias("sign"))
    s = t.select("memory_id", "session_id").distinct().join(sign, ["memory_id", "session_id"], "left")
    return B.grouped_hierarchy(s.withColumnRenamed("session_id", "leaf_id"), 8, "sign")


def _extracted(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "answers", "answer_no", "question_id", "prediction", "evidence_turn_ids", "evidence_tokens", "answer_model", "completion_tokens")
    return a.select(F.col("answer_no").alias("fact_no"), F.col("question_id").alias("scene_id"), "answer_model", F.col("answer_model").alias("owner"), F.when(F.col("answer_no") % 9 != 0, "says").alias("predicate"), F.col("prediction").alias("value"), F.col("evidence_turn_ids").alias("evidence"), (F.col("evidence_tokens") % 12 / 10.0).alias("confidence"))


def gb_semantic_validate(spark: SparkSession, folder: str) -> DataFrame:
    return B.validate_extracted(_extracted(spark, folder), 5).select("fact_no", "problem")


def gb_span_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Where a question's last word, else its first, stands in the gold answer."""
    q = table(spark, folder, "questions", "question_id", "question", "gold_answer").where("gold_answer is not null")
    words = F.regexp_extract_all("question", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    s = B.resolve_span(F.element_at(words, -1), F.element_at(words, 1), F.col("gold_answer"))
    return q.select("question_id", s["start"].alias("start"), s["end"].alias("end"), s["how"].alias("how"))


def gb_fact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    f = facts(spark, folder).select(F.col("owner_id").alias("owner"), "predicate", F.col("value_key").alias("value"), "polarity", F.col("session_id").alias("evidence"), (F.col("turn_index") / 10.0).alias("confidence"), F.array(F.col("event_instance_id")).alias("unit_ids"), F.col("binding_id").alias("fact_no"))
    m = B.merge_facts(f.withColumn("unit_ids", F.array_compact("unit_ids")))
    return m.select("owner", "predicate", "value", "polarity", "evidence", F.round("confidence", 4).alias("confidence"), F.array_join("unit_ids", ",").alias("unit_ids"), "fact_no")


def gb_unit_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of turns that no fact span (the first 60 characters) covers, counted per turn."""
    t = table(spark, folder, "turns", "turn_no", "raw_text").where("raw_text is not null")
    n = t.select("turn_no", F.posexplode(F.split("raw_text", " ")).alias("k", "w")).where(F.col("w").rlike("^[0-9]+$"))
    units = n.select("turn_no", F.concat_ws("-", "turn_no", "k").alias("unit_id"), F.col("k").alias("start"), (F.col("k") + 1).alias("end"))
    spans = t.select("turn_no", F.lit(0).alias("start"), F.lit(10).alias("end"))
    return B.uncovered_units(units, spans).groupBy("turn_no").agg(F.count(F.lit(1)).alias("open_units"))


def gb_routing_card(spark: SparkSession, folder: str) -> DataFrame:
    """Postings of each memory's card: rare terms to how many sessions, the 64 rarest."""
    r = gb_rare_terms(spark, folder)
    w = Window.partitionBy("memory_id").orderBy("df", "term")
    return r.withColumn("k", F.row_number().over(w)).where("k <= 64").select("memory_id", "term", "df")


def map_child_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Term to child sessions of a memory, for terms in two to six sessions."""
    t = table(spark, folder, "turns", "memory_id", "session_id", "raw_text").select("memory_id", "session_id", F.explode(content_terms(F.col("raw_text"))).alias("term")).distinct()
    g = t.groupBy("memory_id", "term").agg(F.array_sort(F.collect_list("session_id")).alias("s"))
    return g.where(F.size("s").between(2, 6)).select("memory_id", "term", F.array_join("s", ",").alias("children"))


def st_hwm(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events", "event_id", "user_id", "event_type")
    j = e.select(F.pmod("user_id", F.lit(20)).alias("memory_id"), F.col("event_id").alias("source_offset"), F.when(F.col("event_type") == "error", "RECEIVED").otherwise("FACT_INDEXED").alias("state"))
    return S.received_high_water(j)


def id_stable(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "questions", "question_id", "memory_id")
    return q.select("question_id", F.concat(F.lit("query:"), F.sha2(F.concat_ws("|", F.lit("query"), "memory_id", "question_id"), 256).substr(1, 32)).alias("stable_id"))


QUERIES = {f.__name__: f for f in (
    src_json_lme, src_ingest, src_locomo, src_evidence_ref, src_gold, src_by_ids, src_sqlite, sink_upsert, sink_delta, sink_delete, sink_shard, sink_replace, src_replica, sink_reports,
    rt_route_hierarchy, rt_route_closure, st_affected, rt_owner_terminals, rt_node_paths, rt_priority_expand, rt_schedule, rt_provenance, rt_session_router, rt_session_flood, rt_speaker_bonus, rt_manifest_match,
    rt_fact_reservoir, rt_active_facts, rt_seed, rt_seed_narrow, sv_focus, rt_ledger, pack_rank, pack_set_cover, pack_obligation, pack_units, pack_render, rt_topology_layout, rt_navigate,
    gb_segment, gb_rare_terms, gb_merge_aliases, gb_entities, gb_facts_lean, gb_portals, gb_rel_scores, gb_rel_mask, gb_rel_gate, gb_knn_pairs, gb_sparse_pairs, gb_canonicalize, gb_hierarchy,
    gb_semantic_validate, gb_span_resolve, gb_fact_dedup, gb_unit_coverage, gb_routing_card, map_child_postings, st_hwm, id_stable,
)}

_HAY = f"{LATE}, hh AS (SELECT *, 0 AS ordinal, row_number() OVER (PARTITION BY memory_id, session_id ORDER BY turn_index, turn_no) - 1 AS pos FROM late)"
_TREE = "t AS (SELECT 'r' || lpad(CAST(n_regionkey AS VARCHAR), 8, '0') AS p, 'n' || lpad(CAST(n_nationkey AS VARCHAR), 8, '0') AS c FROM nation UNION ALL SELECT 'n' || lpad(CAST(c_nationkey AS VARCHAR), 8, '0'), 'c' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') FROM customer)"
_WORDS = f"w AS (SELECT DISTINCT memory_id, session_id, unnest({sql_content('raw_text')}) AS term FROM turns)"
_RARE = f"{_WORDS}, n AS (SELECT memory_id, count(DISTINCT session_id) AS s FROM w GROUP BY ALL), rare AS (SELECT memory_id, term, count(*) AS df FROM w JOIN n USING (memory_id) GROUP BY memory_id, term, s HAVING count(*) >= 2 AND count(*) <= greatest(2, floor(s * 0.1::DOUBLE)))"
_PAIRS = f"""{FACTS}, f AS (SELECT owner_id, list(DISTINCT value_key) AS v, min(ts) AS t, count(*) FILTER (operand_id = 'o1') AS n FROM facts GROUP BY ALL), a AS (SELECT CAST(substr(owner_id, 2) AS INT) AS u, v, t, n FROM f),
 sc AS (SELECT a.u, round(len(list_intersect(a.v, b.v)) / len(list_distinct(a.v || b.v)), 6) AS entity, round(exp(-abs(datediff('day', CAST(a.t AS DATE), CAST(b.t AS DATE))) / 90.0::DOUBLE), 6) AS near, round(least(a.n, b.n) / greatest(1, a.n, b.n), 6) AS state FROM a JOIN a b ON b.u = a.u + 1)"""
_SPARSE = f"{FACTS}, d AS (SELECT DISTINCT memory_id, owner_id, value_key FROM facts), sp AS (SELECT memory_id, a.owner_id, b.owner_id AS other_id, count(*) AS shared FROM d a JOIN d b USING (memory_id, value_key) WHERE a.owner_id < b.owner_id GROUP BY ALL HAVING shared >= 5)"
_RES = f"""{FACTS}, {ASKS}, pf AS (SELECT * FROM facts JOIN asks USING (memory_id) WHERE polarity = 'positive'), ch AS (SELECT memory_id, binding_id, ts, unnest(list_filter(['new', CASE WHEN owner_id = asked_owner THEN 'owner' END, CASE WHEN predicate = asked_predicate THEN 'predicate' END, CASE WHEN collection_key = asked_collection THEN 'collection' END, CASE WHEN value_key = asked_value THEN 'value' END], lambda c: c IS NOT NULL)) AS channel FROM pf),
 rk AS (SELECT *, row_number() OVER (PARTITION BY memory_id, channel ORDER BY ts DESC NULLS LAST, binding_id) AS k FROM ch), rs AS (SELECT memory_id, binding_id, any_value(operand_id) AS operand_id, round(sum(1.0::DOUBLE / (60 + k)), 9) AS rrf FROM rk JOIN (SELECT binding_id, operand_id FROM facts) USING (binding_id) GROUP BY memory_id, binding_id),
 rr AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY rrf DESC, binding_id) AS rank FROM rs QUALIFY rank <= 30)"""
_CAND = f"{SQ._FUSED}, cand AS (SELECT query_id, id, f.session_id, fused, e >= 0.5 AS mandatory, CAST(greatest(1, ceil(len({sql_terms('raw_text')}) * 1.3::DOUBLE)) AS BIGINT) AS token_cost, list_filter([CASE WHEN regexp_matches(raw_text, '[0-9]') THEN 'number' END, CASE WHEN contains(raw_text, '?') THEN 'question' END], lambda x: x IS NOT NULL) AS slots, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) AS rk FROM f JOIN w USING (query_id, id) JOIN turns ON turn_no = id)"
SQL_OWNERS = f"""WITH pr AS (SELECT DISTINCT memory_id, speaker, lower(trim(speaker)) AS l FROM turns WHERE speaker <> ''), q AS (SELECT question_id AS query_id, memory_id, ' ' || array_to_string({sql_terms('question')}, ' ') || ' ' AS t FROM questions),
 nm AS (SELECT memory_id, speaker, array_to_string({sql_terms('speaker')}, ' ') AS alias FROM pr WHERE l NOT IN ('user', 'assistant', 'human', 'ai', 'system', 'tool')), h AS (SELECT query_id, speaker, alias FROM q JOIN nm USING (memory_id) WHERE length(alias) > 2 AND contains(t, ' ' || alias || ' ')),
 k AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.query_id = h.query_id AND length(o.alias) > length(h.alias) AND contains(' ' || o.alias || ' ', ' ' || h.alias || ' ')))
 SELECT DISTINCT query_id, speaker AS owner, 'name' AS how, 0.95::DOUBLE AS confidence FROM k UNION SELECT DISTINCT query_id, speaker, 'deictic', 1.0::DOUBLE FROM q JOIN pr USING (memory_id) WHERE l IN ('user', 'human', 'ai', 'system', 'tool') AND regexp_matches(t, ' (i|my|me|mine) ')"""
#: The fold of a pack over offers o (query_id, k, id, cost, slot, slots, most).
_FOLD = """fold AS (SELECT query_id, 0::BIGINT AS k, []::BIGINT[] AS got, []::VARCHAR[] AS covered, 0::BIGINT AS tokens, NULL::BIGINT AS id, false AS took FROM (SELECT DISTINCT query_id FROM o)
 UNION ALL SELECT query_id, k + 1, CASE WHEN t THEN list_append(got, nid) ELSE got END, CASE WHEN t THEN list_distinct(list_concat(covered, nslots)) ELSE covered END, CASE WHEN t THEN tokens + cost ELSE tokens END, nid, t
 FROM (SELECT fold.query_id, fold.k, got, covered, tokens, o.id AS nid, o.cost AS cost, o.slots AS nslots, len(got) < least(most, 6) AND tokens + o.cost <= 150 AND NOT list_contains(got, o.id) AND (slot = '' OR NOT list_contains(covered, slot)) AS t FROM fold JOIN o ON o.query_id = fold.query_id AND o.k = fold.k + 1)),
 pack AS (SELECT query_id, id, CAST(len(got) AS INT) AS place, tokens AS used_tokens FROM fold WHERE took)"""
_O = "o AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY lane, slot, rk) AS k, id, token_cost AS cost, slot, slots, most FROM ({0}))"
_EVERY = "SELECT query_id, {0} AS lane, '' AS slot, rk, id, token_cost, slots, 6 AS most FROM cand"
_RANK_PACK = f"RECURSIVE {_CAND}, {_O.format(_EVERY.format(1) + ' UNION ALL ' + _EVERY.format(0).replace('6 AS most', '2') + ' WHERE mandatory')}, {_FOLD}"
_DUTY_PACK = f"RECURSIVE {_CAND}, {_O.format(_EVERY.format(2) + ' UNION ALL ' + _EVERY.format(0) + ' WHERE rk <= 4 UNION ALL SELECT query_id, 1, unnest(slots), rk, id, token_cost, slots, 6 FROM cand')}, {_FOLD}"
_PARTS = "lpad(CAST({0} AS VARCHAR), 6, '0')"
_EXPAND = f"""qty AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS c FROM lineitem GROUP BY ALL), e0 AS (SELECT 'p' || {_PARTS.format('l_partkey')} AS a, 's' || {_PARTS.format('l_suppkey')} AS b FROM qty QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY c DESC, l_suppkey) <= 4), u AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
 pt AS (SELECT p_partkey, 'p' || {_PARTS.format('p_partkey')} AS node, list_distinct({sql_content("concat_ws(' ', p_name, p_brand, p_type)")}) AS terms FROM part),
 x0 AS (SELECT 'q' || node AS query_id, terms AS qt, node AS node_id, 0 AS hops, 1.0::DOUBLE AS priority, 1 AS place FROM pt WHERE p_partkey % 20 = 0 AND node IN (SELECT a FROM u)),
 y1 AS (SELECT DISTINCT query_id, qt, b AS node_id FROM x0 JOIN u ON a = node_id), x1 AS (SELECT query_id, qt, node_id, 1 AS hops, round(coalesce(len(list_intersect(qt, terms)), 0) / greatest(len(qt), 1) + 0.25::DOUBLE - 0.08::DOUBLE, 6) AS priority FROM y1 LEFT JOIN pt ON node = node_id WHERE 'q' || node_id <> query_id),
 z1 AS (SELECT *, 1 + row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, node_id) AS place FROM x1 QUALIFY place <= 25), s1 AS (SELECT query_id, node_id FROM x0 UNION SELECT query_id, node_id FROM z1), n1 AS (SELECT query_id, count(*) AS used FROM s1 GROUP BY ALL),
 y2 AS (SELECT DISTINCT query_id, qt, b AS node_id FROM z1 JOIN u ON a = node_id WHERE (query_id, b) NOT IN (SELECT (query_id, node_id) FROM s1)), x2 AS (SELECT query_id, qt, node_id, 2 AS hops, round(coalesce(len(list_intersect(qt, terms)), 0) / greatest(len(qt), 1) + 0.25::DOUBLE - 0.16::DOUBLE, 6) AS priority FROM y2 LEFT JOIN pt ON node = node_id),
 z2 AS (SELECT x2.*, used + row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, node_id) AS place FROM x2 JOIN n1 USING (query_id) QUALIFY place <= 25),
 ex AS (SELECT query_id, node_id, hops, priority, CAST(place AS INT) AS place FROM x0 UNION ALL SELECT query_id, node_id, hops, priority, CAST(place AS INT) FROM z1 UNION ALL SELECT query_id, node_id, hops, priority, CAST(place AS INT) FROM z2)"""
_CHAINS = "n AS (SELECT *, lead(binding_id) OVER w AS next_id, lead(value_key) OVER w AS next_value FROM facts WINDOW w AS (PARTITION BY memory_id, owner_id, predicate ORDER BY ts ASC NULLS LAST, session_id, turn_index, binding_id))"

SQL = {
    "src_json_lme": f"WITH {_HAY} SELECT memory_id, session_id, CAST(pos AS INT) AS turn_index, coalesce(speaker, lower(role), 'unknown') AS speaker, coalesce(lower(role), 'unknown') AS role, coalesce(raw_text, '') AS raw_text FROM hh",
    "src_ingest": f"WITH {_HAY} SELECT 'turn:' || substr(sha256('turn|' || memory_id || '|' || session_id || '|' || pos), 1, 32) AS turn_id, memory_id, CAST(ordinal AS INT) AS ordinal, sha256(coalesce(raw_text, '')) AS content_hash FROM hh",
    "src_locomo": f"""WITH {LATE}, t AS (SELECT * REPLACE (memory_id || '/' || session_id AS memory_id), row_number() OVER (PARTITION BY memory_id, session_id ORDER BY turn_index, turn_no) - 1 AS pos, min(speaker) OVER (PARTITION BY memory_id, session_id) AS a, max(speaker) OVER (PARTITION BY memory_id, session_id) AS b FROM late)
 SELECT memory_id, 'session_1' AS session_id, CAST(pos AS INT) AS turn_index, speaker, CASE WHEN speaker = a THEN b ELSE a END AS listener, coalesce(raw_text, '') || CASE WHEN turn_index % 5 = 0 THEN chr(10) || '[Media shared by ' || speaker || '; caption: a lamp]' ELSE '' END AS raw_text FROM t""",
    "src_evidence_ref": """WITH o AS (SELECT o_orderkey, o_orderkey % 3 <> 0 AS strict, [('session_' || (o_orderkey % 30 + 1), o_custkey % 20)] || CASE WHEN o_orderkey % 3 = 0 THEN [('session_2', 3)] ELSE [('session_1', 0)] END AS r FROM orders), u AS (SELECT o_orderkey, strict, unnest(list_distinct(r)) AS x FROM o)
 SELECT o_orderkey, strict, count(*) AS n, min(x[1]) AS first_session, CAST(max(x[2]) AS INT) AS last_index FROM u GROUP BY ALL""",
    "src_gold": """WITH g AS (SELECT CASE WHEN answer_no % 50 <> 0 THEN question_id END AS q, evidence_tokens % 40 - 1 AS ti, completion_tokens % 9 AS s0, prompt_tokens % 11 AS s1, evidence_tokens % 13 / 10.0::DOUBLE AS c, answer_no FROM answers), d AS (SELECT *, count(*) OVER (PARTITION BY q, ti, s0) AS n FROM g)
 SELECT answer_no, CASE WHEN q IS NULL THEN 'question_id' WHEN coalesce(ti, -1) < 0 THEN 'turn_index' WHEN coalesce(s0, -1) < 0 THEN 'span_start' WHEN coalesce(s1, -1) <= s0 THEN 'span_end' WHEN NOT coalesce(c BETWEEN 0 AND 1, false) THEN 'confidence' WHEN n > 1 THEN 'duplicate' END AS problem FROM d""",
    "src_by_ids": f"WITH {LATE}, a AS (SELECT answer_no, unnest(evidence_turn_ids) AS turn_id, generate_subscripts(evidence_turn_ids, 1) AS pos FROM answers) SELECT answer_no, string_agg(turn_no::VARCHAR, ',' ORDER BY pos, turn_no) AS turn_nos FROM a JOIN late USING (turn_id) GROUP BY answer_no",
    "src_sqlite": f"WITH {FACTS} SELECT memory_id, owner_id, count(*) AS n_facts, count(DISTINCT session_id) AS n_sessions, count(DISTINCT value_key) AS n_values FROM facts GROUP BY ALL",
    "sink_upsert": f"WITH {LATE} SELECT turn_id, turn_no, content_hash FROM late",
    "sink_delta": """WITH e AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), n AS (SELECT DISTINCT 'p' || p AS node_id, CASE WHEN p % 5 = 0 THEN 2 ELSE 1 END AS rev FROM e WHERE p % 7 <> 0 UNION ALL SELECT DISTINCT 's' || s, 1 FROM e),
 w AS (SELECT 's' || s AS node_id, sum(CASE WHEN p = 10 THEN 5 ELSE 1 END) AS weight FROM e WHERE p % 7 <> 0 AND (s <> 3 OR p = 10) GROUP BY ALL) SELECT node_id, rev, CAST(coalesce(weight, 0) AS BIGINT) AS weight FROM n LEFT JOIN w USING (node_id)""",
    "sink_delete": "SELECT memory_id, count(*) AS turns FROM turns WHERE (memory_id, session_id) NOT IN (SELECT memory_id, session_id FROM sessions WHERE ordinal = 0) GROUP BY memory_id",
    "sink_shard": f"WITH {FACTS} SELECT memory_id, count(*) AS n, CAST(sum(turn_index + CASE WHEN memory_id = 'm3' THEN 1000 ELSE 0 END) AS BIGINT) AS places FROM facts GROUP BY ALL",
    "sink_replace": f"WITH {FACTS} SELECT memory_id, count(*) AS n, 2 AS version FROM facts WHERE memory_id <> 'm1' GROUP BY ALL",
    "src_replica": f"WITH {FACTS} SELECT memory_id, count(*) AS n, 1 AS lag FROM facts GROUP BY ALL",
    "sink_reports": f"WITH {FACTS} SELECT predicate, count(*) AS n FROM facts GROUP BY ALL",
    "rt_route_closure": f"""WITH {_TREE}, a AS (SELECT DISTINCT p AS root_id, p AS node_id, 0 AS hops FROM t WHERE p LIKE 'r%'), b AS (SELECT root_id, c AS node_id, 1 AS hops FROM a JOIN t ON p = node_id), d AS (SELECT root_id, c AS node_id, 2 AS hops FROM b JOIN t ON p = node_id)
 SELECT root_id, hops, count(*) AS n, min(node_id) AS first_node FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d) GROUP BY ALL""",
    "rt_route_hierarchy": f"""WITH q AS (SELECT 'q' || c_custkey AS query_id, list_distinct({sql_content("n_name || ' ' || c_mktsegment")}) AS qt FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 20 = 0),
 nd AS (SELECT 'r' || lpad(CAST(r_regionkey AS VARCHAR), 8, '0') AS node_id, NULL AS parent_id, {sql_content('r_name')} AS tm, 0.005::DOUBLE AS cf FROM region UNION ALL SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 8, '0'), 'r' || lpad(CAST(n_regionkey AS VARCHAR), 8, '0'), {sql_content('n_name')}, 0.007::DOUBLE FROM nation
  UNION ALL SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 8, '0'), 'n' || lpad(CAST(c_nationkey AS VARCHAR), 8, '0'), {sql_content('c_mktsegment')}, 0.009::DOUBLE FROM customer),
 s AS (SELECT query_id, node_id, parent_id, round(4.0::DOUBLE * len(list_intersect(tm, qt)) / greatest(1, len(qt)) + cf, 6) AS score FROM q, nd),
 l0 AS (SELECT query_id, node_id, score FROM s WHERE parent_id IS NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 2),
 l1 AS (SELECT s.* FROM s JOIN l0 ON s.query_id = l0.query_id AND s.parent_id = l0.node_id QUALIFY row_number() OVER (PARTITION BY s.query_id, s.parent_id ORDER BY s.score DESC, s.node_id) <= 4 AND (s.score > 0.011 OR count(*) FILTER (s.score > 0.011) OVER (PARTITION BY s.query_id, s.parent_id) = 0)),
 l2 AS (SELECT s.* FROM s JOIN l1 ON s.query_id = l1.query_id AND s.parent_id = l1.node_id QUALIFY row_number() OVER (PARTITION BY s.query_id, s.parent_id ORDER BY s.score DESC, s.node_id) <= 4 AND (s.score > 0.011 OR count(*) FILTER (s.score > 0.011) OVER (PARTITION BY s.query_id, s.parent_id) = 0))
 SELECT query_id, node_id, 0 AS depth, score FROM l0 UNION ALL SELECT query_id, node_id, 1, score FROM l1 UNION ALL SELECT query_id, node_id, 2, score FROM l2""",
    "st_affected": f"WITH {_TREE}, b AS (SELECT c AS leaf, p FROM t WHERE c LIKE 'c%' AND CAST(substr(c, 2) AS INT) % 20 = 0), a AS (SELECT leaf, p AS node_id FROM b UNION ALL SELECT leaf, t.p FROM b JOIN t ON t.c = b.p) SELECT node_id, count(*) AS changed_leaves FROM a GROUP BY ALL",
    "rt_owner_terminals": f"WITH {FACTS} SELECT owner_id, binding_id, row_number() OVER (PARTITION BY owner_id ORDER BY value_key DESC, binding_id) AS rank FROM facts QUALIFY rank <= 20",
    "rt_node_paths": """WITH RECURSIVE q AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS c FROM lineitem GROUP BY ALL), e AS (SELECT 'p' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS a, 's' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS b FROM q QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY c DESC, l_suppkey) <= 4), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 w AS (SELECT DISTINCT a AS source_id, a AS node_id, 0 AS hops, a AS path FROM u WHERE a LIKE 'p%' AND CAST(substr(a, 2) AS INT) % 20 = 0 UNION ALL SELECT source_id, u.b, hops + 1, path || '>' || u.b FROM w JOIN u ON u.a = w.node_id WHERE hops < 2)
 SELECT source_id, node_id, min((hops, path))[1] AS hops, min((hops, path))[2] AS path FROM w GROUP BY source_id, node_id""",
    "rt_provenance": f"WITH {LATE}, a AS (SELECT DISTINCT question_id, unnest(evidence_turn_ids) AS turn_id FROM answers) SELECT question_id, count(*) AS turns, min(turn_no) AS first_no FROM a JOIN late USING (turn_id) GROUP BY ALL",
    "rt_speaker_bonus": f"WITH {SQ._BASE} SELECT query_id, count(*) AS bonus_turns FROM qt JOIN turns ON memory_id = scope AND lower(speaker) = term WHERE lower(speaker) NOT IN ('user', 'assistant', 'system', 'tool') GROUP BY ALL",
    "rt_manifest_match": f"WITH {FACTS}, {ASKS} SELECT memory_id, owner_id, predicate, collection_key, count(*) AS member_count FROM facts JOIN asks USING (memory_id) GROUP BY memory_id, owner_id, predicate, collection_key HAVING coalesce(bool_or(predicate = asked_predicate), false) OR coalesce(bool_or(collection_key = asked_collection), false) OR coalesce(bool_or(value_key = asked_value), false)",
    "rt_fact_reservoir": f"WITH {_RES} SELECT memory_id, binding_id, rrf, rank FROM rr",
    "rt_active_facts": f"WITH {_RES} SELECT memory_id, operand_id, binding_id, row_number() OVER (PARTITION BY memory_id, operand_id ORDER BY rank) AS k FROM rr QUALIFY k <= 8",
    "rt_seed": f"WITH {SQ._CHANNELS}, g AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf FROM c GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rank FROM g QUALIFY rank <= 20",
    "rt_session_router": "WITH b AS (" + SQ.SQL["topk_bm25"] + "), sb AS (" + SQ.SQL["topk_session_bm25"] + ") SELECT b.query_id, b.id FROM b JOIN turns ON turn_no = b.id JOIN sb ON sb.query_id = b.query_id AND sb.id = session_id AND sb.rank <= 2",
    "rt_session_flood": "WITH sb AS (" + SQ.SQL["topk_session_bm25"] + ") SELECT query_id, turn_no FROM sb JOIN questions q ON question_id = query_id JOIN turns t ON t.memory_id = q.memory_id AND t.session_id = sb.id WHERE rank = 1",
    "rt_ledger": "WITH c AS (" + SQ.SQL["num_coverage"] + "), s AS (SELECT query_id, id, round(2 * coverage + CASE WHEN regexp_matches(raw_text, '[0-9]') THEN 0.5::DOUBLE ELSE 0 END + 0.3::DOUBLE / row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, id), 6) AS score FROM c JOIN turns ON turn_no = id) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 12",
    "gb_knn_pairs": "WITH n AS (" + SQ._DENSE.format("").replace("rank <= 10", "rank <= 1000000000") + "), k AS (SELECT query_id, id, score FROM n JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = id WHERE a.label <> b.label QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5) SELECT least(query_id, id) AS a, greatest(query_id, id) AS b, max(score) AS score FROM k GROUP BY ALL",
    "pack_render": f"WITH {_CAND}, r AS (SELECT query_id, id, row_number() OVER w AS place, CAST(sum(token_cost) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used_tokens FROM cand WINDOW w AS (PARTITION BY query_id ORDER BY mandatory DESC, fused DESC, id)) SELECT * FROM r WHERE used_tokens <= 150",
    "gb_rare_terms": f"WITH {_RARE} SELECT memory_id, term, df FROM rare",
    "gb_entities": f"""WITH t AS (SELECT DISTINCT memory_id, session_id, turn_no, unnest(list_transform(list_filter(regexp_extract_all(raw_text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[A-Z][a-z]{{2,}}$')), lambda w: lower(w))) AS name FROM turns)
 SELECT memory_id, name, count(DISTINCT session_id) AS sessions, min(turn_no) AS first_no FROM t WHERE name NOT IN ({", ".join(f"'{s}'" for s in STOP_NAMES)}) GROUP BY ALL""",
    "gb_facts_lean": f"WITH {FACTS}, {_CHAINS} SELECT owner_id AS src, 'HAS_FACT' AS relation, binding_id::VARCHAR AS dst FROM facts UNION ALL SELECT binding_id::VARCHAR, 'MEMBER_OF', owner_id || ':' || collection_key FROM facts UNION ALL SELECT binding_id::VARCHAR, 'STATE_NEXT', next_id::VARCHAR FROM n WHERE next_id IS NOT NULL AND value_key <> next_value",
    "gb_portals": "WITH s AS (SELECT DISTINCT memory_id, session_id, ordinal FROM sessions) SELECT memory_id, session_id, lead(session_id) OVER (PARTITION BY memory_id ORDER BY ordinal, session_id) AS next_session FROM s QUALIFY next_session IS NOT NULL",
    "gb_rel_scores": f"WITH {_PAIRS} SELECT * FROM sc",
    "gb_rel_mask": f"WITH {_PAIRS} SELECT u, concat_ws(',', CASE WHEN entity >= 0.25 THEN 'SHARED_ENTITY' END, CASE WHEN state >= 0.45 THEN 'STATE_COMPATIBLE' END, CASE WHEN near >= exp(-2.0::DOUBLE) THEN 'TEMPORAL_NEAR' END) AS signals FROM sc",
    "gb_rel_gate": f"WITH {_PAIRS} SELECT u, round(greatest(0.82::DOUBLE + 0.16::DOUBLE * entity, 0.54::DOUBLE + 0.20::DOUBLE * near, 0.80::DOUBLE + 0.18::DOUBLE * state, 0), 6) AS gate FROM sc",
    "gb_sparse_pairs": f"WITH {_SPARSE} SELECT * FROM sp",
    "gb_canonicalize": """WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), s AS (SELECT a.id AS query_id, b.id AS id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id WHERE a.id % 20 = 0),
 n AS (SELECT query_id, id FROM s WHERE score >= 0.25 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 3), e AS (SELECT query_id AS a, id AS b FROM n UNION SELECT id, query_id FROM n), c AS (SELECT a AS node, a AS seen FROM e UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.seen) SELECT node, min(seen) AS component FROM c GROUP BY node""",
    "gb_semantic_validate": """WITH a AS (SELECT answer_no, answer_model AS o, CASE WHEN answer_no % 9 <> 0 THEN 'says' END AS p, prediction AS v, evidence_turn_ids AS e, evidence_tokens % 12 / 10.0::DOUBLE AS c, row_number() OVER (PARTITION BY question_id ORDER BY evidence_tokens % 12 / 10.0::DOUBLE DESC NULLS LAST, answer_no) AS k FROM answers)
 SELECT answer_no AS fact_no, CASE WHEN coalesce(trim(o, ' ') = '', true) THEN 'owner' WHEN p IS NULL THEN 'predicate' WHEN coalesce(trim(v, ' ') = '', true) THEN 'value' WHEN coalesce(len(e), 0) < 1 THEN 'evidence' WHEN NOT coalesce(c BETWEEN 0 AND 1, false) THEN 'confidence' WHEN k > 5 THEN 'cap' END AS problem FROM a""",
    "gb_span_resolve": """WITH q AS (SELECT question_id, lower(gold_answer) AS g, regexp_extract_all(question, '[\\p{L}\\p{N}]+') AS w FROM questions WHERE gold_answer IS NOT NULL), p AS (SELECT *, instr(g, lower(w[-1])) AS a, instr(g, lower(w[1])) AS b FROM q)
 SELECT question_id, CAST(CASE WHEN a > 0 THEN a - 1 WHEN b > 0 THEN b - 1 END AS INT) AS start, CAST(CASE WHEN a > 0 THEN a - 1 + length(w[-1]) WHEN b > 0 THEN b - 1 + length(w[1]) END AS INT) AS "end", CASE WHEN a > 0 THEN 'quote' WHEN b > 0 THEN 'value' END AS how FROM p""",
    "gb_fact_dedup": f"WITH {FACTS} SELECT owner_id AS owner, predicate, value_key AS value, polarity, session_id AS evidence, round(max(turn_index / 10.0::DOUBLE), 4) AS confidence, coalesce(array_to_string(list_sort(list(DISTINCT event_instance_id) FILTER (event_instance_id IS NOT NULL)), ','), '') AS unit_ids, min(binding_id) AS fact_no FROM facts GROUP BY owner_id, predicate, value_key, polarity, session_id",
    "gb_unit_coverage": "WITH u AS (SELECT turn_no, unnest(string_split(raw_text, ' ')) AS w, generate_subscripts(string_split(raw_text, ' '), 1) - 1 AS k FROM turns) SELECT turn_no, count(*) AS open_units FROM u WHERE regexp_matches(w, '^[0-9]+$') AND k >= 10 GROUP BY ALL",
    "gb_routing_card": f"WITH {_RARE} SELECT memory_id, term, df FROM rare QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY df, term) <= 64",
    "map_child_postings": f"WITH {_WORDS} SELECT memory_id, term, string_agg(session_id, ',' ORDER BY session_id) AS children FROM w GROUP BY ALL HAVING count(*) BETWEEN 2 AND 6",
    "st_hwm": "SELECT user_id % 20 AS memory_id, max(event_id) AS \"offset\" FROM events WHERE event_type <> 'error' GROUP BY ALL",
    "id_stable": "SELECT question_id, 'query:' || substr(sha256('query|' || memory_id || '|' || question_id), 1, 32) AS stable_id FROM questions",
    "rt_priority_expand": f"WITH {_EXPAND} SELECT * FROM ex",
    "rt_schedule": f"""WITH {_EXPAND}, hold AS (SELECT query_id, node_id, place, unnest(terms) AS term FROM ex JOIN pt ON node = node_id WHERE hops > 0), wt AS (SELECT 'q' || node AS query_id, unnest(terms) AS term FROM pt), fi AS (SELECT query_id, term, min(place) AS place FROM hold JOIN wt USING (query_id, term) GROUP BY ALL), pv AS (SELECT query_id, place, count(*) AS proves FROM fi GROUP BY ALL)
 SELECT query_id, node_id, hops, coalesce(proves, 0) AS proves, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(proves, 0) DESC, place) AS turn FROM ex LEFT JOIN pv USING (query_id, place) QUALIFY turn <= 10""",
    "pack_rank": f"WITH {_RANK_PACK} SELECT * FROM pack",
    "pack_units": f"WITH RECURSIVE {_CAND}, {_O.format(_EVERY.format('CASE WHEN mandatory THEN 0 ELSE 1 END'))}, {_FOLD} SELECT * FROM pack",
    "pack_obligation": f"WITH {_DUTY_PACK} SELECT * FROM pack",
    "pack_set_cover": f"""WITH RECURSIVE {_CAND}, kd AS (SELECT question_id AS query_id, CASE WHEN is_count OR is_list THEN 0.9::DOUBLE ELSE 0.2::DOUBLE END AS new FROM ({_SLOTS})),
 st AS (SELECT query_id, list(struct_pack(id := id, fused := fused, cost := token_cost, slots := slots, session := coalesce(session_id, ''), new := new)) AS items FROM cand JOIN kd USING (query_id) GROUP BY query_id),
 fold AS (SELECT query_id, items AS lft, []::BIGINT[] AS got, []::VARCHAR[] AS covered, []::VARCHAR[] AS sessions, 0::BIGINT AS tokens, NULL::BIGINT AS id, false AS took FROM st
 UNION ALL SELECT query_id, list_filter(lft, lambda x: x.id <> b.x.id), CASE WHEN t THEN list_append(got, b.x.id) ELSE got END, CASE WHEN t THEN list_distinct(list_concat(covered, b.x.slots)) ELSE covered END, CASE WHEN t THEN list_append(sessions, b.x.session) ELSE sessions END, CASE WHEN t THEN tokens + b.x.cost ELSE tokens END, b.x.id, t
 FROM (SELECT *, tokens + b.x.cost <= 150 AS t FROM (SELECT *, list_sort(list_transform(lft, lambda x: struct_pack(u := round(x.fused + 1.25::DOUBLE * len(list_filter(x.slots, lambda v: NOT list_contains(covered, v))) + CASE WHEN list_contains(sessions, x.session) THEN 0::DOUBLE ELSE x.new END - 0.0005::DOUBLE * x.cost, 9), f := x.fused, i := x.id, x := x)))[-1] AS b FROM fold WHERE len(lft) > 0 AND len(got) < 6)))
 SELECT query_id, id, CAST(len(got) AS INT) AS place, tokens AS used_tokens FROM fold WHERE took""",
    "rt_topology_layout": f"WITH {_RANK_PACK}, b AS (SELECT query_id, id, turn_index, session_id, min(place) OVER (PARTITION BY query_id, session_id) AS best FROM pack JOIN turns ON turn_no = id) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY best, session_id, turn_index NULLS FIRST, id) AS line FROM b",
    "rt_navigate": f"""WITH {_DUTY_PACK}, kd AS (SELECT question_id AS query_id, {SQL_KIND} AS kind FROM ({_SLOTS})), ow AS (SELECT query_id, count(DISTINCT owner) AS owners FROM ({{0}}) GROUP BY ALL), sd AS (SELECT query_id, count(*) AS seeds FROM cand GROUP BY ALL), pz AS (SELECT query_id, count(*) AS turns, max(used_tokens) AS tokens FROM pack GROUP BY ALL),
 ht AS (SELECT DISTINCT query_id, unnest({sql_content('raw_text')}) AS term FROM pack JOIN turns ON turn_no = id), cv AS (SELECT query_id, count(*) AS covered FROM ht JOIN qt USING (query_id, term) GROUP BY ALL)
 SELECT query_id, kind, coalesce(owners, 0) AS owners, coalesce(seeds, 0) AS seeds, coalesce(turns, 0) AS turns, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, coalesce(covered, 0) AS covered, coalesce(covered, 0) >= len(words) AS complete FROM q JOIN kd USING (query_id) LEFT JOIN ow USING (query_id) LEFT JOIN sd USING (query_id) LEFT JOIN pz USING (query_id) LEFT JOIN cv USING (query_id)""".replace("{0}", SQL_OWNERS),
    "gb_hierarchy": f"""WITH t AS (SELECT memory_id, session_id, unnest(list_distinct({sql_content('raw_text')})) AS term FROM turns), n AS (SELECT memory_id, session_id, term, count(*) AS n FROM t GROUP BY ALL), g AS (SELECT memory_id, session_id, arg_min(term, (-n, term)) AS sg FROM n GROUP BY ALL),
 l AS (SELECT DISTINCT memory_id, session_id FROM turns), r AS (SELECT memory_id, session_id, row_number() OVER (PARTITION BY memory_id ORDER BY sg NULLS LAST, session_id) - 1 AS p, count(*) OVER (PARTITION BY memory_id) AS n FROM l LEFT JOIN g USING (memory_id, session_id)),
 k AS (SELECT *, unnest(range(1, 20)) AS level FROM r), v AS (SELECT * FROM k WHERE level = 1 OR pow(8, level - 1) < n), f AS (SELECT memory_id, session_id, p, CAST(level AS INT) AS level, CAST(pow(8, level) AS BIGINT) AS wide, CAST(pow(8, level - 1) AS BIGINT) AS low FROM v)
 SELECT memory_id, 'card' || lpad(CAST(level AS VARCHAR), 2, '0') || ':' || lpad(CAST(p // wide AS VARCHAR), 9, '0') AS parent_id, CASE WHEN level = 1 THEN session_id ELSE 'card' || lpad(CAST(level - 1 AS VARCHAR), 2, '0') || ':' || lpad(CAST(p // low AS VARCHAR), 9, '0') END AS child_id, level FROM f WHERE p % low = 0""",
    "gb_segment": f"""WITH RECURSIVE {LATE}, t AS (SELECT memory_id, session_id, turn_no, lower(trim(role)) AS role, speaker, listener, list_distinct({sql_content("coalesce(raw_text, '')")}) AS tm, list_transform(list_filter(regexp_extract_all(coalesce(raw_text, ''), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[A-Z][a-z]{{2,}}$') AND NOT list_contains([{", ".join(f"'{x}'" for x in STOP_NAMES)}], lower(w))), lambda w: lower(w)) AS nm, row_number() OVER (PARTITION BY memory_id, session_id ORDER BY turn_index NULLS LAST, turn_no) AS rk FROM late),
 g AS (SELECT memory_id, session_id, turn_no, rk, list_distinct(list_concat(coalesce(lag(tm, 1) OVER w, []), coalesce(lag(tm, 2) OVER w, []))) AS rc, tm, coalesce(lag(role) OVER w <> role AND lag(listener) OVER w = speaker, false) AS ans, coalesce({", ".join(f"CASE WHEN list_has_any(nm, lag(nm, {k}) OVER w) THEN {k} END" for k in range(1, 13))}) AS back FROM t WINDOW w AS (PARTITION BY memory_id, session_id ORDER BY rk)),
 h AS (SELECT memory_id, session_id, turn_no, rk, back, len(list_intersect(tm, rc)) / greatest(1, len(list_distinct(list_concat(tm, rc)))) < 0.55 AND NOT ans AS quiet FROM g),
 r AS (SELECT memory_id, session_id, turn_no, rk, 1 AS n, 0 AS scene FROM h WHERE rk = 1 UNION ALL SELECT h.memory_id, h.session_id, h.turn_no, h.rk, CASE WHEN x THEN 1 ELSE n + 1 END, CASE WHEN x THEN scene + 1 ELSE scene END
  FROM (SELECT h.*, r.n, r.scene, r.n >= 12 OR (r.n >= 4 AND h.quiet AND (h.back IS NULL OR h.back > r.n)) AS x FROM r JOIN h ON h.memory_id IS NOT DISTINCT FROM r.memory_id AND h.session_id IS NOT DISTINCT FROM r.session_id AND h.rk = r.rk + 1) h),
 z0 AS (SELECT memory_id, session_id, scene, count(*) AS n FROM r GROUP BY ALL), z AS (SELECT *, max(scene) OVER (PARTITION BY memory_id, session_id) AS last FROM z0), y AS (SELECT memory_id, session_id, last AS scene FROM z WHERE scene >= last - 1 AND last > 0 GROUP BY memory_id, session_id, last HAVING max(CASE WHEN scene = last THEN n END) < 4 AND sum(n) <= 12)
 SELECT r.memory_id, r.session_id, turn_no, CAST(r.scene - CASE WHEN y.scene IS NULL THEN 0 ELSE 1 END AS INT) AS scene FROM r LEFT JOIN y ON y.memory_id IS NOT DISTINCT FROM r.memory_id AND y.session_id IS NOT DISTINCT FROM r.session_id AND y.scene = r.scene""",
    "gb_merge_aliases": f"""WITH n AS (SELECT memory_id, count(DISTINCT coalesce(session_id, '')) AS sessions FROM turns WHERE regexp_matches(raw_text, '[\\p{{L}}\\p{{N}}_''-]') GROUP BY ALL), s AS (SELECT DISTINCT memory_id, session_id, unnest(regexp_extract_all(raw_text, '[\\p{{L}}\\p{{N}}_''-]+')) AS surface FROM turns),
 b AS (SELECT *, regexp_replace(regexp_replace(lower(surface), '''s$', ''), 's''$', '') AS w FROM s WHERE lower(surface) NOT IN ({", ".join(f"'{x}'" for x in ARTICLES)})), k AS (SELECT *, CASE WHEN length(w) > 4 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, length(w) - 1) ELSE w END AS key FROM b),
 g AS (SELECT memory_id, key, count(DISTINCT session_id) AS spread, list_sort(list(DISTINCT lower(surface))) AS forms FROM k WHERE length(key) >= 3 GROUP BY ALL) SELECT memory_id, key, array_to_string(forms, '|') AS forms FROM g JOIN n USING (memory_id) WHERE spread BETWEEN 2 AND greatest(2, floor(sessions * 0.5::DOUBLE)) AND len(forms) >= 2""",
    "rt_seed_narrow": f"WITH {SQ._CHANNELS}, nx AS (SELECT * FROM {SQ._TOP.format('ex').replace('<= 10', '<= 8')} UNION ALL SELECT * FROM {SQ._TOP.format('bm').replace('<= 10', '<= 24')}), g AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf FROM nx GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rank FROM g QUALIFY rank <= 96",
    "sv_focus": f"WITH hit AS (" + SQ.SQL["topk_bm25"] + f"), {SQ._BASE}, s0 AS (SELECT turn_no, list_filter(list_transform(regexp_extract_all(raw_text, '[^.!?\\n]+[.!?]*'), lambda s: regexp_replace(s, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda s: s <> '') AS ss FROM turns WHERE raw_text IS NOT NULL), sd AS (SELECT turn_no, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos FROM s0), wd AS (SELECT turn_no, pos, unnest(list_distinct({sql_content('sentence')})) AS term FROM sd), sc AS (SELECT hit.query_id, turn_no, pos, round(sum(ln(1 + (total - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))), 6) AS score FROM hit JOIN wd ON turn_no = hit.id JOIN qt ON qt.query_id = hit.query_id AND qt.term = wd.term JOIN df ON df.scope = qt.scope AND df.term = qt.term JOIN sz ON sz.scope = qt.scope GROUP BY ALL) SELECT query_id, turn_no, CAST(pos AS INT) AS pos, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, turn_no, pos) AS k FROM sc QUALIFY k <= 3",
}
