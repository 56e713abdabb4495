"""Queries of filters, joins, aggregates and windows over facts, turns and answers, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions.text import content_terms
from turnloom.operators import facts as O
from turnloom.plans.lineage import cut, ranked
from turnloom.plans.text_queries import sql_content
from turnloom.sources.canonical import ASKS, FACTS, asks, facts
from turnloom.sources.tables import table

ONE_CHAIN = ["owner_id", "predicate"]


def flt_lookup_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The first five purchases or clicks of each owner, by asked predicate."""
    rows = facts(spark, folder)
    asked = rows.select("owner_id").distinct().withColumn("wanted", F.explode(F.array(F.lit("purchase"), F.lit("click now"))))
    return O.lookup_facts(rows, asked, 5).select("owner_id", "wanted", "binding_id", "rank")


def flt_owner_pred(spark: SparkSession, folder: str) -> DataFrame:
    """Postings of (owner, predicate)."""
    return facts(spark, folder).groupBy("memory_id", "owner_id", "predicate").agg(F.count(F.lit(1)).alias("n"), F.min("binding_id").alias("first_id"))


def flt_lookup_collections(spark: SparkSession, folder: str) -> DataFrame:
    """Collections of an owner with the predicate asked of its memory, three of most members."""
    f = facts(spark, folder).join(asks(spark, folder), "memory_id").where("predicate = asked_predicate")
    c = f.groupBy("owner_id", "collection_key").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("owner_id").orderBy(F.col("n").desc(), "collection_key")
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 3")


def flt_keep_fact(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as facts (speaker says text): which say something."""
    a = table(spark, folder, "answers", "answer_no", "prediction", "finish_reason")
    predicate = F.when(F.col("answer_no") % 7 == 0, "shared a photo").otherwise(F.coalesce("finish_reason", F.lit("is")))
    return a.select("answer_no", O.keep_fact(predicate, F.coalesce(F.when(F.col("answer_no") % 5 == 0, "Yes").otherwise(F.col("prediction")), F.lit(""))).alias("kept"))


def _signals() -> dict:
    return {
        "owner": F.col("owner_id") == F.col("asked_owner"), "predicate": F.col("predicate") == F.col("asked_predicate"), "scope": F.col("collection_key") == F.col("asked_collection"),
        "value_type": F.col("value_type") == "number", "temporal": F.coalesce(F.col("ts") < F.col("asked_ts"), F.lit(False)), "session": F.coalesce(F.col("session_id") == F.date_format("asked_ts", "yyyy-MM-dd"), F.lit(False)),
    }


def flt_binding_veto(spark: SparkSession, folder: str) -> DataFrame:
    """The first hard conflict of each fact with what is asked of its memory: another owner, negation, a mere plan, another type, a later time."""
    v = O.veto(F.col("owner_id") != F.col("asked_owner"), F.col("polarity") == "negative", F.col("modality") == "planned", F.col("value_type") == "number", F.col("ts") > F.col("asked_ts"))
    return facts(spark, folder).join(asks(spark, folder), "memory_id").select("binding_id", v.alias("veto"))


def flt_accept(spark: SparkSession, folder: str) -> DataFrame:
    """Facts by the signals they share with what is asked of their memory."""
    s = _signals()
    return facts(spark, folder).join(asks(spark, folder), "memory_id").select("binding_id", F.round(O.signal_score(s), 4).alias("score"), O.accepted(s).alias("accepted"))


def flt_admissible(spark: SparkSession, folder: str) -> DataFrame:
    """Why a fact is admitted: its owner is the asked one, or it is among the 32 last facts of its memory (its source rank), which overrides another owner."""
    f = facts(spark, folder)
    w = Window.partitionBy("memory_id").orderBy(F.col("ts").desc_nulls_last(), F.col("binding_id").desc())
    near = f.select("memory_id", "binding_id", F.row_number().over(w).alias("k")).where("k <= 32").select("binding_id", F.lit(True).alias("near"))
    rows = f.join(asks(spark, folder), "memory_id").join(near, "binding_id", "left")
    code = F.when(F.col("owner_id") == F.col("asked_owner"), "owner").when(F.coalesce("near", F.lit(False)), "source_rank").when(F.col("polarity") == "negative", "rejected_polarity").otherwise("rejected_owner")
    return rows.select("binding_id", code.alias("reason"), code.isin("owner", "source_rank").alias("admitted"))


def flt_alias(spark: SparkSession, folder: str) -> DataFrame:
    """Speakers fit for an alias: three letters or more, no function or role word."""
    t = table(spark, folder, "turns", "speaker").where("speaker is not null").select(F.lower(F.trim("speaker")).alias("alias")).distinct()
    return t.where((F.length("alias") >= 3) & ~F.col("alias").isin("user", "assistant", "system", "tool", "the", "you"))


def flt_authoritative(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of a user or of a named speaker."""
    t = table(spark, folder, "turns", "turn_no", "role", "speaker")
    role, speaker = F.lower(F.trim("role")), F.lower(F.trim("speaker"))
    return t.where(F.coalesce(role.isin("user", "human"), F.lit(False)) | F.coalesce(~speaker.isin("user", "assistant", "system", "tool", ""), F.lit(False))).select("turn_no")


def flt_promotable_value(spark: SparkSession, folder: str) -> DataFrame:
    """Answers short and plain enough to stand as an object: one to four words, no sentence, not only digits."""
    q = table(spark, folder, "answers", "answer_no", "prediction").where("prediction is not null")
    g = F.trim("prediction")
    n = F.size(F.regexp_extract_all(g, F.lit(r"[\p{L}\p{N}_'-]+"), F.lit(0)))
    return q.where(n.between(1, 4) & ~g.rlike(r"[.!?;:]$") & ~g.rlike(r"^[0-9 .,$€£%]+$")).select("answer_no", g.alias("value"))


def prj_binding(spark: SparkSession, folder: str) -> DataFrame:
    return facts(spark, folder).select("binding_id", "operand_id", "owner_id", "predicate", F.lower("value_key").alias("value_key"), "turn_index", F.sha2(F.concat_ws("|", F.lit("binding"), "operand_id", F.col("binding_id").cast("string")), 256).substr(1, 32).alias("stable_id"))


def prj_reservoir_row(spark: SparkSession, folder: str) -> DataFrame:
    return facts(spark, folder).where("polarity = 'positive'").select("memory_id", "binding_id", "owner_id", "predicate")


def join_turn_group_fact(spark: SparkSession, folder: str) -> DataFrame:
    """Answers cite turns: each turn with the best place at which any answer of its question cites it."""
    a = table(spark, folder, "answers", "question_id", "evidence_turn_ids").select("question_id", F.posexplode("evidence_turn_ids").alias("place", "turn_id"))
    t = table(spark, folder, "turns", "turn_id", "session_id").distinct()
    return a.groupBy("question_id", "turn_id").agg(F.min("place").alias("best_place")).join(t, "turn_id")


def join_owner_alias(spark: SparkSession, folder: str) -> DataFrame:
    """Speakers of a memory named in its questions, matched by token, not by substring scan."""
    q = table(spark, folder, "questions", "question_id", "memory_id", "question")
    words = q.select("question_id", "memory_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0)))).alias("alias"))
    named = table(spark, folder, "turns", "memory_id", "speaker").where("speaker is not null").select("memory_id", F.lower("speaker").alias("alias")).distinct()
    return words.join(named.where(F.length("alias") > 2), ["memory_id", "alias"]).select("question_id", "alias")


def _graph(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem", "l_partkey", "l_suppkey").distinct()
    return li.select(F.concat(F.lit("p"), F.col("l_partkey")).alias("src_id"), F.lit("SUPPLIED_BY").alias("relation"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst_id"))


def join_adjacency(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours in both directions of each node."""
    e = _graph(spark, folder)
    both = e.select(F.col("src_id").alias("node"), F.col("dst_id").alias("next"), F.lit(False).alias("inverse")).unionByName(e.select(F.col("dst_id").alias("node"), F.col("src_id").alias("next"), F.lit(True).alias("inverse")))
    return both.groupBy("node", "inverse").agg(F.count_distinct("next").alias("degree"), F.min("next").alias("first_next"))


def _late(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "turns", "turn_no", "turn_id", "memory_id", "session_id", "turn_index", "speaker", "role", "ingested_at")
    return O.last_per_key(t, ["turn_id"], ["ingested_at", "turn_no"])


def join_neighbor_turn(spark: SparkSession, folder: str) -> DataFrame:
    """Turns within two of a seed (turn_no divisible by 20) score 0.35 by distance; the best score holds."""
    t = _late(spark, folder)
    seeds = t.where("turn_no % 20 = 0").select("memory_id", "session_id", F.explode(F.array(*[F.struct((F.col("turn_index") + d).alias("turn_index"), F.lit(0.35 / abs(d)).alias("score")) for d in (-2, -1, 1, 2)])).alias("x")).select("memory_id", "session_id", "x.*")
    return seeds.join(t, ["memory_id", "session_id", "turn_index"]).groupBy("turn_no").agg(F.round(F.max("score"), 6).alias("score"))


def _in_session() -> Window:
    return Window.partitionBy("memory_id", "session_id").orderBy("turn_index", "turn_no")


def join_dialogue(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn with the next turn of another speaker directly after it."""
    t = _late(spark, folder).select("turn_no", "memory_id", "session_id", "turn_index", "speaker", F.lead("turn_no").over(_in_session()).alias("reply_no"), F.lead("speaker").over(_in_session()).alias("reply_speaker"))
    return t.where("reply_no is not null and reply_speaker <> speaker").select("turn_no", "reply_no")


def win_lead_turns(spark: SparkSession, folder: str) -> DataFrame:
    return _late(spark, folder).select("turn_no", F.lag("turn_no").over(_in_session()).alias("before_no"), F.lead("turn_no").over(_in_session()).alias("after_no"))


def join_interval_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Of each owner's purchase span, how many owners' view spans of the memory overlap it.

    Spans overlap unless one ends before the other starts, so two counts over the sorted ends do: no pair is
    made.  The places of starts and ends come from ranges, not from one task a memory.
    """
    f = facts(spark, folder).where("ts is not null")
    span = f.where("operand_id = 'o1'").groupBy("memory_id", "owner_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    other = f.where("operand_id = 'o2'").groupBy("memory_id", F.col("owner_id").alias("other_id")).agg(F.min("ts").alias("start2"), F.max("ts").alias("end2"))
    none = F.lit(None).cast("string")
    # Ends of the others before a start, and starts of the others up to an end: on a tie a span's start stands before an end, and an end behind a start.
    ended = span.select("memory_id", "owner_id", F.col("start").alias("at"), F.lit(0).alias("kind")).unionByName(other.select("memory_id", none.alias("owner_id"), F.col("end2").alias("at"), F.lit(1).alias("kind")))
    begun = span.select("memory_id", "owner_id", F.col("end").alias("at"), F.lit(1).alias("kind")).unionByName(other.select("memory_id", none.alias("owner_id"), F.col("start2").alias("at"), F.lit(0).alias("kind")))

    def before(rows: DataFrame, name: str) -> DataFrame:
        """How many of the others stand before each span of an owner: its place among all less its place among the spans."""
        kept = cut(rows.withColumn("no", F.monotonically_increasing_id()))
        order = [F.col("at"), F.col("kind"), F.col("no")]
        every = ranked(kept, ["memory_id"], order, "place")
        own = ranked(every.where("owner_id is not null"), ["memory_id"], order, "mine")
        return own.select("memory_id", "owner_id", (F.col("place") - F.col("mine")).alias(name))

    both = before(begun, "begun").join(before(ended, "ended"), ["memory_id", "owner_id"])
    return both.groupBy("owner_id").agg(F.sum(F.col("begun") - F.col("ended")).alias("overlaps")).where("overlaps > 0")


def join_before(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours in a chain of which the first ends before the second begins."""
    n = O.next_in_chain(facts(spark, folder).where("ts is not null"), ONE_CHAIN)
    return n.where("ts < next_ts").select("binding_id", "next_id")


def win_state_next(spark: SparkSession, folder: str) -> DataFrame:
    n = O.next_in_chain(facts(spark, folder), ONE_CHAIN)
    return n.where("next_id is not null and value_key <> next_value").select("binding_id", "next_id")


def join_shared_value(spark: SparkSession, folder: str) -> DataFrame:
    return O.shared_values(facts(spark, folder)).select("binding_id", "other_id")


def join_scene_referent(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of one memory that share two rare terms or more (in 2 to 64 sessions), the six nearest of each by idf.

    A rare term's sessions are one array of 64 at most, and its pairs are made inside the row: one shuffle by
    term and one by pair.
    """
    t = table(spark, folder, "turns", "memory_id", "session_id", "raw_text")
    w = cut(t.select("memory_id", "session_id", F.explode(content_terms(F.col("raw_text"))).alias("term")).distinct())
    df = w.groupBy("memory_id", "term").agg(F.count(F.lit(1)).alias("df")).where("df between 2 and 64")
    n = w.select("memory_id", "session_id").distinct().groupBy("memory_id").agg(F.count(F.lit(1)).alias("n"))
    rare = w.join(df, ["memory_id", "term"]).groupBy("memory_id", "term", "df").agg(F.collect_list("session_id").alias("s")).join(n, "memory_id")
    one = rare.select("memory_id", "s", F.log(1 + F.col("n") / F.col("df")).alias("idf"), F.explode("s").alias("session_id"))
    pairs = one.select("memory_id", "session_id", "idf", F.explode("s").alias("other_session")).where("session_id <> other_session")
    scored = pairs.groupBy("memory_id", "session_id", "other_session").agg(F.count(F.lit(1)).alias("shared"), F.round(F.sum("idf"), 6).alias("score")).where("shared >= 2")
    rank = F.row_number().over(Window.partitionBy("memory_id", "session_id").orderBy(F.col("score").desc(), "other_session"))
    return scored.withColumn("rank", rank).where("rank <= 6")


def join_semi_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases kept only if in a collection of three or more."""
    f = facts(spark, folder).where("operand_id = 'o1'")
    big = f.groupBy("owner_id", "collection_key").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return f.join(big, ["owner_id", "collection_key"], "left_semi").select("binding_id")


def join_anti_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of cited sessions that no answer cites."""
    cited = table(spark, folder, "answers", "evidence_turn_ids").select(F.explode("evidence_turn_ids").alias("turn_id")).distinct()
    return table(spark, folder, "turns", "turn_id").distinct().join(cited, "turn_id", "left_anti")


def join_paired(spark: SparkSession, folder: str) -> DataFrame:
    """First and last answer of each question side by side, and whether they differ."""
    a = table(spark, folder, "answers", "question_id", "answer_no", "prediction")
    first = a.groupBy("question_id").agg(F.min_by("prediction", "answer_no").alias("base"), F.min("answer_no").alias("base_no"))
    last = a.groupBy("question_id").agg(F.max_by("prediction", "answer_no").alias("candidate"), F.max("answer_no").alias("candidate_no"))
    return first.join(last, "question_id", "full").select("question_id", "base_no", "candidate_no", (~F.col("base").eqNullSafe(F.col("candidate"))).alias("changed"))


def join_hierarchy_cross(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of regions that survived the gate (the next one and the one after) open their nations against each other, by equal keys."""
    nation = table(spark, folder, "nation", "n_nationkey", "n_regionkey")
    left = nation.select(F.col("n_nationkey").alias("left_id"), F.explode(F.array(F.col("n_regionkey") + 1, F.col("n_regionkey") + 2)).alias("b"))
    right = nation.select(F.col("n_regionkey").alias("b"), F.col("n_nationkey").alias("right_id"))
    return left.join(right, "b").select("left_id", "right_id")


def join_embedding(spark: SparkSession, folder: str) -> DataFrame:
    """Listed keys with and without a vector, per handle."""
    h = table(spark, folder, "dense_handles", "handle_no", "ids").select("handle_no", F.explode("ids").alias("cache_key"))
    e = table(spark, folder, "query_embeddings", "cache_key").withColumn("there", F.lit(1))
    return h.join(e, "cache_key", "left").groupBy("handle_no").agg(F.count("there").alias("found"), F.count_if(F.col("there").isNull()).alias("missing"))


def agg_chain(spark: SparkSession, folder: str) -> DataFrame:
    m = O.manifests(facts(spark, folder))
    return m.select(*O.CHAIN, "memory_id", F.array_join(F.transform("member_ids", lambda x: x.cast("string")), ",").alias("member_ids"), "member_count", "distinct_values", F.array_join("value_keys", ",").alias("value_keys"))


def agg_chain_norm(spark: SparkSession, folder: str) -> DataFrame:
    """Chains without scope and with the head of the predicate."""
    from turnloom.functions.text import head_stem

    f = facts(spark, folder).withColumn("predicate", head_stem(F.col("predicate")))
    return O.manifests(f, ["owner_id", "predicate", "polarity", "modality"]).select("memory_id", "owner_id", "predicate", "polarity", "modality", "member_count", "distinct_values")


def agg_closure(spark: SparkSession, folder: str) -> DataFrame:
    """A memory's sessions are closed if every turn has visible text and an index."""
    t = table(spark, folder, "turns", "memory_id", "session_id", "raw_text", "turn_index")
    ok = F.coalesce(F.length(F.trim("raw_text")) > 0, F.lit(False)) & F.col("turn_index").isNotNull()
    s = t.groupBy("memory_id", "session_id").agg(F.min(ok).alias("closed"))
    return s.groupBy("memory_id").agg(F.min("closed").alias("closed"), F.count_if("closed").alias("closed_sessions"))


def agg_value_lattice(spark: SparkSession, folder: str) -> DataFrame:
    return O.value_lattice(facts(spark, folder))


def agg_manifest_stats(spark: SparkSession, folder: str) -> DataFrame:
    m = O.manifests(facts(spark, folder))
    return m.agg(F.count(F.lit(1)).alias("chains"), F.round(F.avg("member_count"), 6).alias("mean_members"), F.max("member_count").alias("most"), F.count_if(F.col("member_count") == 1).alias("singletons"))


def agg_lattice_stats(spark: SparkSession, folder: str) -> DataFrame:
    v = O.value_lattice(facts(spark, folder))
    return v.agg(F.count(F.lit(1)).alias("n_values"), F.round(F.avg("n_facts"), 6).alias("mean_facts"), F.count_if("cross_session").alias("crossing"))


def agg_evidence_range(spark: SparkSession, folder: str) -> DataFrame:
    """Earliest and latest time of orders, then customers', then nations', bottom up."""
    o = table(spark, folder, "orders", "o_custkey", "o_orderdate").groupBy("o_custkey").agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    c = table(spark, folder, "customer", "c_custkey", "c_nationkey").join(o, F.col("c_custkey") == F.col("o_custkey"))
    return c.groupBy("c_nationkey").agg(F.min("lo").alias("first_at"), F.max("hi").alias("last_at"), F.count(F.lit(1)).alias("customers"))


def agg_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens spent per memory, cached answers apart."""
    a = table(spark, folder, "answers", "memory_id", "cached", "prompt_tokens", "completion_tokens", "api_total_tokens")
    paid = ~F.coalesce("cached", F.lit(False))
    return a.groupBy("memory_id").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.when(paid, F.col("api_total_tokens"))).alias("paid_tokens"), F.count_if(~paid).alias("cached_calls"),
    )


def agg_unpublished_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Calls and tokens of memories that no handle publishes."""
    a = table(spark, folder, "answers", "memory_id", "api_total_tokens")
    return a.join(table(spark, folder, "dense_handles", "memory_id"), "memory_id", "left_anti").groupBy("memory_id").agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("api_total_tokens"), F.lit(0)).alias("tokens"))


def agg_checksum(spark: SparkSession, folder: str) -> DataFrame:
    f = facts(spark, folder).select("memory_id", F.concat_ws("|", F.col("binding_id").cast("string"), "owner_id", "predicate", "value_key").alias("row"))
    return f.groupBy("memory_id").agg(*(c.alias(k) for k, c in O.multiset_digest(F.col("row")).items()))


def sink_checksum(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "turns", "memory_id", "turn_id", "content_hash").distinct().select("memory_id", F.concat_ws("|", "turn_id", "content_hash").alias("row"))
    return t.groupBy("memory_id").agg(*(c.alias(k) for k, c in O.multiset_digest(F.col("row")).items()))


def agg_principals(spark: SparkSession, folder: str) -> DataFrame:
    """Speakers of each memory by how they speak most: the principal's role and turns."""
    t = table(spark, folder, "turns", "memory_id", "speaker", "role").where("speaker is not null")
    role = F.lower(F.trim("role"))
    side = F.when(role.isin("user", "human"), "user").when(role.isin("assistant", "ai", "bot"), "assistant").otherwise("other")
    per = t.groupBy("memory_id", "speaker", side.alias("side")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("memory_id", "speaker").orderBy(F.col("n").desc(), "side")
    return per.withColumn("k", F.row_number().over(w)).where("k = 1").select("memory_id", "speaker", F.col("side").alias("role"), F.col("n").alias("turns"))


def agg_percentile(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest-rank percentiles of latency per model: the row at ceil(p * n). Places come from ranges, so a model's rows never meet in one task."""
    a = table(spark, folder, "answers", "answer_model", "latency_ms", "answer_no").where("latency_ms >= 0 and not isnan(latency_ms)").withColumn("model", F.lower(F.trim("answer_model"))).where("model is not null")
    r = ranked(a.select("model", "latency_ms", "answer_no"), ["model"], [F.col("latency_ms"), F.col("answer_no")], "k")
    n = a.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    pick = lambda p: F.max(F.when(F.col("k") == F.ceil(F.lit(p) * F.col("n")), F.col("latency_ms")))
    return r.join(n, "model").groupBy("model").agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"))


def agg_mean_certified(spark: SparkSession, folder: str) -> DataFrame:
    """Mean order total per customer, only where every order has one and there are three or more."""
    o = table(spark, folder, "orders", "o_custkey", "o_totalprice")
    g = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count("o_totalprice").alias("have"), F.avg("o_totalprice").alias("mean"))
    return g.where("n >= 3 and n = have").select("o_custkey", F.round("mean", 6).alias("mean"))


def agg_weekly_count(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct (type, weekday) of an owner with three events or more over two types or more."""
    f = facts(spark, folder).where("ts is not null").groupBy("owner_id").agg(F.count_distinct(F.struct("predicate", F.weekday("ts"))).alias("kinds"), F.count(F.lit(1)).alias("n"), F.count_distinct("predicate").alias("types"))
    return f.where("n >= 3 and types >= 2").select("owner_id", "kinds")


def win_degree_cap(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem", "l_partkey", "l_suppkey", "l_quantity").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("confidence"))
    e = li.select("l_partkey", "l_suppkey", F.col("confidence").cast("double"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("edge_id"))
    return O.degree_capped(e, 4, ["l_partkey"]).select("edge_id", "rank")


def win_degree_cap_both(spark: SparkSession, folder: str) -> DataFrame:
    """Undirected: edges of parts and suppliers while both have under four, by quantity."""
    li = table(spark, folder, "lineitem", "l_partkey", "l_suppkey", "l_quantity").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").cast("double").alias("confidence"))
    e = li.select((F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("edge_id"), F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"), "confidence")
    return O.capped_both_ways(e, 4).select("edge_id", "confidence")


def gb_shared_referent(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between sessions of a memory that share rare terms, each pair once with the better score of its two ends' six best."""
    p = join_scene_referent(spark, folder)
    return p.groupBy("memory_id", F.least("session_id", "other_session").alias("a"), F.greatest("session_id", "other_session").alias("b")).agg(F.max("score").alias("score"), F.max("shared").alias("shared"))


def win_mutual_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors divisible by 20 and their nearest other, where each is the other's nearest, with a cosine of 0.2 or more."""
    from turnloom.operators.search import dense

    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))

    def nearest(q: DataFrame) -> DataFrame:
        return dense(q.select(F.col("id").alias("query_id"), "vector"), e, 2).where("query_id <> id and score >= 0.2").groupBy("query_id").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("id"))

    best = cut(nearest(e.where("id % 20 = 0")))
    back = nearest(e.join(best.select("id"), "id", "left_semi")).select(F.col("query_id").alias("id"), F.col("id").alias("query_id"))
    return best.join(back, ["query_id", "id"], "left_semi").select(F.least("query_id", "id").alias("query_id"), F.greatest("query_id", "id").alias("id")).distinct()


def gb_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return _late(spark, folder).select("turn_id", "turn_no")


def rt_bind(spark: SparkSession, folder: str) -> DataFrame:
    """Facts by how they fit what is asked of their memory: owner 0.55, predicate overlap up to 0.35, collection 0.10."""
    f = facts(spark, folder).join(asks(spark, folder), "memory_id")
    overlap = F.size(F.array_intersect(content_terms(F.col("predicate")), content_terms(F.concat_ws(" ", "asked_predicate", "asked_value"))))
    score = F.round(F.when(F.col("owner_id") == F.col("asked_owner"), 0.55).otherwise(0.0) + F.least(F.lit(0.35), 0.18 * overlap) + F.when(F.col("collection_key") == F.col("asked_collection"), 0.10).otherwise(0.0), 4)
    return f.select("binding_id", score.alias("score"))


def rt_collection_gate(spark: SparkSession, folder: str) -> DataFrame:
    return rt_bind(spark, folder).where("score >= 0.70")


QUERIES = {f.__name__: f for f in (
    flt_lookup_facts, flt_owner_pred, flt_lookup_collections, flt_keep_fact, flt_binding_veto, flt_accept, flt_admissible, flt_alias, flt_authoritative, flt_promotable_value, prj_binding, prj_reservoir_row,
    join_turn_group_fact, join_owner_alias, join_adjacency, join_neighbor_turn, join_dialogue, join_interval_overlap, join_before, join_shared_value, join_scene_referent, join_semi_manifest, join_anti_pack,
    join_paired, join_hierarchy_cross, join_embedding, agg_chain, agg_chain_norm, agg_closure, agg_value_lattice, agg_manifest_stats, agg_lattice_stats, agg_evidence_range, agg_usage, agg_unpublished_ledger,
    agg_checksum, sink_checksum, agg_principals, agg_percentile, agg_mean_certified, agg_weekly_count, win_lead_turns, win_state_next, win_degree_cap, win_degree_cap_both, gb_shared_referent, win_mutual_nearest, gb_dedup, rt_bind, rt_collection_gate,
)}

_LATE = "late AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY ingested_at DESC, turn_no DESC) = 1)"
_NEXT = "n AS (SELECT *, lead(binding_id) OVER w AS next_id, lead(value_key) OVER w AS next_value, lead(ts) OVER w AS next_ts FROM facts {0} WINDOW w AS (PARTITION BY memory_id, owner_id, predicate ORDER BY ts ASC NULLS LAST, session_id, turn_index, binding_id))"
_CH = ", ".join(O.CHAIN)
_HEX = "CAST(('0x' || substr(h, {0}, {1})) AS UBIGINT)"
_DIGEST = ", ".join([f"CAST(bit_xor({_HEX.format(1 + 8 * k, 8)}) AS BIGINT) AS xor{k}" for k in range(8)] + [f"CAST(sum({_HEX.format(1 + 8 * k, 8)}) AS BIGINT) AS sum{k}" for k in range(8)])
_SIG = "owner_id = asked_owner AS s1, predicate = asked_predicate AS s2, collection_key = asked_collection AS s3, value_type = 'number' AS s4, coalesce(ts < asked_ts, false) AS s5, coalesce(session_id = strftime(asked_ts, '%Y-%m-%d'), false) AS s6"
_SCORE = "round(0.40::DOUBLE * s1::INT + 0.28::DOUBLE * s2::INT + 0.10::DOUBLE * s3::INT + 0.08::DOUBLE * s4::INT + 0.08::DOUBLE * s5::INT + 0.04::DOUBLE * s6::INT, 4)"
_BIND = f"""{ASKS}, b AS (SELECT binding_id, round(CASE WHEN owner_id = asked_owner THEN 0.55::DOUBLE ELSE 0 END + least(0.35::DOUBLE, 0.18::DOUBLE * len(list_intersect({sql_content('predicate')}, {sql_content("concat_ws(' ', asked_predicate, asked_value)")}))) + CASE WHEN collection_key = asked_collection THEN 0.10::DOUBLE ELSE 0 END, 4) AS score FROM facts JOIN asks USING (memory_id))"""

SQL = {
    "flt_lookup_facts": f"""WITH {FACTS}, a AS (SELECT owner_id, 'purchase' AS wanted, binding_id FROM facts WHERE predicate = 'purchase' UNION ALL SELECT owner_id, 'click now', binding_id FROM facts WHERE predicate = 'click')
 SELECT owner_id, wanted, binding_id, row_number() OVER (PARTITION BY owner_id, wanted ORDER BY binding_id) AS rank FROM a QUALIFY rank <= 5""",
    "flt_owner_pred": f"WITH {FACTS} SELECT memory_id, owner_id, predicate, count(*) AS n, min(binding_id) AS first_id FROM facts GROUP BY ALL",
    "flt_lookup_collections": f"WITH {FACTS}, {ASKS}, c AS (SELECT owner_id, collection_key, count(*) AS n FROM facts JOIN asks USING (memory_id) WHERE predicate = asked_predicate GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY n DESC, collection_key) AS rank FROM c QUALIFY rank <= 3",
    "flt_keep_fact": """WITH a AS (SELECT answer_no, lower(CASE WHEN answer_no % 7 = 0 THEN 'shared a photo' ELSE coalesce(finish_reason, 'is') END) AS p, lower(coalesce(CASE WHEN answer_no % 5 = 0 THEN 'Yes' ELSE prediction END, '')) AS v FROM answers)
 SELECT answer_no, NOT regexp_matches(p, '\\b(shared|showed|sent)\\b.*\\b(media|photo|picture|image|caption)\\b') AND NOT (v IN ('yes', 'true', 'it', 'that') AND len(regexp_split_to_array(trim(p), '\\s+')) <= 2) AS kept FROM a""",
    "flt_binding_veto": f"WITH {FACTS}, {ASKS} SELECT binding_id, CASE WHEN owner_id <> asked_owner THEN 'owner_conflict' WHEN polarity = 'negative' THEN 'polarity_conflict' WHEN modality = 'planned' THEN 'modality_conflict' WHEN ts > asked_ts THEN 'temporal_conflict' END AS veto FROM facts JOIN asks USING (memory_id)",
    "flt_accept": f"WITH {FACTS}, {ASKS}, s AS (SELECT binding_id, {_SIG} FROM facts JOIN asks USING (memory_id)) SELECT binding_id, {_SCORE} AS score, (s1 OR s2::INT + s3::INT + s4::INT + s5::INT + s6::INT >= 2) AND {_SCORE} >= 0.30 AS accepted FROM s",
    "flt_admissible": f"WITH {FACTS}, {ASKS}, c AS (SELECT binding_id, CASE WHEN owner_id = asked_owner THEN 'owner' WHEN row_number() OVER (PARTITION BY memory_id ORDER BY ts DESC NULLS LAST, binding_id DESC) <= 32 THEN 'source_rank' WHEN polarity = 'negative' THEN 'rejected_polarity' ELSE 'rejected_owner' END AS reason FROM facts JOIN asks USING (memory_id)) SELECT *, reason IN ('owner', 'source_rank') AS admitted FROM c",
    "flt_alias": "SELECT DISTINCT lower(trim(speaker)) AS alias FROM turns WHERE length(lower(trim(speaker))) >= 3 AND lower(trim(speaker)) NOT IN ('user', 'assistant', 'system', 'tool', 'the', 'you')",
    "flt_authoritative": "SELECT turn_no FROM turns WHERE coalesce(lower(trim(role)) IN ('user', 'human'), false) OR coalesce(lower(trim(speaker)) NOT IN ('user', 'assistant', 'system', 'tool', ''), false)",
    "flt_promotable_value": "SELECT answer_no, trim(prediction, ' ') AS value FROM answers WHERE len(regexp_extract_all(trim(prediction, ' '), '[\\p{L}\\p{N}_''-]+')) BETWEEN 1 AND 4 AND NOT regexp_matches(trim(prediction, ' '), '[.!?;:]$') AND NOT regexp_matches(trim(prediction, ' '), '^[0-9 .,$€£%]+$')",
    "prj_binding": f"WITH {FACTS} SELECT binding_id, operand_id, owner_id, predicate, lower(value_key) AS value_key, turn_index, substr(sha256('binding|' || operand_id || '|' || binding_id), 1, 32) AS stable_id FROM facts",
    "prj_reservoir_row": f"WITH {FACTS} SELECT memory_id, binding_id, owner_id, predicate FROM facts WHERE polarity = 'positive'",
    "join_turn_group_fact": "WITH a AS (SELECT question_id, unnest(evidence_turn_ids) AS turn_id, generate_subscripts(evidence_turn_ids, 1) - 1 AS place FROM answers) SELECT question_id, turn_id, CAST(min(place) AS INT) AS best_place, session_id FROM a JOIN (SELECT DISTINCT turn_id, session_id FROM turns) USING (turn_id) GROUP BY ALL",
    "join_owner_alias": "WITH w AS (SELECT DISTINCT question_id, memory_id, unnest(regexp_extract_all(lower(question), '[\\p{L}\\p{N}_-]+')) AS alias FROM questions) SELECT question_id, alias FROM w JOIN (SELECT DISTINCT memory_id, lower(speaker) AS alias FROM turns WHERE length(speaker) > 2) USING (memory_id, alias)",
    "join_adjacency": """WITH e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), u AS (SELECT a AS node, b AS next, false AS inverse FROM e UNION ALL SELECT b, a, true FROM e) SELECT node, inverse, count(DISTINCT next) AS degree, min(next) AS first_next FROM u GROUP BY ALL""",
    "join_neighbor_turn": f"WITH {_LATE} SELECT b.turn_no, round(max(0.35::DOUBLE / abs(b.turn_index - a.turn_index)), 6) AS score FROM late a JOIN late b ON a.memory_id = b.memory_id AND a.session_id = b.session_id AND abs(b.turn_index - a.turn_index) BETWEEN 1 AND 2 WHERE a.turn_no % 20 = 0 GROUP BY ALL",
    "join_dialogue": f"WITH {_LATE}, n AS (SELECT turn_no, speaker, lead(turn_no) OVER w AS reply_no, lead(speaker) OVER w AS rs FROM late WINDOW w AS (PARTITION BY memory_id, session_id ORDER BY turn_index, turn_no)) SELECT turn_no, reply_no FROM n WHERE reply_no IS NOT NULL AND rs <> speaker",
    "win_lead_turns": f"WITH {_LATE} SELECT turn_no, lag(turn_no) OVER w AS before_no, lead(turn_no) OVER w AS after_no FROM late WINDOW w AS (PARTITION BY memory_id, session_id ORDER BY turn_index, turn_no)",
    "join_interval_overlap": f"""WITH {FACTS}, a AS (SELECT memory_id, owner_id, min(ts) AS s, max(ts) AS e FROM facts WHERE operand_id = 'o1' GROUP BY ALL), b AS (SELECT memory_id, owner_id, min(ts) AS s, max(ts) AS e FROM facts WHERE operand_id = 'o2' GROUP BY ALL)
 SELECT a.owner_id, count(*) AS overlaps FROM a JOIN b ON a.memory_id = b.memory_id AND a.s <= b.e AND b.s <= a.e GROUP BY ALL""",
    "join_before": f"WITH {FACTS}, {_NEXT.format('WHERE ts IS NOT NULL')} SELECT binding_id, next_id FROM n WHERE ts < next_ts",
    "win_state_next": f"WITH {FACTS}, {_NEXT.format('')} SELECT binding_id, next_id FROM n WHERE next_id IS NOT NULL AND value_key <> next_value",
    "join_shared_value": f"WITH {FACTS}, c AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY memory_id, value_type, value_key ORDER BY binding_id) <= 16) SELECT a.binding_id, b.binding_id AS other_id FROM c a JOIN c b USING (memory_id, value_type, value_key) WHERE a.binding_id < b.binding_id AND a.session_id <> b.session_id",
    "join_scene_referent": f"""WITH w AS (SELECT DISTINCT memory_id, session_id, unnest({sql_content('raw_text')}) AS term FROM turns), d AS (SELECT memory_id, term, count(*) AS df FROM w GROUP BY ALL HAVING df BETWEEN 2 AND 64), n AS (SELECT memory_id, count(DISTINCT session_id) AS n FROM w GROUP BY ALL),
 r AS (SELECT memory_id, term, session_id, ln(1 + n / df) AS idf FROM w JOIN d USING (memory_id, term) JOIN n USING (memory_id)),
 s AS (SELECT memory_id, a.session_id, b.session_id AS other_session, count(*) AS shared, round(sum(a.idf), 6) AS score FROM r a JOIN r b USING (memory_id, term) WHERE a.session_id <> b.session_id GROUP BY ALL HAVING shared >= 2)
 SELECT *, row_number() OVER (PARTITION BY memory_id, session_id ORDER BY score DESC, other_session) AS rank FROM s QUALIFY rank <= 6""",
    "join_semi_manifest": f"WITH {FACTS} SELECT binding_id FROM facts WHERE operand_id = 'o1' QUALIFY count(*) OVER (PARTITION BY owner_id, collection_key) >= 3",
    "join_anti_pack": "SELECT DISTINCT turn_id FROM turns WHERE turn_id NOT IN (SELECT unnest(evidence_turn_ids) FROM answers)",
    "join_paired": "WITH a AS (SELECT question_id, min(answer_no) AS base_no, max(answer_no) AS candidate_no FROM answers GROUP BY ALL) SELECT a.*, b.prediction IS DISTINCT FROM c.prediction AS changed FROM a JOIN answers b ON b.answer_no = base_no JOIN answers c ON c.answer_no = candidate_no",
    "join_hierarchy_cross": "SELECT a.n_nationkey AS left_id, b.n_nationkey AS right_id FROM nation a JOIN nation b ON b.n_regionkey - a.n_regionkey BETWEEN 1 AND 2",
    "join_embedding": "WITH h AS (SELECT handle_no, unnest(ids) AS cache_key FROM dense_handles) SELECT handle_no, count(e.cache_key) AS found, count(*) FILTER (e.cache_key IS NULL) AS missing FROM h LEFT JOIN query_embeddings e USING (cache_key) GROUP BY ALL",
    "agg_chain": f"WITH {FACTS} SELECT memory_id, {_CH}, array_to_string(list(binding_id ORDER BY session_id, turn_index, binding_id), ',') AS member_ids, count(*) AS member_count, count(DISTINCT value_key) AS distinct_values, array_to_string(list_sort(list(DISTINCT value_key)), ',') AS value_keys FROM facts GROUP BY memory_id, {_CH}",
    "agg_chain_norm": f"WITH {FACTS}, f AS (SELECT * REPLACE (CASE predicate WHEN 'purchase' THEN 'purchase' ELSE predicate END AS predicate) FROM facts) SELECT memory_id, owner_id, predicate, polarity, modality, count(*) AS member_count, count(DISTINCT value_key) AS distinct_values FROM f GROUP BY ALL",
    "agg_closure": "WITH s AS (SELECT memory_id, session_id, bool_and(coalesce(length(trim(raw_text, ' ')) > 0, false) AND turn_index IS NOT NULL) AS closed FROM turns GROUP BY ALL) SELECT memory_id, bool_and(closed) AS closed, count(*) FILTER (closed) AS closed_sessions FROM s GROUP BY ALL",
    "agg_value_lattice": f"WITH {FACTS} SELECT memory_id, value_type, value_key, count(*) AS n_facts, count(DISTINCT session_id) AS n_sessions, count(DISTINCT session_id) > 1 AS cross_session FROM facts GROUP BY ALL HAVING n_facts >= 2",
    "agg_manifest_stats": f"WITH {FACTS}, m AS (SELECT count(*) AS c FROM facts GROUP BY memory_id, {_CH}) SELECT count(*) AS chains, round(avg(c), 6) AS mean_members, max(c) AS most, count(*) FILTER (c = 1) AS singletons FROM m",
    "agg_lattice_stats": f"WITH {FACTS}, v AS (SELECT count(*) AS n, count(DISTINCT session_id) AS s FROM facts GROUP BY memory_id, value_type, value_key HAVING count(*) >= 2) SELECT count(*) AS n_values, round(avg(n), 6) AS mean_facts, count(*) FILTER (s > 1) AS crossing FROM v",
    "agg_evidence_range": "SELECT c_nationkey, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, count(DISTINCT c_custkey) AS customers FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL",
    "agg_usage": "SELECT memory_id, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(api_total_tokens) FILTER (NOT coalesce(cached, false)) AS BIGINT) AS paid_tokens, count(*) FILTER (coalesce(cached, false)) AS cached_calls FROM answers GROUP BY memory_id",
    "agg_unpublished_ledger": "SELECT memory_id, count(*) AS calls, CAST(coalesce(sum(api_total_tokens), 0) AS BIGINT) AS tokens FROM answers WHERE memory_id NOT IN (SELECT memory_id FROM dense_handles WHERE memory_id IS NOT NULL) GROUP BY memory_id",
    "agg_checksum": f"WITH {FACTS}, h AS (SELECT memory_id, sha256(binding_id || '|' || owner_id || '|' || predicate || '|' || value_key) AS h FROM facts) SELECT memory_id, {_DIGEST} FROM h GROUP BY memory_id",
    "sink_checksum": f"WITH t AS (SELECT DISTINCT memory_id, turn_id, content_hash FROM turns), h AS (SELECT memory_id, sha256(concat_ws('|', turn_id, content_hash)) AS h FROM t) SELECT memory_id, {_DIGEST} FROM h GROUP BY memory_id",
    "agg_principals": """WITH p AS (SELECT memory_id, speaker, CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai', 'bot') THEN 'assistant' ELSE 'other' END AS role, count(*) AS turns FROM turns WHERE speaker IS NOT NULL GROUP BY ALL)
 SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY memory_id, speaker ORDER BY turns DESC, role) = 1""",
    "agg_percentile": """WITH r AS (SELECT lower(trim(answer_model)) AS model, latency_ms, row_number() OVER (PARTITION BY lower(trim(answer_model)) ORDER BY latency_ms, answer_no) AS k, count(*) OVER (PARTITION BY lower(trim(answer_model))) AS n FROM answers WHERE latency_ms >= 0 AND NOT isnan(latency_ms) AND answer_model IS NOT NULL)
 SELECT model, max(latency_ms) FILTER (k = ceil(0.5::DOUBLE * n)) AS p50, max(latency_ms) FILTER (k = ceil(0.95::DOUBLE * n)) AS p95 FROM r GROUP BY model""",
    "agg_mean_certified": "SELECT o_custkey, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY ALL HAVING count(*) >= 3 AND count(*) = count(o_totalprice)",
    "agg_weekly_count": f"WITH {FACTS} SELECT owner_id, count(DISTINCT predicate || isodow(ts)) AS kinds FROM facts WHERE ts IS NOT NULL GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT predicate) >= 2",
    "win_degree_cap": "WITH e AS (SELECT l_partkey, sum(l_quantity) AS c, l_partkey * 100000 + l_suppkey AS edge_id FROM lineitem GROUP BY l_partkey, l_suppkey) SELECT edge_id, row_number() OVER (PARTITION BY l_partkey ORDER BY c DESC, edge_id) AS rank FROM e QUALIFY rank <= 4",
    "win_mutual_nearest": """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.id AS query_id, b.id AS id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 20 = 0),
 t AS (SELECT query_id, arg_max(id, (score, -id)) AS id FROM (SELECT * FROM s WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1) GROUP BY query_id),
 u AS (SELECT a.id AS query_id, b.id AS id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM (SELECT * FROM e WHERE id IN (SELECT id FROM t)) a JOIN e b ON a.id <> b.id), w AS (SELECT query_id, id FROM u WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1)
 SELECT DISTINCT least(t.query_id, t.id) AS query_id, greatest(t.query_id, t.id) AS id FROM t JOIN w ON w.query_id = t.id AND w.id = t.query_id""",
    "gb_dedup": f"WITH {_LATE} SELECT turn_id, turn_no FROM late",
    "rt_bind": f"WITH {FACTS}, {_BIND} SELECT * FROM b",
    "rt_collection_gate": f"WITH {FACTS}, {_BIND} SELECT * FROM b WHERE score >= 0.70",
}
SQL["gb_shared_referent"] = "SELECT memory_id, least(session_id, other_session) AS a, greatest(session_id, other_session) AS b, max(score) AS score, max(shared) AS shared FROM (" + SQL["join_scene_referent"] + ") GROUP BY ALL"
