"""Filters, bindings, chains and value lattices over fact rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.text import contained, content_terms
from turnloom.plans.lineage import cut

# Weights of the signals that bind a fact to an operand, and the score that accepts it.
WEIGHTS = {"owner": 0.40, "predicate": 0.28, "scope": 0.10, "value_type": 0.08, "temporal": 0.08, "source_projection": 0.14, "graph_path": 0.06, "session": 0.04}
ACCEPT = 0.30
OWNERLESS_SIGNALS = 2
#: Columns whose equal values make a chain.
CHAIN = ["owner_id", "predicate", "scope", "collection_key", "polarity", "modality"]


def lookup_facts(facts: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Facts of the asked owner (owner_id, wanted): predicate equal to ``wanted`` or one's terms within the other's; best by overlap, then id."""
    a, b = content_terms(F.col("predicate")), content_terms(F.col("wanted"))
    hits = facts.join(asked, "owner_id").where((F.col("predicate") == F.col("wanted")) | contained(a, b))
    score = 2.0 + 0.75 * F.size(F.array_intersect(a, b))
    w = Window.partitionBy("owner_id", "wanted").orderBy(score.desc(), "binding_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keep_fact(predicate: Column, value: Column) -> Column:
    """Whether a fact says something: no shared media, no bare yes of a predicate of two words or less."""
    p, v = F.lower(predicate), F.lower(value)
    media = p.rlike(r"\b(shared|showed|sent)\b.*\b(media|photo|picture|image|caption)\b")
    bare = v.isin("yes", "true", "it", "that") & (F.size(F.split(F.trim(p), r"\s+")) <= 2)
    return ~media & ~bare


def veto(owner_conflict: Column, polarity_conflict: Column, modality_conflict: Column, type_conflict: Column, time_conflict: Column) -> Column:
    """Name of the first hard conflict, or null."""
    return (
        F.when(owner_conflict, "owner_conflict").when(polarity_conflict, "polarity_conflict").when(modality_conflict, "modality_conflict")
        .when(type_conflict, "value_type_conflict").when(time_conflict, "temporal_conflict")
    )


def signal_score(signals: dict[str, Column]) -> Column:
    """Weights of the signals that hold, added."""
    out = F.lit(0.0)
    for name, held in signals.items():
        out = out + F.when(held, WEIGHTS[name]).otherwise(0.0)
    return out


def accepted(signals: dict[str, Column]) -> Column:
    """Owner match, or two other signals, and a score that suffices."""
    others = F.lit(0)
    for name, held in signals.items():
        if name != "owner":
            others = others + F.coalesce(held.cast("int"), F.lit(0))
    return (F.coalesce(signals["owner"], F.lit(False)) | (others >= OWNERLESS_SIGNALS)) & (signal_score(signals) >= ACCEPT)


def manifests(facts: DataFrame, chain: list[str] = CHAIN) -> DataFrame:
    """Chains with their members in order of session, turn and id, and how many values they hold."""
    member = F.struct("session_id", "turn_index", "binding_id")
    return facts.groupBy("memory_id", *chain).agg(
        F.transform(F.array_sort(F.collect_list(member)), lambda m: m["binding_id"]).alias("member_ids"),
        F.count(F.lit(1)).alias("member_count"), F.count_distinct("value_key").alias("distinct_values"), F.array_sort(F.collect_set("value_key")).alias("value_keys"),
    )


def value_lattice(facts: DataFrame, least: int = 2) -> DataFrame:
    """Values that ``least`` facts or more share, and over how many sessions."""
    per = facts.groupBy("memory_id", "value_type", "value_key").agg(F.count(F.lit(1)).alias("n_facts"), F.count_distinct("session_id").alias("n_sessions"))
    return per.where(F.col("n_facts") >= least).withColumn("cross_session", F.col("n_sessions") > 1)


def shared_values(facts: DataFrame, cap: int = 16) -> DataFrame:
    """Pairs of facts with one value in different sessions, among the first ``cap`` facts of the value (the documented hub bound)."""
    w = Window.partitionBy("memory_id", "value_type", "value_key").orderBy("binding_id")
    first = facts.select("memory_id", "value_type", "value_key", "session_id", "binding_id", F.row_number().over(w).alias("n")).where(F.col("n") <= cap).drop("n")
    other = first.select("memory_id", "value_type", "value_key", F.col("session_id").alias("other_session"), F.col("binding_id").alias("other_id"))
    return first.join(other, ["memory_id", "value_type", "value_key"]).where((F.col("binding_id") < F.col("other_id")) & (F.col("session_id") != F.col("other_session")))


def next_in_chain(facts: DataFrame, chain: list[str]) -> DataFrame:
    """Each fact with the next of its chain by time, session, turn and id."""
    w = Window.partitionBy("memory_id", *chain).orderBy(F.col("ts").asc_nulls_last(), "session_id", "turn_index", "binding_id")
    return facts.select("*", F.lead("binding_id").over(w).alias("next_id"), F.lead("value_key").over(w).alias("next_value"), F.lead("ts").over(w).alias("next_ts"))


def degree_capped(edges: DataFrame, cap: int, by: list[str]) -> DataFrame:
    """Edges within their source's ``cap`` best by confidence, then id."""
    w = Window.partitionBy(*by).orderBy(F.col("confidence").desc(), "edge_id")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def last_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def multiset_digest(row: Column) -> dict[str, Column]:
    """Aggregates that tell a multiset of rows whatever their order: XOR and sum of each of the eight 32-bit words of SHA-256."""
    h = F.sha2(row, 256)
    word = lambda k: F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("bigint")
    return {f"xor{k}": F.bit_xor(word(k)) for k in range(8)} | {f"sum{k}": F.sum(word(k)) for k in range(8)}


def capped_both_ways(edges: DataFrame, cap: int) -> DataFrame:
    """(edge_id, a, b, confidence) of undirected edges that a greedy walk by confidence, then id, would take while both ends have under ``cap``.

    An edge that is among the first still open ones of both its ends, as many as they may take, is taken by
    the greedy walk whatever comes before it; so each round takes all such edges at once, until none is open.
    Loops are left out, an edge listed twice counts once.
    """
    left = cut(edges.where("a is not null and b is not null and a <> b").groupBy("edge_id", "a", "b").agg(F.max("confidence").alias("confidence")))
    taken = left.limit(0)
    while not left.isEmpty():
        used = taken.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("used"))
        ends = left.select("edge_id", F.col("confidence"), F.explode(F.array("a", "b")).alias("node"))
        rank = F.row_number().over(Window.partitionBy("node").orderBy(F.col("confidence").desc_nulls_last(), "edge_id"))
        open_ = ends.withColumn("rank", rank).where(F.col("rank") <= cap).join(used, "node", "left").where(F.col("rank") <= cap - F.coalesce("used", F.lit(0)))
        sure = open_.groupBy("edge_id").agg(F.count(F.lit(1)).alias("ends")).where("ends = 2").select("edge_id")
        taken = cut(taken.unionByName(left.join(sure, "edge_id", "left_semi")))
        full = taken.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("used")).where(F.col("used") >= cap).select("node")
        rest = left.join(sure, "edge_id", "left_anti").join(full.withColumnRenamed("node", "a"), "a", "left_anti").join(full.withColumnRenamed("node", "b"), "b", "left_anti")
        left = cut(rest.select("edge_id", "a", "b", "confidence"))
    return taken
