"""Fusing ranked channels: reciprocal ranks, min-max, consensus, lanes, quotas, interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of views, of the final fusion and of the coverage lane.
VIEW_WEIGHTS = {"full_query": 1.0, "owner_predicate": 0.9, "predicate": 0.75, "query_relation": 1.0}
OTHER_VIEW = 0.50
FUSION = {"exact": 1.2, "bm25": 1.0, "dense": 1.0, "graph": 0.8, "binding": 0.7, "operand": 0.4, "role": 0.25, "slot": 0.5, "session": 0.12, "adjacency": 1.0}
ADVICE_FUSION = {"exact": 0.5, "bm25": 0.5, "dense": 2.0, "graph": 0.35, "role": 0.1, "slot": 0.25, "session": 0.05, "adjacency": 0.1}
COVERAGE = {"exact": 1.2, "bm25": 1.0, "dense": 1.0, "role": 0.25, "slot": 0.5, "session": 0.12, "adjacency": 1.0}
RRF_K = 60


def reciprocal_ranks(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, id, rrf) from (query_id, channel, id, rank): the sum of 1 / (k + rank) over the channels."""
    return ranked.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9).alias("rrf"))


def consensus(ranked: DataFrame) -> DataFrame:
    """(query_id, id, consensus) from (query_id, view, channel, id, rank): weighted reciprocal ranks, owner views left out."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for p in VIEW_WEIGHTS.items() for x in p])[F.col("view")], F.lit(OTHER_VIEW))
    return ranked.where("view <> 'owner'").groupBy("query_id", "id").agg(F.round(F.sum(weight / (RRF_K + F.col("rank"))), 9).alias("consensus"))


def min_max(value: Column, by: list[str]) -> Column:
    """Value between 0 and 1 within its group; 1 where the group is constant."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (value - low) / (high - low)).otherwise(1.0)


def weighted(weights: dict[str, float], columns: dict[str, Column]) -> Column:
    """Sum of the named columns by their weights; missing values count 0."""
    out = F.lit(0.0)
    for name, weight in weights.items():
        if name in columns:
            out = out + weight * F.coalesce(columns[name], F.lit(0.0))
    return out


def per_session_quota(ranked: DataFrame, limit: int) -> DataFrame:
    """Rows of (query_id, session_id, id, rank) kept within ``limit``: a quota of limit / sessions for each session first, then by rank."""
    every = Window.partitionBy("query_id")
    sessions = F.size(F.collect_set("session_id").over(every))
    own = F.row_number().over(Window.partitionBy("query_id", "session_id").orderBy("rank"))
    quota = F.greatest(F.lit(1), F.floor(F.lit(limit) / sessions))
    marked = ranked.withColumn("late", (own > quota).cast("int"))
    return marked.withColumn("place", F.row_number().over(every.orderBy("late", "rank"))).where(F.col("place") <= limit).drop("late")


def dual_lane(scored: DataFrame, max_turns: int, head: int) -> DataFrame:
    """(query_id, id, place) of (query_id, id, fused, coverage): a head in fused order, a tail by reciprocal ranks of both orders."""
    w = Window.partitionBy("query_id")
    ranked = scored.withColumns({
        "precision_rank": F.row_number().over(w.orderBy(F.col("fused").desc(), "id")) - 1,
        "coverage_rank": F.row_number().over(w.orderBy(F.col("coverage").desc(), F.col("fused").desc(), "id")) - 1,
        "n": F.count(F.lit(1)).over(w),
    })
    limit = F.least(F.col("n"), F.lit(max_turns), F.lit(max(1, head)), F.lit(max(1, max_turns // 2)))
    in_head = F.col("precision_rank") < limit
    both = F.round(1.0 / (RRF_K + F.col("precision_rank")) + 1.0 / (RRF_K + F.col("coverage_rank")), 9)
    order = w.orderBy(F.when(in_head, 0).otherwise(1), F.when(in_head, F.col("precision_rank")).otherwise(0), both.desc(), "coverage_rank", "precision_rank", "id")
    return ranked.select("query_id", "id", F.row_number().over(order).alias("place"), in_head.alias("head"))


def round_robin(ranked: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, place) from (query_id, operand_id, id, rank): first of each operand, then seconds, an id once at its earliest turn."""
    first = ranked.groupBy("query_id", "id").agg(F.min(F.struct("rank", "operand_id")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at.rank", "at.operand_id", "id")
    return first.select("query_id", "id", F.row_number().over(w).alias("place")).where(F.col("place") <= limit)
