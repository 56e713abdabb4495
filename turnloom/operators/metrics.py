"""Retrieval metrics per question and their means, splits and paired tests."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def set_metrics(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, gold, turns, hits, precision, recall, f1, any_hit, all_hit) from (query_id, id) sets; repeated ids count once."""
    both = gold.distinct().withColumn("g", F.lit(1)).join(found.distinct().withColumn("p", F.lit(1)), ["query_id", "id"], "full")
    c = both.groupBy("query_id").agg(F.count("g").alias("gold"), F.count("p").alias("turns"), F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("hits"))
    p, r = ratio(F.col("hits"), F.col("turns")), ratio(F.col("hits"), F.col("gold"))
    return c.select("*", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), (F.col("hits") > 0).alias("any_hit"), (F.col("hits") == F.col("gold")).alias("all_hit"))


def ranked_metrics(gold: DataFrame, ranked: DataFrame, cut: int) -> DataFrame:
    """(query_id, gold, reciprocal_rank, last_gold_rank, average_precision, r_precision, recall, ndcg) of (query_id, id, rank) up to ``cut``."""
    g = gold.distinct().withColumn("rel", F.lit(1))
    n = g.groupBy("query_id").agg(F.count(F.lit(1)).alias("gold"))
    hit = ranked.join(g, ["query_id", "id"])
    w = Window.partitionBy("query_id").orderBy("rank")
    hit = hit.withColumn("nth", F.row_number().over(w))
    gains = 1 / F.log2(F.col("rank") + 1)
    per = hit.join(n, "query_id").groupBy("query_id").agg(
        F.min("rank").alias("first"), F.max("rank").alias("last"), F.count(F.lit(1)).alias("hits"), F.sum(F.col("nth") / F.col("rank")).alias("ap"),
        F.count_if(F.col("rank") <= F.col("gold")).alias("in_r"), F.count_if(F.col("rank") <= cut).alias("in_cut"), F.sum(F.when(F.col("rank") <= cut, gains)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("gold"), F.lit(cut))), F.lit(0.0), lambda s, k: s + 1 / F.log2(k + 1.0))
    out = n.join(per, "query_id", "left").na.fill(0, ["hits", "in_r", "in_cut"]).na.fill(0.0, ["ap", "dcg"])
    return out.select(
        "query_id", "gold", ratio(F.lit(1.0), F.coalesce("first", F.lit(0))).alias("reciprocal_rank"), F.when(F.col("hits") == F.col("gold"), F.col("last")).otherwise(0).alias("last_gold_rank"),
        (F.col("ap") / F.col("gold")).alias("average_precision"), (F.col("in_r") / F.col("gold")).alias("r_precision"), (F.col("in_cut") / F.col("gold")).alias("recall"), (F.col("dcg") / ideal).alias("ndcg"),
    )


def macro(rows: DataFrame, stratum: str, metrics: list[str]) -> DataFrame:
    """Mean of each metric per stratum, over all rows (``overall``) and over the strata's means (``equal_stratum``)."""
    per = rows.groupBy(stratum).agg(*(F.avg(m).alias(m) for m in metrics), F.count(F.lit(1)).alias("n"))
    overall = rows.agg(*(F.avg(m).alias(m) for m in metrics), F.count(F.lit(1)).alias("n")).withColumn(stratum, F.lit("overall"))
    equal = per.agg(*(F.avg(m).alias(m) for m in metrics), F.count(F.lit(1)).alias("n")).withColumn(stratum, F.lit("equal_stratum"))
    return per.unionByName(overall).unionByName(equal)


def mcnemar(b: int, c: int) -> float:
    """Exact two-sided p-value of b gains against c losses."""
    n = b + c
    if n == 0:
        return 1.0
    return min(1.0, 2 * sum(comb(n, k) for k in range(min(b, c) + 1)) / 2**n)


def failure_stage(all_packed: Column, session_hits: Column, all_sessions: Column, all_candidates: Column, exhausted: Column) -> Column:
    """Where a question lost its evidence."""
    return (
        F.when(all_packed, "success").when(session_hits == 0, "seed_miss").when(~all_sessions, "routing_miss").when(~all_candidates, "within_session_candidate_miss")
        .when(exhausted, "pack_drop_or_budget_exhausted").otherwise("pack_drop")
    )


def seeded_rank(key: Column, seed: str) -> Column:
    """Sort key that shuffles rows by a seed alone."""
    return F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256)
