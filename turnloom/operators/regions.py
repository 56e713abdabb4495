"""Relations between regions of a memory: features, witnesses, gated pairs, typed edges, insertion of new sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values kept of one feature field of a region.
FIELD_CAP = 128


def lifted(features: DataFrame, parents: DataFrame, cap: int = FIELD_CAP) -> DataFrame:
    """(region, values) of parents from (region, value) of children and (child, parent): the first ``cap`` values in order."""
    up = features.join(parents, features["region"] == parents["child"]).select(F.col("parent").alias("region"), "value").distinct()
    w = Window.partitionBy("region").orderBy("value")
    kept = up.withColumn("k", F.row_number().over(w)).where(F.col("k") <= cap)
    return kept.groupBy("region").agg(F.array_sort(F.collect_list("value")).alias("values"))


def value_pairs(features: DataFrame, hub: int) -> DataFrame:
    """(a, b, shared, witnesses) of regions of one scope that share values, from (scope, region, value).

    Values that more than ``hub`` regions hold tell no two of them together and are left out: that bound is
    the operator's definition of a telling value.
    """
    f = features.distinct()
    telling = f.groupBy("scope", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, hub)).select("scope", "value")
    left = f.join(telling, ["scope", "value"])
    right = left.select("scope", "value", F.col("region").alias("b"))
    return left.withColumnRenamed("region", "a").join(right, ["scope", "value"]).where("a < b").groupBy("scope", "a", "b").agg(F.count(F.lit(1)).alias("shared"), F.array_sort(F.collect_set("value")).alias("witnesses"))


def quota(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs among the ``k`` best of either end."""
    rank = lambda side: F.row_number().over(Window.partitionBy("scope", side).orderBy(F.col("shared").desc(), "a", "b"))
    return pairs.withColumns({"ka": rank("a"), "kb": rank("b")}).where((F.col("ka") <= k) | (F.col("kb") <= k)).drop("ka", "kb")


def gated_children(parents: DataFrame, child_pairs: DataFrame, child_of: DataFrame) -> DataFrame:
    """Child pairs (a, b, ...) whose parents (child, parent) form a pair (pa, pb) that passed its gate."""
    up = lambda side: child_of.select(F.col("child").alias(side), F.col("parent").alias(f"p{side}"))
    placed = child_pairs.join(up("a"), "a").join(up("b"), "b")
    both = placed.withColumns({"_x": F.least("pa", "pb"), "_y": F.greatest("pa", "pb")})
    gate = parents.select(F.least("pa", "pb").alias("_x"), F.greatest("pa", "pb").alias("_y")).distinct()
    return both.join(gate, ["_x", "_y"], "left_semi").drop("_x", "_y", "pa", "pb")


def refined_relation(same_owner: Column, same_value: Column, opposite: Column, later: Column, confidence: Column, least: float = 0.82) -> Column:
    """Relation that a pair of facts may be refined to, or null: coreference, contradiction or update of one owner."""
    sure = confidence >= least
    return F.when(same_owner & same_value & sure, "COREFERENCE").when(same_owner & opposite & sure, "CONTRADICTS").when(same_owner & later & ~same_value, "UPDATES")


def nearest_session(terms: DataFrame, new: DataFrame) -> DataFrame:
    """(memory_id, session_id, nearest, score) for each new session: the other session of highest Jaccard over (memory_id, session_id, term)."""
    t = terms.distinct()
    size = t.groupBy("memory_id", "session_id").agg(F.count(F.lit(1)).alias("n"))
    mine = t.join(new, ["memory_id", "session_id"], "left_semi")
    other = t.join(new, ["memory_id", "session_id"], "left_anti").select("memory_id", F.col("session_id").alias("nearest"), "term")
    shared = mine.join(other, ["memory_id", "term"]).groupBy("memory_id", "session_id", "nearest").agg(F.count(F.lit(1)).alias("s"))
    both = shared.join(size, ["memory_id", "session_id"]).join(size.select("memory_id", F.col("session_id").alias("nearest"), F.col("n").alias("m")), ["memory_id", "nearest"])
    scored = both.withColumn("score", F.round(F.col("s") / (F.col("n") + F.col("m") - F.col("s")), 6))
    w = Window.partitionBy("memory_id", "session_id").orderBy(F.col("score").desc(), "nearest")
    return scored.withColumn("k", F.row_number().over(w)).where("k = 1").select("memory_id", "session_id", "nearest", "score")
