"""Upserts, deletes with cascades, deltas and shards as set operations on keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.operators.facts import last_per_key


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of both with the last by ``order`` of each key; the same changes again change nothing."""
    return last_per_key(base.unionByName(changes), keys, order)


def without(base: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not among ``keys``; null keys stay."""
    return base.join(keys.select(*on).distinct(), on, "left_anti")


def apply_delta(nodes: DataFrame, edges: DataFrame, upsert_nodes: DataFrame, upsert_edges: DataFrame, delete_nodes: DataFrame, delete_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, dangling) after deletes, upserts and the cascade of edges that lost an end.

    ``dangling`` holds upserted edges that name a missing node; a caller publishes only if it is empty.
    """
    kept = without(nodes, delete_nodes.unionByName(upsert_nodes.select("node_id")), ["node_id"]).unionByName(upsert_nodes)
    ids = kept.select("node_id")
    fresh = without(edges, delete_edges.unionByName(upsert_edges.select("edge_id")), ["edge_id"])
    ends = lambda e: e.join(ids.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi")
    whole = ends(upsert_edges)
    return kept, ends(fresh).unionByName(whole), without(upsert_edges, whole, ["edge_id"])


def one_memory(shard: DataFrame) -> None:
    """Raise unless a shard holds exactly one memory."""
    n = shard.select("memory_id").distinct().limit(2).count()
    if n != 1:
        raise ValueError("a shard holds exactly one memory")


def merge_shard(base: DataFrame, shard: DataFrame) -> DataFrame:
    """The base with the shard's memory replaced by the shard."""
    one_memory(shard)
    return without(base, shard, ["memory_id"]).unionByName(shard)


def received_high_water(jobs: DataFrame) -> DataFrame:
    """(memory_id, offset): highest offset that has left the state RECEIVED."""
    return jobs.where("state <> 'RECEIVED'").groupBy("memory_id").agg(F.max("source_offset").alias("offset"))
