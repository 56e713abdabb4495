"""Operator: percentiles of very many values per group, from digests that add up.

A value is quantised to one of 2**BITS ordered steps (log scale, so its relative error is bounded); a
digest is a set of counted nodes of the binary tree over these steps.  Two digests merge by adding the
counts of equal nodes.  Compression moves counts up where a node, its sibling and their parent hold
little, so a digest keeps at most 3 / EPSILON * BITS nodes and every rank is off by EPSILON * n at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

BITS = 16
#: Rank error as a share of the values, and steps per doubling of 1 + value.
EPSILON, STEPS = 0.005, 1024
TOP = (1 << BITS) - 1


def quantised(value: Column) -> Column:
    """Leaf of a value; null for null, NaN, infinite and negative ones. Values past the universe share its last step."""
    good = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf"))
    return F.when(good, F.least(F.floor(F.log2(1 + value) * STEPS), F.lit(TOP)).cast("bigint") + (1 << BITS))


def value_of(leaf: np.ndarray) -> np.ndarray:
    """Middle of a leaf's step."""
    return 2 ** ((leaf + 0.5) / STEPS) - 1


def compress(node: np.ndarray, count: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """The digest with light triples (two siblings and their parent) gathered in the parent, bottom up."""
    n = int(count.sum())
    limit = int(epsilon * n / BITS)
    if limit < 1:
        return node, count
    done_node, done_count = [], []
    node, count = node.astype("i8"), count.astype("i8")
    for level in range(BITS, 0, -1):
        here = node >= 1 << level
        deep, many = node[here], count[here]
        node, count = node[~here], count[~here]
        parents, at = np.unique(deep >> 1, return_inverse=True)
        if not len(parents):
            continue
        own = np.zeros(len(parents), "i8")
        k = np.searchsorted(parents, node)
        match = (k < len(parents)) & (parents[np.minimum(k, len(parents) - 1)] == node)
        own[k[match]] = count[match]
        both = np.bincount(at, many, len(parents)).astype("i8")
        light = both + own <= limit
        kept = ~light[at]
        done_node.append(deep[kept])
        done_count.append(many[kept])
        stays = ~match
        stays[match] = ~light[k[match]]
        node = np.concatenate([node[stays], parents[light]])
        count = np.concatenate([count[stays], (both + own)[light]])
    return np.concatenate([*done_node, node]), np.concatenate([*done_count, count])


def _schema(df: DataFrame, keys: list[str]) -> StructType:
    return StructType([df.schema[k] for k in keys]).add("node", LongType()).add("count", LongType())


def merge(digests: DataFrame, keys: list[str], epsilon: float = EPSILON) -> DataFrame:
    """One digest (node, count) per ``keys`` from rows of any digests: equal nodes are added, then compressed.

    A group has at most 2**(BITS + 1) nodes, however many values it stands for.
    """
    added = digests.groupBy(*keys, "node").agg(F.sum("count").alias("count"))

    def squeeze(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        node, count = compress(pdf["node"].to_numpy(), pdf["count"].to_numpy(), epsilon)
        return pd.DataFrame({**dict(zip(keys, group)), "node": node, "count": count})

    return added.groupBy(*keys).applyInPandas(squeeze, _schema(digests, keys))


def digest(rows: DataFrame, keys: list[str], value: str, epsilon: float = EPSILON) -> DataFrame:
    """The digest of a numeric column per ``keys``; values that are no measurement (see ``quantised``) are left out."""
    leaves = rows.select(*keys, quantised(F.col(value).cast("double")).alias("node")).where("node is not null")
    return merge(leaves.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("count")), keys, epsilon)


def percentiles(digests: DataFrame, keys: list[str], levels: list[float], epsilon: float = EPSILON) -> DataFrame:
    """(keys, n, level, value, rank_error): the value at each level, with the most values its rank can be off by."""
    out = StructType([digests.schema[k] for k in keys]).add("n", LongType()).add("level", DoubleType()).add("value", DoubleType()).add("rank_error", LongType())

    def read(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        node, count = pdf["node"].to_numpy("i8"), pdf["count"].to_numpy("i8")
        level = np.floor(np.log2(node)).astype("i8")
        last = ((node + 1) << (BITS - level)) - 1 - (1 << BITS)
        order = np.lexsort((-level, last))
        sums, n = np.cumsum(count[order]), int(count.sum())
        at = np.searchsorted(sums, np.maximum(1, np.ceil(np.array(levels) * n)))
        return pd.DataFrame({**dict(zip(keys, group)), "n": n, "level": levels, "value": value_of(last[order][at]), "rank_error": int(epsilon * n)})

    return digests.groupBy(*keys).applyInPandas(read, out)


class DigestStore:
    """Day digests in a shared folder, a part for each delivery, that any period's percentiles are read from.

    A day that is delivered again is read from its latest part; all other days stay as they are.  ``keys`` are
    the columns of a group besides ``day``.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], epsilon: float = EPSILON) -> None:
        self.spark, self.folder, self.keys, self.epsilon = spark, folder.rstrip("/"), keys, epsilon

    def _parts(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        n = 0
        while fs.exists(path(f"{self.folder}/part={n + 1}/_SUCCESS")):
            n += 1
        return list(range(1, n + 1))

    def publish(self, rows: DataFrame, value: str) -> DataFrame:
        """Digest ``rows`` (keys, day, value) and store them as the next part; half of the error is left for merging days."""
        digests = digest(rows, [*self.keys, "day"], value, self.epsilon / 2)
        digests.write.mode("overwrite").parquet(f"{self.folder}/part={len(self._parts()) + 1}")
        return self.days()

    def days(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """(keys, node, count, day) of the stored days from ``first`` to ``last``, both included; without bounds all, undated ones too."""
        parts = self._parts()
        got = self.spark.read.option("basePath", self.folder).parquet(*(f"{self.folder}/part={k}" for k in parts))
        if first is not None:
            got = got.where(F.col("day") >= F.lit(first).cast("date"))
        if last is not None:
            got = got.where(F.col("day") <= F.lit(last).cast("date"))
        if len(parts) == 1:
            return got.drop("part")
        latest = got.groupBy(F.col("day").alias("_day")).agg(F.max("part").alias("_part"))
        return got.join(latest, F.col("day").eqNullSafe(F.col("_day")) & (F.col("part") == F.col("_part")), "left_semi").drop("part")

    def by_day(self, levels: list[float], first: str | None = None, last: str | None = None) -> DataFrame:
        """Percentiles of each stored day."""
        return percentiles(self.days(first, last), [*self.keys, "day"], levels, self.epsilon)

    def of_period(self, levels: list[float], first: str | None = None, last: str | None = None) -> DataFrame:
        """Percentiles of all days of a period together, by adding the days' nodes."""
        whole = merge(self.days(first, last).drop("day"), self.keys, self.epsilon / 2)
        return percentiles(whole, self.keys, levels, self.epsilon)
