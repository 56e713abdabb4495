"""Lexical indexes of a folder's turns: written once in the shared folder, read by every search until the turns change."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.text import content_terms
from turnloom.operators import search as S
from turnloom.plans.lineage import shared_dir
from turnloom.sources.tables import table


def state_of(spark: SparkSession, path: str) -> str:
    """Hash of the names, sizes and times of the files at ``path``: another one means other content."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    seen = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)
    return hashlib.sha256(repr((path, seen)).encode()).hexdigest()[:24]


class LexicalIndex:
    """Postings (scope, id, term, tf, length), document frequencies (scope, term, df) and sizes (scope, total, average) of turns or of sessions.

    Rows are sorted by scope and term, so that a search reads the row groups it asks for.  An index is whole
    once ``sizes``, which is written last, is; it is named by the state of the turns, so a changed table gets a
    new one and what reads the old one is not disturbed.
    """

    def __init__(self, spark: SparkSession, folder: str, unit: str) -> None:
        self.spark, self.folder, self.unit = spark, folder, unit
        self.path = f"{shared_dir(spark)}/index-{unit}-{state_of(spark, f'{folder}/turns.parquet')}"

    def _whole(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/sizes/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _of_turns(self) -> tuple[DataFrame, DataFrame]:
        t = table(self.spark, self.folder, "turns", "turn_no", "memory_id", "raw_text")
        return S.postings(t, "memory_id", "turn_no", "raw_text"), t.groupBy(F.col("memory_id").alias("scope")).agg(F.count(F.lit(1)).alias("total"))

    def _of_sessions(self) -> tuple[DataFrame, DataFrame]:
        """A session as document; a term's tf is the number of the session's turns with it."""
        t = table(self.spark, self.folder, "turns", "memory_id", "session_id", "raw_text")
        per = t.select("memory_id", "session_id", F.explode(content_terms(F.col("raw_text"))).alias("term")).groupBy("memory_id", "session_id", "term").agg(F.count(F.lit(1)).alias("tf"))
        length = per.groupBy("memory_id", "session_id").agg(F.sum("tf").alias("length"))
        post = per.join(length, ["memory_id", "session_id"]).select(F.col("memory_id").alias("scope"), F.col("session_id").alias("id"), "term", "tf", "length")
        return post, length.groupBy(F.col("memory_id").alias("scope")).agg(F.count(F.lit(1)).alias("total"))

    def build(self) -> None:
        """Write the index if the turns as they are have none."""
        if self._whole():
            return
        post, n = self._of_turns() if self.unit == "turns" else self._of_sessions()
        width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

        def write(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
            return self.spark.read.parquet(f"{self.path}/{name}")

        post = write(post.repartitionByRange(width, "scope", "term").sortWithinPartitions("scope", "term", "id"), "postings")
        write(S.document_frequency(post).repartitionByRange(width, "scope", "term").sortWithinPartitions("scope", "term"), "df")
        sums = post.groupBy("scope").agg(F.sum("tf").alias("words"))
        write(n.join(sums, "scope", "left").select("scope", "total", (F.coalesce("words", F.lit(0)) / F.col("total")).alias("average")), "sizes")

    def read(self, name: str) -> DataFrame:
        """``postings``, ``df`` or ``sizes``."""
        self.build()
        return self.spark.read.parquet(f"{self.path}/{name}")
