"""Versioned Parquet tables: whole snapshots, published at once, with an expected version and a checksum."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators.facts import multiset_digest


class StaleVersion(RuntimeError):
    """The table has moved on from the version that a writer expected."""


class VersionedTable:
    """A folder of numbered snapshots. A snapshot is written aside and renamed into its number, which can happen only once."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def version(self) -> int:
        """Latest version; 0 before the first."""
        return (self.versions() or [0])[-1]

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{self.version() if version is None else version:08d}")

    def publish(self, df: DataFrame, expected: int | None = None) -> int:
        """Write ``df`` as the next version; with ``expected``, only on top of that one."""
        at = self.version()
        if expected is not None and expected != at:
            raise StaleVersion(f"expected {expected}, found {at}")
        aside = f"{self.folder}/_new-{uuid.uuid4().hex}"
        df.write.parquet(aside)
        target = self._path(f"{self.folder}/v{at + 1:08d}")
        if self._fs.exists(target) or not self._fs.rename(self._path(aside), target):
            self._fs.delete(self._path(aside), True)
            raise StaleVersion(f"version {at + 1} was published meanwhile")
        return at + 1

    def checksum(self, version: int | None = None) -> tuple:
        """Digest of a version's rows, whatever their order."""
        return checksum(self.read(version))

    def replicate(self, other: VersionedTable) -> int:
        """Copy the latest version to another table, verified before it counts; returns how many versions it was behind."""
        lag = self.version() - other.version()
        if lag > 0:
            rows = self.read()
            other.publish(rows)
            if other.checksum() != self.checksum():
                raise RuntimeError("replica differs")
        return lag


def checksum(df: DataFrame) -> tuple:
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    return tuple(df.agg(*(c.alias(k) for k, c in multiset_digest(row).items())).first())
