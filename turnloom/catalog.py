"""All queries of the engine and their SQL twins, by name."""

from __future__ import annotations

import functools
import importlib
import io
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from turnloom.plans.lineage import shared_dir

MODULES = ["algebra_queries", "text_queries", "search_queries", "fact_queries", "time_queries", "graph_queries", "compile_queries", "region_queries", "instant_queries"]


def collect(package: str, names: list[str]) -> tuple[dict[str, Callable], dict[str, str]]:
    """QUERIES and SQL of the named modules of ``package``, merged."""
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}
    for name in names:
        module = importlib.import_module(f"{package}.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per Spark context, by way of the shared folder."""
    context = spark.sparkContext
    if getattr(context, "_turnloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    at = f"{shared_dir(spark)}/turnloom-{context.applicationId}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(data.getvalue())
    out.close()
    context.addPyFile(at)
    context._turnloom_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package shipped first."""

    @functools.wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    return run
