"""Sessions and plain Parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def build_session(app: str = "lakeloom", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive planning, UTC and ANSI semantics; conf has option names with _ for '.'."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # a shuffled join hashes a side only where each of its partitions is known to be small
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    }
    for key, value in (defaults | {k.replace("_", "."): str(v) for k, v in conf.items()}).items():
        b = b.config(key, value)
    return b.getOrCreate()


def register_listing_tables(spark: SparkSession, tables: dict[str, str]) -> None:
    """Each Parquet file or directory under its bare name."""
    for name, path in tables.items():
        spark.read.parquet(path).createOrReplaceTempView(name)


def register_directory(spark: SparkSession, directory: str, names: tuple[str, ...] = TABLES) -> None:
    register_listing_tables(spark, {n: f"{directory.rstrip('/')}/{n}.parquet" for n in names})


_schemas: dict[tuple[str, float], StructType] = {}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A Parquet table. Its schema is read once for each state of a local path, so that later calls need no job for it."""
    path = f"{directory.rstrip('/')}/{name}.parquet"
    key = (path, os.stat(path).st_mtime) if os.path.exists(path) else None
    if key is None:
        return spark.read.parquet(path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def physical_plan(spark: SparkSession, sql: str) -> str:
    """The physical plan of one statement as text."""
    return spark.sql(sql)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
