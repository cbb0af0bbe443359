"""Queries of this subpackage for the driver's registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, line_dedup, mixing, near_dedup, oracle, packing, quality_cnn, sharding, spotsigs, substring_dedup, vector_graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


N_SHARDS = 64


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies stay together; shards even out in bytes."""
    return sharding.lpt_shards(table(spark, sf_dir, "documents"), [F.col("text")], F.octet_length("text"), "doc_id", N_SHARDS)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_line_runs(table(spark, sf_dir, "documents"))


#: Weights of nodes of the tree domain / language / source; every other node weighs 1.
WEIGHTS = {("web",): 3.0, ("books",): 2.0, ("web", "en"): 4.0, ("books", "en"): 3.0, ("code", "en"): 2.0}


def domain(source: Column) -> Column:
    """The documents name no domain: a source belongs to one of three by the digits in its name."""
    n = F.pmod(F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)"), F.lit(3))
    return F.when(n == 0, "web").when(n == 1, "books").otherwise("code")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, [domain(F.col("source")), F.col("lang"), F.col("source")], mixing.tokens(F.col("text")), "doc_id", weights=WEIGHTS)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


SEQUENCE_TOKENS = 2048


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", mixing.tokens(F.col("text")), SEQUENCE_TOKENS)


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_classes(table(spark, sf_dir, "documents"))


def op7_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.similar_vectors(table(spark, sf_dir, "embeddings"))


QUALITY_AT_LEAST = 0.5


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_cnn.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_cnn.score(docs, model, ["doc_id"])
    return scored.withColumn("keep", F.coalesce(F.col("quality") >= QUALITY_AT_LEAST, F.lit(False)))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sharding, op2_line_dedup, op3_mixing, op4_html_text, op5_packing, op6_spotsigs, op7_vector_graph, op8_quality, op9_substring_dedup, op10_near_dedup)}

ORACLE_SQL: dict[str, str] = {"op1_sharding": oracle.sharding(N_SHARDS), "op3_mixing": oracle.mixing(WEIGHTS), "op6_spotsigs": oracle.fingerprint_classes(), "op7_vector_graph": oracle.similar_vectors()}
