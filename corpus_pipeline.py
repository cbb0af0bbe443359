"""A corpus pipeline in five stages, each on all that its predecessor kept.

quality classifier -> line dedup -> near-duplicate removal -> mixing to target weights -> best-fit packing.
Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import line_dedup, mixing, near_dedup, packing, quality_cnn
from lakeloom.llm.queries import QUALITY_AT_LEAST, SEQUENCE_TOKENS, WEIGHTS, domain, table
from lakeloom.llm.scratch import Scratch

#: Share of the corpus' tokens that the mixture takes. Weights steer it; nothing is taken twice, so that the
#: packed corpus holds each document once.
MIX_FRACTION = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being good is at least QUALITY_AT_LEAST.

    Null and empty texts go. Rows with a null id or null in other columns, repeated rows and long texts are judged by their text like any other; ties at
    the threshold stay. Further columns, clashing names included, are carried. An empty table stays empty.
    """
    model = quality_cnn.train(docs, table(spark, sf_dir, "labels"))
    return quality_cnn.keep_good(docs, model, QUALITY_AT_LEAST)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated runs of lines; n_chars, where it is a column, follows the text.

    Null and empty texts and rows with a null id stay as they are; documents that have no text left go. Of ties the least (id, line) stays. Rows that repeat
    an id are each cut. Long texts are read whole, further columns are carried, a column named removed_lines is lost. An empty table stays empty.
    """
    out = line_dedup.dedup_line_runs(docs).drop("removed_lines")
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns if c.lower() != "removed_lines"])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least id, of each group of near copies.

    Rows with a null id, and texts without a word (null and empty ones too), are in no group and stay; rows that repeat a kept id stay. Long texts are read whole. Further
    columns are carried. An empty table stays empty.
    """
    return near_dedup.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that begin inside their leaf's budget, whole.

    Null languages and sources are leaves of their own. Rows with a null id are taken or left together, as are rows that repeat an id; of ties in the order the id
    decides. Documents without tokens (null, empty or blank) go, and long ones count all their tokens. Further columns are carried. An empty table stays empty.
    """
    taken = mixing.mix(docs, [domain(F.col("source")), F.col("lang"), F.col("source")], mixing.tokens(F.col("text")), "doc_id", fraction=MIX_FRACTION, weights=WEIGHTS, max_epochs=1)
    taken = taken.select(F.col("doc_id").alias("_taken_id")).distinct()
    some = F.trim(F.translate(docs["text"], "\t\n\r", "   ")) != ""
    return docs.filter(some).join(taken, docs["doc_id"].eqNullSafe(taken["_taken_id"]), "left_semi")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens go: sequence and offset.

    Documents without tokens have no place; rows with a null id and repeated rows are packed as often as they come; long texts are cut at full sequences. Of
    documents of one length a hash of the id decides. Other columns are not read. An empty table gives none.
    """
    return packing.pack(docs, "doc_id", mixing.tokens(F.col("text")), SEQUENCE_TOKENS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality", quality), ("line_dedup", lines), ("near_dedup", near), ("mixing", mixture), ("packing", packed)]

#: The classifier and the sketches are beyond SQL; the whole pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
