"""A corpus pipeline: quality rules, line dedup, near duplicates, repeated strings, packing. Each stage is (name, function).

A function takes (spark, docs, sf_dir) and returns a DataFrame; docs is what the stage before it kept, written as Parquet
and read again. All but the last return the columns of documents.

Rows of a null or shared doc_id are documents of their own; a null one counts as the smallest. Other columns pass through
whatever their names and nulls (packing drops them), and an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm import line_dedup, ngram_jaccard, packing, quality_rules, substring_dedup
from helixmill.llm.common import ensure_checkpoint_dir, release


def counted(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them. Repeated rows are judged alike."""
    return quality_rules.keep_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or nearly do, go; each document stays, also with an empty text. Null stays null."""
    return counted(line_dedup.drop_repeated_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest doc_id (ties: of the text's hash). Repeated rows are one; texts without a word stay."""
    return ngram_jaccard.keep_one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that occur earlier go; each document stays, also with an empty text. Repeated rows are judged alike."""
    return counted(substring_dedup.drop_repeated_strings(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of documents in sequences; a null text is an empty one."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packed", packed)]

#: Token ids are out of SQL's reach; tests compare each stage's operator with a plain version, and the stages' counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each result written to the shared checkpoint folder and read again; what a stage leaves on the driver goes before the next."""
    ensure_checkpoint_dir(spark)
    out = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        release(spark)
        docs = spark.read.parquet(f"{out}/{name}")
    return docs
