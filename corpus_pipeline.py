"""Documents to packed sequences: five stages, each a table written before the next one reads it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.exact_dedup import kept_rows, one_of_equal
from cohortlens.llm.packing import pack_documents
from cohortlens.llm.parity_join import similar_documents
from cohortlens.llm.quality_rules import quality_verdicts
from cohortlens.llm.repeated_phrases import drop_repeats
from cohortlens.llm.spark_util import read, row_key, staged
from cohortlens.sources.materialize import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A null, empty or very short text goes. Repeated rows share a verdict; rows without an id are judged one by one. All
    columns stay as they are, whatever their names; an empty table gives none.
    """
    return kept_rows(docs, quality_verdicts(docs, read(spark, sf_dir, "labels"), with_key=True))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the smallest id; a document without an id only if all of the group have none.

    Null and empty texts are equal. Of repeated rows one stays. All columns stay; an empty table gives none.
    """
    return one_of_equal(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts, that of the smallest id; documents without words are a group each.

    Texts are compared under their row keys, so that rows that share an id or have none are told apart.
    """
    keys = docs.select(row_key().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"))
    texts = docs.select(row_key().alias("row_key"), "text")
    placed = staged(similar_documents(texts, doc_id="row_key").select(F.col("doc_id").alias("row_key"), "component_id").distinct().join(keys.distinct(), "row_key"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first")
    kept = placed.groupBy("component_id").agg(first).select("first.doc_id", "first.row_key", F.lit(True).alias("kept"))
    return kept_rows(docs, kept)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur earlier; a document of which nothing is left goes.

    A text that loses no word stays as it is; of others the words that are left are joined by spaces.
    """
    left = drop_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of sequences of at most 2,048 tokens.

    A null or empty text is one piece of one token; repeated rows are packed once each; a null id stays null; other columns are
    not read; an empty table gives none.
    """
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality), ("exact dedup", exact), ("similarity join", near), ("substring dedup", repeats), ("packing", packed),
]

#: The forest of the first stage has no SQL; tests compare exact dedup, the similarity join and substring dedup with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    Nulls, ties, repeated rows and clashing columns are as the stages say; an empty table gives no row.
    """
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
