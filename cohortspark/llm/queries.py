"""The queries p6 to p8 over a study folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import leakage, packing, truncation
from cohortspark.operators.storage import stored
from cohortspark.sources.tables import table


def p6_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every text with its training sequence of 2,048 tokens."""
    return packing.packed(packing.token_counts(table(spark, folder, "documents")), packing.CAPACITY)


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the sequences are."""
    return packing.fill_report(p6_sequences(spark, folder), packing.CAPACITY)


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "eval_items").select("item_id", "text"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id").distinct()


def p7_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each test item that leaked, with the number of documents holding it."""
    return _leaks(spark, folder).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("n_held").alias("most_words"))


def _truncated(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(table(spark, folder, "documents").select("doc_id", "text", "source"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _truncated(spark, folder).select("doc_id")


def p8_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Share of cut documents for each source."""
    cut = stored(_truncated(spark, folder), "truncated").groupBy("source").agg(F.count("*").alias("n_cut"))
    every = table(spark, folder, "documents").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n_documents"))
    return every.join(cut, "source", "left").select("source", "n_documents", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), (F.coalesce("n_cut", F.lit(0)) / F.col("n_documents")).alias("share"))


QUERIES = {f.__name__: f for f in (p6_sequences, p6_fill, p7_found, p7_leaked_items, p8_found, p8_sources)}
SQL: dict[str, str] = {}
