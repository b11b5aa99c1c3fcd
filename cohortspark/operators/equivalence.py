"""Declared equivalences between questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.upsert import add_rows

# Relationships and degrees of confidence.
RELATIONSHIPS = ("equivalent", "near_equivalent", "related", "supersedes")
CONFIDENCE = ("high", "medium", "low")
# Changes that make a question the child of another.
CHANGES = ("reword", "option_added", "option_removed", "option_reworded", "split", "merge", "other")
#: Relationships that put two questions into one group.
GROUPING = ("equivalent", "near_equivalent")


def declare(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """``table`` (question_id_1, question_id_2, relationship, confidence) with ``pairs`` in both directions; pairs that it has stay as they are.

    Unknown relationships or degrees of confidence raise ValueError.
    """
    odd = pairs.where(~F.col("relationship").isin(*RELATIONSHIPS) | ~F.col("confidence").isin(*CONFIDENCE) | F.col("relationship").isNull() | F.col("confidence").isNull())
    if not odd.isEmpty():
        raise ValueError("unknown relationship or confidence")
    back = pairs.withColumns({"question_id_1": F.col("question_id_2"), "question_id_2": F.col("question_id_1")})
    return add_rows(table, pairs.unionByName(back), ["question_id_1", "question_id_2", "relationship"])


def record_lineage(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` (question_id, parent_question_id, change_type, effective_date) with ``rows``; those that it has stay as they are.

    An unknown change, a null end or a question that is its own parent raises ValueError.
    """
    odd = rows.where(~F.coalesce(F.col("change_type").isin(*CHANGES), F.lit(False)) | F.col("question_id").isNull() | F.col("parent_question_id").isNull() | (F.col("question_id") == F.col("parent_question_id")))
    if not odd.isEmpty():
        raise ValueError("unknown change, or not two questions")
    return add_rows(table, rows, ["question_id", "parent_question_id", "change_type"])


def neighbours(table: DataFrame, question_id: int, questions: DataFrame) -> DataFrame:
    """Direct equivalents of a question with their link_id, medium, low and high confidence in this order of words, then by link_id."""
    near = table.where(F.col("question_id_1") == question_id).select(F.col("question_id_2").alias("question_id"), "relationship", "confidence")
    return near.join(questions.select("question_id", "link_id"), "question_id").orderBy(F.desc("confidence"), "link_id")


def grouping_edges(table: DataFrame) -> DataFrame:
    """Edges for :func:`cohortspark.operators.graphs.components`."""
    return table.where(F.col("relationship").isin(*GROUPING)).select(F.col("question_id_1").alias("src"), F.col("question_id_2").alias("dst"))


def pooled(facts: DataFrame, groups: DataFrame) -> DataFrame:
    """Count and mean of numeric answers over each group of equivalent questions (node, group_id)."""
    g = groups.select(F.col("node").alias("question_id"), "group_id")
    return facts.where("response_numeric is not null").join(g, "question_id").groupBy("group_id").agg(F.count("*").alias("n"), F.avg("response_numeric").alias("mean"), F.countDistinct("question_id").alias("n_questions"))
