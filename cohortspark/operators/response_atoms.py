"""Nested questionnaire responses as answer atoms with typed values and quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds of value that a question type accepts.
ACCEPTED = {
    "single_choice": ("coding",), "likert": ("coding",), "multiple_choice": ("coding",), "ranked": ("coding",), "sata_other": ("coding", "string"), "grid": ("coding",),
    "boolean": ("boolean",), "text": ("string",), "numeric": ("decimal", "integer"), "slider": ("decimal", "integer"), "date": ("date",), "datetime": ("dateTime", "date"),
}


def _kind(a: Column) -> Column:
    return F.coalesce(
        F.when(a["valueCoding"].isNotNull(), "coding"),
        F.when(a["valueBoolean"].isNotNull(), "boolean"),
        F.when(a["valueDecimal"].isNotNull(), "decimal"),
        F.when(a["valueInteger"].isNotNull(), "integer"),
        F.when(a["valueDate"].isNotNull(), "date"),
        F.when(a["valueDateTime"].isNotNull(), "dateTime"),
        F.when(a["valueString"].isNotNull(), "string"),
    )


def answer_atoms(responses: DataFrame, key: str = "rec_no") -> DataFrame:
    """One row for each answer with a value, at any depth: key, external_id, canonical, status, is_complete, link_id, parent_link_id, repeat_index, kind, code, number, text, flag, rank.

    The external id follows the first slash of the subject, the canonical address ends at a bar. A missing status counts
    as completed. repeat_index numbers the repeats of a group with the same linkId within its parent, from 0, and is null
    for answers outside groups that have child items.
    """
    schema = responses.schema["item"].dataType.elementType
    heads = responses.select(
        key,
        F.regexp_replace("subject.reference", "^[^/]*/", "").alias("external_id"),
        F.substring_index("questionnaire", "|", 1).alias("canonical"),
        F.coalesce("status", F.lit("completed")).alias("status"),
        F.col("item").alias("items"),
        F.lit(None).cast("string").alias("parent_link_id"),
        F.lit(None).cast("int").alias("repeat_index"),
    )
    parts, level = [], heads
    while True:
        rows = level.select(*[c for c in level.columns if c != "items"], "items", F.posexplode("items").alias("place", "item")).where("item is not null")
        before = F.slice("items", F.lit(1), F.col("place"))
        same = F.size(F.filter(before, lambda x: x["linkId"].eqNullSafe(F.col("item.linkId")))).alias("nth")
        rows = rows.select(*[c for c in level.columns if c != "items"], "item", same)
        parts.append(rows.select(key, "external_id", "canonical", "status", "parent_link_id", "repeat_index", F.col("item.linkId").alias("link_id"), F.posexplode("item.answer").alias("answer_no", "a")))
        if "item" not in schema.fieldNames():
            break
        level = rows.where(F.size("item.item") > 0).select(key, "external_id", "canonical", "status", F.col("item.item").alias("items"), F.col("item.linkId").alias("parent_link_id"), F.coalesce("repeat_index", "nth").alias("repeat_index"))
        schema = schema["item"].dataType.elementType
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    a = F.col("a")
    rank = F.try_element_at(F.filter(a["extension"], lambda x: x["url"].rlike("(?i)ordinal")), F.lit(1))["valueDecimal"]
    out = out.withColumn("kind", _kind(a)).where("kind is not null")
    return out.select(
        key, "external_id", "canonical", "status", (F.col("status") == "completed").alias("is_complete"), "link_id", "parent_link_id", "repeat_index", "answer_no", "kind",
        F.when(F.col("kind") == "coding", F.coalesce(a["valueCoding"]["code"], a["valueCoding"]["display"])).alias("code"),
        F.when(F.col("kind").isin("decimal", "integer"), F.coalesce(a["valueDecimal"], a["valueInteger"].cast("double"))).alias("number"),
        F.coalesce(a["valueBoolean"].cast("string"), a["valueDate"], a["valueDateTime"], a["valueString"]).alias("text"),
        F.when(F.col("kind") == "coding", rank).alias("rank"),
    )


def checked_atoms(atoms: DataFrame, questions: DataFrame) -> DataFrame:
    """``atoms`` of known questions with ``flag``: ``type`` if the question's type doesn't take the value, ``range`` if a number lies outside its bounds (bounds belong to it), else null.

    Answers to unknown questions are left out. A question without bounds has no range.
    """
    q = questions.groupBy("link_id").agg(F.min(F.struct("question_id", "question_type", "numeric_min", "numeric_max")).alias("q")).select("link_id", "q.*")
    takes = F.create_map(*(F.lit(x) for t, kinds in ACCEPTED.items() for x in (t, ",".join(kinds))))
    known = atoms.join(q, "link_id")
    fits = F.array_contains(F.split(F.coalesce(F.try_element_at(takes, F.col("question_type")), F.lit("")), ","), F.col("kind"))
    outside = (F.col("number") < F.col("numeric_min")) | (F.col("number") > F.col("numeric_max"))
    return known.withColumn("flag", F.when(~fits, "type").when(F.coalesce(outside, F.lit(False)), "range"))
