"""Nested responses brought to rows of sessions, answers and quality flags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.response_atoms import answer_atoms, checked_atoms
from cohortspark.operators.skew import broadcast_if_small


@dataclass(frozen=True)
class Imported:
    """sessions: rec_no, questionnaire_id, external_id, fhir_response_id, started_at, completed_at, is_complete; answers:
    rec_no, qq_id, option_id, grid_row_id, grid_column_id, repeat_index, response_text, response_numeric, response_date;
    flags: rec_no, qq_id, link_id, rule, severity; rejected: rec_no of responses to an unknown questionnaire."""

    sessions: DataFrame
    answers: DataFrame
    flags: DataFrame
    rejected: DataFrame


def import_responses(responses: DataFrame, study: dict[str, DataFrame]) -> Imported:
    """Rows of ``responses`` (rec_no and the response's columns) for the definitions in ``study``.

    ``study``: questionnaire (questionnaire_id, canonical_url), questionnaire_question (qq_id, questionnaire_id,
    question_id), question (question_id, link_id, question_type, numeric_min, numeric_max), response_option (option_id,
    question_id, option_value, and concept_code if known), grid_row (row_id, question_id, display_order), grid_column
    (column_id, question_id, column_value). Answers to unknown questions are skipped. An answer of a kind that
    its question doesn't take gives a flag of severity ``error`` and no row; a number out of range a row and a
    ``warning``; a grid cell whose row or column is unknown an ``error`` and no row; an unknown code a row without option.
    A response without status is complete; only complete ones have completed_at. Of several options with a code the
    least option_id counts. All definitions are small tables; the answers themselves aren't shuffled but for large definitions.
    """
    small = lambda df: broadcast_if_small(df)
    forms = study["questionnaire"].where("canonical_url is not null").groupBy("canonical_url").agg(F.max("questionnaire_id").alias("questionnaire_id"))
    heads = responses.where("rec_no is not null").select(
        "rec_no",
        F.substring_index("questionnaire", "|", 1).alias("canonical_url"),
        F.regexp_replace("subject.reference", "^[^/]*/", "").alias("external_id"),
        F.col("id").alias("fhir_response_id"),
        "authored",
        (F.coalesce("status", F.lit("completed")) == "completed").alias("is_complete"),
    )
    known = heads.join(small(forms), "canonical_url", "left")
    sessions = known.where("questionnaire_id is not null").select("rec_no", "questionnaire_id", "external_id", "fhir_response_id", F.col("authored").alias("started_at"), F.when(F.col("is_complete"), F.col("authored")).alias("completed_at"), F.col("is_complete").cast("int").alias("is_complete"))
    rejected = known.where("questionnaire_id is null").select("rec_no")

    placed = study["questionnaire_question"].groupBy("questionnaire_id", "question_id").agg(F.min("qq_id").alias("qq_id"))
    atoms = answer_atoms(responses.where("rec_no is not null")).join(small(forms.withColumnRenamed("canonical_url", "canonical")), "canonical")
    # a cell of a grid belongs to the grid's question; its row is the number at the end of its own linkId
    row = F.regexp_extract("link_id", r"\.r(\d+)$", 1)
    grids = study["question"].where("question_type = 'grid'").select(F.col("link_id").alias("parent_link_id"), F.lit(True).alias("in_grid")).distinct()
    atoms = atoms.join(small(grids), "parent_link_id", "left").withColumn("grid_row", F.when(F.col("in_grid"), row.try_cast("int"))).withColumn("link_id", F.when(F.col("in_grid"), F.col("parent_link_id")).otherwise(F.col("link_id")))
    checked = checked_atoms(atoms, study["question"]).join(small(placed), ["questionnaire_id", "question_id"])
    options = study["response_option"]
    codes = F.array("option_value", "concept_code") if "concept_code" in options.columns else F.array("option_value")
    by_code = options.select("question_id", "option_id", F.explode(codes).alias("code")).where("code is not null").groupBy("question_id", "code").agg(F.min("option_id").alias("option_id"))
    rows = study["grid_row"].groupBy("question_id", F.col("display_order").alias("grid_row")).agg(F.min("row_id").alias("grid_row_id"))
    columns = study["grid_column"].groupBy("question_id", F.col("column_value").alias("code")).agg(F.min("column_id").alias("grid_column_id"))
    full = checked.join(small(by_code), ["question_id", "code"], "left").join(small(rows), ["question_id", "grid_row"], "left").join(small(columns), ["question_id", "code"], "left")
    no_cell = F.col("in_grid").isNotNull() & (F.col("grid_row_id").isNull() | F.col("grid_column_id").isNull())
    full = full.withColumn("rule", F.when(F.col("flag") == "type", "type").when(no_cell, "grid").when(F.col("flag") == "range", "range"))
    flags = full.where("rule is not null").select("rec_no", "qq_id", "link_id", "rule", F.when(F.col("rule") == "range", "warning").otherwise("error").alias("severity"))
    kept = full.where("rule is null or rule = 'range'")
    dated = F.col("kind").isin("date", "dateTime")
    answers = kept.select(
        "rec_no", "qq_id", "option_id", "grid_row_id", "grid_column_id", "repeat_index", F.when(~dated, F.col("text")).alias("response_text"), F.coalesce("number", "rank").alias("response_numeric"), F.when(dated, F.col("text")).alias("response_date")
    )
    return Imported(sessions, answers, flags, rejected)
