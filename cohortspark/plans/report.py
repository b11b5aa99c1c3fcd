"""A study's report: all figures computed at once for all questions, then written as Markdown or CSV."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.skew import broadcast_if_small


def overview(sessions: DataFrame) -> DataFrame:
    """One row: respondents, sessions, percentage completed, first and last day."""
    return sessions.agg(
        F.countDistinct("respondent_id").alias("n_respondents"),
        F.count("*").alias("n_sessions"),
        F.round(F.avg(F.col("is_complete").cast("double")) * 100, 1).alias("pct_complete"),
        F.min("session_date_key").alias("first_day"),
        F.max("session_date_key").alias("last_day"),
    )


def score_statistics(scores: DataFrame) -> DataFrame:
    """Count, mean, median and range of each rule's scores."""
    return scores.groupBy("name").agg(F.count("*").alias("n"), F.round(F.avg("score"), 1).alias("mean"), F.median("score").alias("median"), F.min("score").alias("least"), F.max("score").alias("most"))


def choice_table(facts: DataFrame, questions: DataFrame, options: DataFrame) -> DataFrame:
    """Answers by option with the option's text and place; options that the list lacks have neither."""
    n = facts.where("option_value is not null").groupBy("question_id", "option_value").agg(F.count("*").alias("n"))
    total = n.groupBy("question_id").agg(F.sum("n").alias("total"))
    labels = options.select("question_id", "option_value", "option_text", "display_order").dropDuplicates(["question_id", "option_value"])
    j = n.join(total, "question_id").join(labels, ["question_id", "option_value"], "left").join(questions.select("question_id", "link_id"), "question_id")
    return j.select("link_id", "option_value", "option_text", "display_order", "n", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 1).alias("pct"))


def open_answers(facts: DataFrame) -> DataFrame:
    """Answers with text or a date, by question."""
    return facts.where("response_text is not null or response_date is not null").groupBy("question_id").agg(F.count("*").alias("n"))


def grid_table(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Count of each column and its percentage of the row, for cells (grid, row, code); percentages round half to even."""
    n = cells.groupBy("grid", "row").agg(F.count("*").alias("total"), *(F.count_if(F.col("code") == c).alias(f"n_{c}") for c in columns))
    return n.select("grid", "row", "total", *(f"n_{c}" for c in columns), *(F.when(F.col("total") > 0, F.bround(F.lit(100.0) * F.col(f"n_{c}") / F.col("total"), 1)).alias(f"pct_{c}") for c in columns))


def question_list(facts: DataFrame, questions: DataFrame, placements: DataFrame) -> DataFrame:
    """Questions that were answered, with their place and the link_id of their parent placement's question."""
    used = facts.select("questionnaire_id", "question_id").distinct()
    p = placements.select("qq_id", "questionnaire_id", "question_id", "display_order", "parent_qq_id")
    parent = placements.select(F.col("qq_id").alias("parent_qq_id"), F.col("question_id").alias("_parent"))
    names = questions.select("question_id", "link_id", "question_text", "question_type")
    above = questions.select(F.col("question_id").alias("_parent"), F.col("link_id").alias("parent_link_id"))
    return used.join(p, ["questionnaire_id", "question_id"]).join(names, "question_id").join(parent, "parent_qq_id", "left").join(above, "_parent", "left").select("questionnaire_id", "display_order", "link_id", "question_text", "question_type", "parent_link_id")


def dictionary(questions: DataFrame, options: DataFrame, placements: DataFrame) -> DataFrame:
    """The data dictionary: one row for each question with its valid values and the questionnaires that ask it, each in order."""
    joined = lambda order, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("string")), " | ")
    values = options.groupBy("question_id").agg(joined("display_order", "option_value").alias("valid_values"))
    used = placements.where("status = 'active'").groupBy("question_id").agg(joined("questionnaire_id", "qq_id").alias("placements"))
    return questions.join(values, "question_id", "left").join(used, "question_id", "left").select("question_id", "link_id", "question_text", "question_type", "numeric_min", "numeric_max", "valid_values", "placements")


def bundle(facts: DataFrame, questions: DataFrame, options: DataFrame) -> DataFrame:
    """Answers with the texts of question and option, for reading without joins."""
    labels = options.select("question_id", "option_value", "option_text").dropDuplicates(["question_id", "option_value"])
    return facts.join(broadcast_if_small(questions.select("question_id", "link_id", "question_text", "question_type")), "question_id", "left").join(labels, ["question_id", "option_value"], "left")


def markdown(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A report table as Markdown; more than ``limit`` rows raise ValueError, as a report is no place for them."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{title}: more than {limit} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
    return "\n".join(lines) + "\n"


def as_csv(df: DataFrame, limit: int = 100_000) -> str:
    """A small table as CSV text; larger ones raise ValueError."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([df.columns, *rows])
    return out.getvalue()
