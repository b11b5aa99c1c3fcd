"""Scale scores of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.ranges import banded
from cohortspark.operators.skew import broadcast_if_small


def scores(facts: DataFrame, rules: DataFrame, items: DataFrame, bands: DataFrame, option_values: DataFrame | None = None) -> DataFrame:
    """One row for each rule and session with an answer to one of the rule's items.

    ``facts``: session_id, respondent_id, questionnaire_id, question_id, response_numeric. ``rules``: rule_id, name,
    questionnaire_id, formula (``mean``, anything else sums). ``items``: rule_id, question_id, weight, reverse.
    ``bands``: rule_id, low, high, label, place. A reversed item counts its greatest option value (``option_values``:
    question_id, value; 0 if none) less the answer. A mean divides by the number of answers. Null answers are ignored,
    repeated ones count each time. Everything is one join and one aggregation by session, however many rules there are.
    """
    top = (option_values if option_values is not None else facts.select("question_id", F.col("response_numeric").alias("value"))).groupBy("question_id").agg(F.max("value").alias("top"))
    totals = items.groupBy("rule_id").agg(F.count("*").alias("items_total"))
    sheet = items.join(top, "question_id", "left").join(rules, "rule_id").join(totals, "rule_id")
    f = facts.where("response_numeric is not null").select("session_id", "respondent_id", "questionnaire_id", "question_id", "response_numeric")
    raw = f.join(broadcast_if_small(sheet, 10_000), ["questionnaire_id", "question_id"])
    value = F.when(F.col("reverse"), F.coalesce("top", F.lit(0.0)) - F.col("response_numeric")).otherwise(F.col("response_numeric"))
    points = value * F.coalesce("weight", F.lit(1.0))
    out = raw.groupBy("rule_id", "session_id", "respondent_id", "questionnaire_id").agg(
        F.first("name").alias("name"),
        F.when(F.first("formula") == "mean", F.avg(points)).otherwise(F.sum(points)).alias("score"),
        F.count("*").alias("items_answered"),
        F.first("items_total").alias("items_total"),
    )
    return banded(out, bands, ["rule_id"], "score").withColumnRenamed("label", "category")
