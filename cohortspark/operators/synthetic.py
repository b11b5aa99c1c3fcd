"""Synthetic answers for trials: the same study and seed always give the same rows, on any number of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _draw(*parts) -> Column:
    """A number from 0 up to 1, fixed by its parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def synthetic_answers(spark: SparkSession, questions: DataFrame, options: DataFrame, sessions: int, seed: int = 1, answered: float = 0.9) -> DataFrame:
    """session_id, question_id, option_value, response_numeric, response_text, response_date for ``sessions`` sessions.

    ``questions``: question_id, question_type, numeric_min, numeric_max; ``options``: question_id, option_value,
    display_order. Choices are drawn evenly (one an answer, several choices each by itself), numbers evenly from their
    range (0 to 10 without one). Each question is answered with the chance ``answered``. Sessions are generated in
    parallel; the questions, at most some hundreds, are held as one array.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("display_order", "option_value"))), lambda o: o["option_value"])
    held = questions.join(options.groupBy("question_id").agg(ordered.alias("values")), "question_id", "left")
    sheet = held.agg(F.array_sort(F.collect_list(F.struct("question_id", "question_type", "numeric_min", "numeric_max", "values"))).alias("sheet"))
    rows = spark.range(1, sessions + 1).select(F.col("id").alias("session_id"), sheet.scalar().alias("sheet")).select("session_id", F.inline("sheet"))
    key = (F.lit(seed), F.col("session_id"), F.col("question_id"))
    rows = rows.where(_draw(F.lit("answered"), *key) < answered)
    several = F.filter("values", lambda v: _draw(F.lit("each"), *key, v) < 0.4)
    one = F.filter(F.array(F.try_element_at("values", (F.floor(_draw(F.lit("one"), *key) * F.size("values")) + 1).cast("int"))), lambda v: v.isNotNull())
    picked = F.when(F.col("question_type") == "multiple_choice", several).when(F.size("values") > 0, one)
    rows = rows.withColumn("option_value", F.explode_outer(picked))
    low, high = F.coalesce("numeric_min", F.lit(0.0)), F.coalesce("numeric_max", F.lit(10.0))
    u, kind = _draw(F.lit("value"), *key), F.col("question_type")
    return rows.select(
        "session_id",
        "question_id",
        "option_value",
        F.when(kind.isin("numeric", "slider"), F.round(low + (high - low) * u, 1)).alias("response_numeric"),
        F.when(kind == "boolean", F.when(u < 0.5, "true").otherwise("false")).when(kind == "text", F.concat(F.lit("answer "), F.floor(u * 1000).cast("string"))).alias("response_text"),
        F.when(kind.isin("date", "datetime"), F.date_add(F.lit("2024-01-01").cast("date"), F.floor(u * 365).cast("int"))).alias("response_date"),
    ).where("option_value is not null or response_numeric is not null or response_text is not null or response_date is not null")
