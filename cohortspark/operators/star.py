"""The star schema of a study: dimensions, facts and materialised aggregates from the transactional tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.semantics import day_of_week, half_even_int, iso_date, iso_timestamp, plain_number, seconds_between
from cohortspark.operators.skew import broadcast_if_small, spread_join

CHOICES = ("single_choice", "multiple_choice", "sata_other", "likert", "ranked")


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c).cast("int"), F.lit(0)) != 0


def dim_study(study: DataFrame) -> DataFrame:
    """Studies with real dates; texts that are no full dates become null."""
    return study.select("study_id", "name", "description", "principal_investigator", "irb_number", iso_date(F.col("start_date")).alias("start_date"), iso_date(F.col("end_date")).alias("end_date"))


def dim_questionnaire(questionnaire: DataFrame) -> DataFrame:
    """Questionnaires; without a study -1, without a status ``unknown``."""
    return questionnaire.select("questionnaire_id", F.coalesce("study_id", F.lit(-1)).alias("study_id"), "name", "version", "canonical_url", F.coalesce("fhir_status", F.lit("unknown")).alias("fhir_status"))


def dim_concept(concept: DataFrame) -> DataFrame:
    return concept.select("concept_id", "concept_name", "domain_id", "vocabulary_id", "concept_class_id", "standard_concept", "concept_code")


def dim_question(question: DataFrame, concept: DataFrame) -> DataFrame:
    """Questions with the name, vocabulary and code of their concept, null where it has none or an unknown one."""
    return question.join(concept.select("concept_id", "concept_name", "vocabulary_id", "concept_code"), "concept_id", "left")


def dim_response_option(option: DataFrame, concept: DataFrame) -> DataFrame:
    """Options; the code comes from the concept, the code system from the option."""
    known = concept.select("concept_id", "concept_name", F.col("concept_code").alias("_code"))
    return option.join(known, "concept_id", "left").select("option_id", "question_id", "option_text", "option_value", "display_order", "option_set_id", _flag("is_other").alias("is_other"), _flag("is_exclusive").alias("is_exclusive"), "concept_id", "concept_name", F.col("_code").alias("concept_code"), "concept_system")


def dim_respondent(respondent: DataFrame) -> DataFrame:
    return respondent.select("respondent_id", F.coalesce("study_id", F.lit(-1)).alias("study_id"), "external_id", F.lit(None).cast("date").alias("enrollment_date"))


def dim_session(session: DataFrame, respondent: DataFrame, after: int = 0) -> DataFrame:
    """Sessions beyond the watermark whose respondent exists; unreadable times are null, the duration is rounded half to even."""
    s = spread_join(session.where(F.col("session_id") > after), respondent.select("respondent_id", F.col("study_id").alias("_study")), ["respondent_id"], F.col("session_id"))
    started, completed = iso_timestamp(F.col("started_at")), iso_timestamp(F.col("completed_at"))
    s = s.withColumn("started_at", started).withColumn("completed_at", completed)
    return s.select(
        "session_id",
        "questionnaire_id",
        "respondent_id",
        F.coalesce("_study", F.lit(-1)).alias("study_id"),
        "started_at",
        "completed_at",
        _flag("is_complete").alias("is_complete"),
        "admin_mode",
        _flag("is_proxy").alias("is_proxy"),
        half_even_int(seconds_between(F.col("started_at"), F.col("completed_at"))).alias("duration_sec"),
        F.to_date(F.coalesce("completed_at", "started_at")).alias("session_date_key"),
    )


def fact_response(response: DataFrame, session: DataFrame, placement: DataFrame, question: DataFrame, respondent: DataFrame, option: DataFrame, after: int = 0) -> DataFrame:
    """One row for each answer beyond the watermark, with its session, placement, question, respondent and option looked up.

    An answer without any of the first four is left out; a respondent with many sessions is spread over tasks. The numeric value is the answer's own, else for choices the
    option's value as a number; boolean questions get a typed value from ``true`` and ``false``.
    """
    own = ["response_id", "session_id", "qq_id", "option_id", "grid_row_id", "grid_column_id", "repeat_index", "response_text", "response_numeric", "response_date"]
    r = response.where(F.col("response_id") > after).select(*own)
    s = session.select("session_id", "respondent_id", "started_at", "completed_at", "admin_mode", "is_proxy", "interviewer_id")
    p = placement.select("qq_id", "questionnaire_id", "question_id")
    q = question.select("question_id", "question_type", F.col("concept_id").alias("question_concept_id"))
    who = respondent.select("respondent_id", F.coalesce("study_id", F.lit(-1)).alias("study_id"))
    o = option.select("option_id", "option_value", F.col("concept_id").alias("option_concept_id"))
    # the respondent is looked up by session, so the answers themselves are only shuffled by session; definitions are few
    s = spread_join(s, who, ["respondent_id"], F.col("session_id"))
    j = r.join(s, "session_id").join(broadcast_if_small(p), "qq_id").join(broadcast_if_small(q), "question_id")
    small = broadcast_if_small(o)
    if small is o:  # answers without an option go their own way, so that they don't meet in one task
        j = j.where("option_id is not null").join(o, "option_id", "left").unionByName(j.where("option_id is null"), allowMissingColumns=True)
    else:
        j = j.join(small, "option_id", "left")
    number = F.when(F.col("response_numeric").isNotNull(), F.col("response_numeric")).when(F.col("question_type").isin(*CHOICES), plain_number(F.col("option_value")))
    yes_no = F.when(F.col("question_type") == "boolean", F.when(F.col("response_text") == "true", True).when(F.col("response_text") == "false", False))
    started, completed = iso_timestamp(F.col("started_at")), iso_timestamp(F.col("completed_at"))
    return j.select(
        "response_id", "session_id", "respondent_id", "questionnaire_id", "study_id", "question_id", "qq_id", "option_id", "grid_row_id", "grid_column_id", "repeat_index",
        "response_text", number.alias("response_numeric"), iso_date(F.col("response_date")).alias("response_date"), yes_no.alias("response_boolean"), "option_value",
        "question_concept_id", "option_concept_id", F.to_date(F.coalesce(completed, started)).alias("response_date_key"), F.to_date(started).alias("session_start_key"),
        "admin_mode", _flag("is_proxy").alias("is_proxy"), "interviewer_id",
    )


def dim_date(dates: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Calendar rows for the distinct non-null ``date_key`` of ``dates`` that ``existing`` lacks."""
    d = dates.where("date_key is not null").select("date_key").distinct()
    if existing is not None:
        d = d.join(existing.select("date_key"), "date_key", "left_anti")
    day, dow = F.col("date_key"), day_of_week(F.col("date_key"))
    return d.select("date_key", F.year(day).alias("year"), F.quarter(day).alias("quarter"), F.month(day).alias("month"), F.weekofyear(day).alias("week"), dow.alias("day_of_week"), F.dayofyear(day).alias("day_of_year"), dow.isin(0, 6).alias("is_weekend"))


def cast_failures(tables: dict[str, tuple[DataFrame, str, dict[str, str]]], existing: DataFrame | None = None) -> DataFrame:
    """table_name, column_name, row_id, value of texts that are not null and not readable.

    ``tables``: name to (rows, id column, column to ``date`` or ``timestamp``). Rows already in ``existing`` are left out.
    """
    parts = []
    for name, (rows, key, columns) in tables.items():
        for column, kind in columns.items():
            read = iso_date(F.col(column)) if kind == "date" else iso_timestamp(F.col(column))
            parts.append(rows.where(F.col(column).isNotNull() & read.isNull()).select(F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), F.col(key).cast("bigint").alias("row_id"), F.col(column).cast("string").alias("value")))
    found = reduce(DataFrame.unionByName, parts).distinct()
    if existing is None:
        return found
    return found.join(existing, reduce(lambda a, b: a & b, (found[c].eqNullSafe(existing[c]) for c in found.columns)), "left_anti")


def question_distribution(facts: DataFrame) -> DataFrame:
    """Share of each option among the sessions with an option, by study, questionnaire and question.

    The denominator counts distinct sessions of the questionnaire's question over all studies.
    """
    f = facts.where("option_value is not null")
    totals = f.groupBy("questionnaire_id", "question_id").agg(F.countDistinct("session_id").alias("total"))
    n = f.groupBy("study_id", "questionnaire_id", "question_id", "option_value").agg(F.count("*").alias("n"), F.min("option_id").alias("option_id"), F.min("question_concept_id").alias("question_concept_id"), F.min("option_concept_id").alias("option_concept_id"))
    return n.join(totals, ["questionnaire_id", "question_id"]).withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 2)).drop("total")


def numeric_statistics(facts: DataFrame, questions: DataFrame) -> DataFrame:
    """Count, mean, exact quartiles, sample deviation and range of numeric and slider answers."""
    q = questions.where(F.col("question_type").isin("numeric", "slider")).select("question_id")
    v = F.col("response_numeric")
    return (
        facts.where(v.isNotNull())
        .join(q, "question_id", "left_semi")
        .groupBy("study_id", "questionnaire_id", "question_id", "question_concept_id")
        .agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("std_dev"), F.min(v).alias("min_val"), F.max(v).alias("max_val"), F.percentile(v, 0.25).alias("p25"), F.percentile(v, 0.75).alias("p75"))
    )


def session_completion(sessions: DataFrame) -> DataFrame:
    """Started and completed sessions and the median duration by study, questionnaire, day and mode; no mode shows as ``unknown``."""
    return (
        sessions.where("session_date_key is not null")
        .groupBy("study_id", "questionnaire_id", "session_date_key", F.coalesce("admin_mode", F.lit("unknown")).alias("admin_mode"))
        .agg(F.count("*").alias("n_started"), F.count_if("is_complete").alias("n_completed"), half_even_int(F.median("duration_sec")).alias("median_duration_sec"))
        .withColumn("completion_rate", F.round(F.col("n_completed") / F.col("n_started"), 4))
    )


# Fixed values of the OMOP vocabularies: survey as the type of an observation; answered by a proxy.
SURVEY_TYPE, PROXY = 32836, 532063


def omop_survey_conduct(sessions: DataFrame, questionnaires: DataFrame, persons: DataFrame) -> DataFrame:
    """One row for each session of a known questionnaire; without a mapped person person_id is null."""
    q = questionnaires.select("questionnaire_id", F.col("concept_id").alias("survey_concept_id"))
    return (
        sessions.join(q, "questionnaire_id")
        .join(persons.select("respondent_id", "person_id"), "respondent_id", "left")
        .select(
            F.col("session_id").alias("survey_conduct_id"),
            "person_id",
            "survey_concept_id",
            F.to_date("started_at").alias("survey_start_date"),
            F.to_date("completed_at").alias("survey_end_date"),
            F.when(F.col("is_proxy"), PROXY).otherwise(0).alias("assisted_concept_id"),
            F.col("admin_mode").alias("survey_source_value"),
        )
    )


def omop_observation(facts: DataFrame, persons: DataFrame) -> DataFrame:
    """One row for each answer to a question with a concept; the number is the answer's own or its option's."""
    return (
        facts.where("question_concept_id is not null")
        .join(persons.select("respondent_id", "person_id"), "respondent_id", "left")
        .select(
            F.col("response_id").alias("observation_id"),
            "person_id",
            F.col("question_concept_id").alias("observation_concept_id"),
            F.col("response_date_key").alias("observation_date"),
            F.col("session_id").alias("questionnaire_response_id"),
            F.col("option_concept_id").alias("value_as_concept_id"),
            F.col("response_text").alias("value_as_string"),
            F.coalesce("response_numeric", plain_number(F.col("option_value"))).alias("value_as_number"),
            F.col("option_value").alias("observation_source_value"),
            F.lit(SURVEY_TYPE).alias("observation_type_concept_id"),
        )
    )


def omop_unmapped(facts: DataFrame, questions: DataFrame) -> DataFrame:
    """Placed questions without a concept and how often they were answered, 0 for never."""
    n = facts.groupBy("question_id").agg(F.count("response_id").alias("response_count"))
    return questions.where("concept_id is null").join(n, "question_id", "left").select("question_id", "link_id", "question_text", F.coalesce("response_count", F.lit(0)).alias("response_count"))


def dim_question_lineage(lineage: DataFrame) -> DataFrame:
    """The lineage of questions with a real date; texts that are no full dates become null."""
    return lineage.withColumn("effective_date", iso_date(F.col("effective_date")))


def dim_question_equivalence(equivalence: DataFrame) -> DataFrame:
    """Declared equivalences, with the group of each question that is in one (see equivalence.grouping_edges)."""
    from cohortspark.operators import equivalence as eq
    from cohortspark.operators import graphs

    groups = graphs.equivalence_groups(eq.grouping_edges(equivalence))
    return equivalence.join(groups.select(F.col("node").alias("question_id_1"), "group_id"), "question_id_1", "left")
