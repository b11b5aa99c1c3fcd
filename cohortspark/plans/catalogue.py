"""Standard study questions over fact_response, question, response_session and their companions.

Each query is a function of (spark, folder) over whole tables, beside the SQL that gives the same rows elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.functions import semantics
from cohortspark.operators import disclosure, equivalence, graphs, ranges, response_atoms, scoring, star, upsert
from cohortspark.operators.skew import broadcast_if_small
from cohortspark.plans import report
from cohortspark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_FACT = """response_id session_id respondent_id questionnaire_id study_id question_id option_id repeat_index response_text response_numeric response_date response_boolean
option_value question_concept_id option_concept_id response_date_key admin_mode loaded_at""".split()


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fact_response").select(*_FACT)


def _typed(spark: SparkSession, folder: str, *types: str) -> DataFrame:
    """Answers to questions of the given types, with link_id; the 41 questions are broadcast."""
    q = table(spark, folder, "question").select("question_id", "link_id", "question_text", "question_type")
    return _facts(spark, folder).join(broadcast_if_small(q.where(F.col("question_type").isin(*types))), "question_id")


def _share(n: str, of: str, digits: int = 1):
    return F.round(F.lit(100.0) * F.col(n) / F.col(of), digits)


# --- answers by question type -------------------------------------------------------------------------------------


@query("SELECT q.question_type, COUNT(f.response_id) AS n FROM question q LEFT JOIN fact_response f ON f.question_id = q.question_id GROUP BY q.question_type")
def type_counts(spark, folder):
    per = _facts(spark, folder).groupBy("question_id").agg(F.count("response_id").alias("n"))
    return table(spark, folder, "question").join(per, "question_id", "left").groupBy("question_type").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("""
WITH c AS (SELECT q.link_id, f.option_value, COUNT(*) AS n FROM fact_response f JOIN question q ON q.question_id = f.question_id
           WHERE q.question_type IN ('single_choice', 'likert') GROUP BY 1, 2)
SELECT link_id, option_value, n, ROUND(100.0 * n / (SUM(n) OVER (PARTITION BY link_id))::DOUBLE, 1) AS pct FROM c""")
def choice_distribution(spark, folder):
    n = _typed(spark, folder, "single_choice", "likert").groupBy("link_id", "option_value").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("link_id"))
    return n.withColumn("total", total).select("link_id", "option_value", "n", _share("n", "total").alias("pct"))


@query("""
WITH a AS (SELECT COUNT(DISTINCT session_id) AS total FROM fact_response)
SELECT q.link_id, LOWER(TRIM(f.option_value, E' \\t')) AS code, COUNT(*) AS n_rows, COUNT(DISTINCT f.session_id) AS n_sessions, ROUND(100.0 * COUNT(DISTINCT f.session_id) / MAX(a.total)::DOUBLE, 1) AS pct
FROM fact_response f JOIN question q ON q.question_id = f.question_id, a WHERE q.question_type = 'multiple_choice' GROUP BY 1, 2""")
def multi_choice_rates(spark, folder):
    total = _facts(spark, folder).agg(F.countDistinct("session_id").alias("total"))
    n = _typed(spark, folder, "multiple_choice").groupBy("link_id", F.lower(F.trim(F.translate("option_value", "\t", " "))).alias("code")).agg(F.count("*").alias("n_rows"), F.countDistinct("session_id").alias("n_sessions"))
    return n.withColumn("total", total.scalar()).withColumn("pct", _share("n_sessions", "total")).drop("total")


@query("""
WITH c AS (SELECT q.link_id, COUNT(f.response_boolean) AS n, SUM(CASE WHEN f.response_boolean THEN 1 ELSE 0 END)::BIGINT AS n_true FROM fact_response f JOIN question q ON q.question_id = f.question_id
           WHERE q.question_type = 'boolean' GROUP BY 1),
     w AS (SELECT *, n_true::DOUBLE / n AS p, 1.959963984540054 AS z FROM c)
SELECT link_id, n, n_true, ROUND(p, 6) AS share,
       ROUND((p + z*z/(2*n) - z*SQRT(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n), 6) AS low, ROUND((p + z*z/(2*n) + z*SQRT(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n), 6) AS high FROM w""")
def boolean_proportion(spark, folder):
    n = _typed(spark, folder, "boolean").groupBy("link_id").agg(F.count("response_boolean").alias("n"), F.count_if("response_boolean").alias("n_true"))
    low, high = semantics.wilson(F.col("n_true"), F.col("n"))
    return n.select("link_id", "n", "n_true", F.round(F.col("n_true") / F.col("n"), 6).alias("share"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""
SELECT q.link_id, COUNT(*) AS n, COUNT(DISTINCT f.response_text) AS n_different, MIN(LENGTH(f.response_text)) AS shortest, MAX(LENGTH(f.response_text)) AS longest, ROUND(AVG(LENGTH(f.response_text)), 4) AS mean_length
FROM fact_response f JOIN question q ON q.question_id = f.question_id WHERE q.question_type = 'text' AND f.response_text IS NOT NULL GROUP BY 1""")
def text_lengths(spark, folder):
    size = F.length("response_text")
    return _typed(spark, folder, "text").where("response_text is not null").groupBy("link_id").agg(F.count("*").alias("n"), F.countDistinct("response_text").alias("n_different"), F.min(size).alias("shortest"), F.max(size).alias("longest"), F.round(F.avg(size), 4).alias("mean_length"))


@query("""
SELECT q.link_id, CAST(DATE_TRUNC('month', f.response_date) AS DATE) AS month, COUNT(*) AS n FROM fact_response f JOIN question q ON q.question_id = f.question_id
WHERE q.question_type IN ('date', 'datetime') AND f.response_date IS NOT NULL GROUP BY 1, 2""")
def date_monthly(spark, folder):
    return _typed(spark, folder, "date", "datetime").where("response_date is not null").groupBy("link_id", F.trunc("response_date", "month").alias("month")).agg(F.count("*").alias("n"))


@query("""
SELECT q.link_id, f.repeat_index, COUNT(*) AS n, ROUND(AVG(f.response_numeric), 6) AS mean FROM fact_response f JOIN question q ON q.question_id = f.question_id
WHERE f.repeat_index IS NOT NULL GROUP BY 1, 2""")
def repeat_instances(spark, folder):
    f = _facts(spark, folder).where("repeat_index is not null").join(broadcast_if_small(table(spark, folder, "question").select("question_id", "link_id")), "question_id")
    return f.groupBy("link_id", "repeat_index").agg(F.count("*").alias("n"), F.round(F.avg("response_numeric"), 6).alias("mean"))


@query("""
WITH v AS (SELECT session_id, MAX(repeat_index) + 1 AS visits FROM fact_response WHERE repeat_index IS NOT NULL GROUP BY 1)
SELECT COUNT(*) AS n_sessions, SUM(visits)::BIGINT AS n_visits, ROUND(AVG(visits), 1) AS mean_visits, MAX(visits) AS most FROM v""")
def repeat_summary(spark, folder):
    v = _facts(spark, folder).where("repeat_index is not null").groupBy("session_id").agg((F.max("repeat_index") + 1).alias("visits"))
    return v.agg(F.count("*").alias("n_sessions"), F.sum("visits").alias("n_visits"), F.round(F.avg("visits"), 1).alias("mean_visits"), F.max("visits").alias("most"))


@query("""
SELECT f.session_id, f.repeat_index, MAX(CASE WHEN q.link_id = 'preg.visit.systolic' THEN f.response_numeric END) AS systolic, BOOL_OR(CASE WHEN q.link_id = 'preg.visit.swelling' THEN f.response_boolean END) AS swelling,
       MAX(CASE WHEN q.link_id = 'preg.visit.place' THEN f.option_value END) AS place
FROM fact_response f JOIN question q ON q.question_id = f.question_id WHERE f.repeat_index IS NOT NULL GROUP BY 1, 2""")
def repeat_pivot(spark, folder):
    f = _facts(spark, folder).where("repeat_index is not null").join(broadcast_if_small(table(spark, folder, "question").select("question_id", "link_id")), "question_id")
    on = lambda link, c: F.when(F.col("link_id") == link, F.col(c))
    return f.groupBy("session_id", "repeat_index").agg(F.max(on("preg.visit.systolic", "response_numeric")).alias("systolic"), F.bool_or(on("preg.visit.swelling", "response_boolean")).alias("swelling"), F.max(on("preg.visit.place", "option_value")).alias("place"))


@query("""
WITH a AS (SELECT DISTINCT session_id, option_value FROM fact_response WHERE question_id = 128 AND option_value IS NOT NULL), b AS (SELECT DISTINCT session_id, option_value FROM fact_response WHERE question_id = 101 AND option_value IS NOT NULL)
SELECT a.option_value AS first_value, b.option_value AS second_value, COUNT(*) AS n FROM a JOIN b ON a.session_id = b.session_id GROUP BY 1, 2""")
def joint_frequency(spark, folder):
    f = _facts(spark, folder).where("option_value is not null")
    one = lambda q, name: f.where(F.col("question_id") == q).select("session_id", F.col("option_value").alias(name)).distinct()
    return one(128, "first_value").join(one(101, "second_value"), "session_id").groupBy("first_value", "second_value").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT questionnaire_id, COUNT(DISTINCT session_id) AS sessions FROM fact_response GROUP BY 1), a AS (SELECT questionnaire_id, question_id, COUNT(DISTINCT session_id) AS answered FROM fact_response GROUP BY 1, 2)
SELECT a.questionnaire_id, a.question_id, s.sessions - a.answered AS n_missing, ROUND(100.0 * (s.sessions - a.answered) / s.sessions::DOUBLE, 1) AS pct_missing FROM a JOIN s ON a.questionnaire_id = s.questionnaire_id WHERE s.sessions > a.answered""")
def missing_by_question(spark, folder):
    f = _facts(spark, folder)
    sessions = f.groupBy("questionnaire_id").agg(F.countDistinct("session_id").alias("sessions"))
    answered = f.groupBy("questionnaire_id", "question_id").agg(F.countDistinct("session_id").alias("answered"))
    m = answered.join(sessions, "questionnaire_id").withColumn("n_missing", F.col("sessions") - F.col("answered")).where("n_missing > 0")
    return m.select("questionnaire_id", "question_id", "n_missing", _share("n_missing", "sessions").alias("pct_missing"))


@query("SELECT question_id, COUNT(*) AS n FROM fact_response GROUP BY question_id HAVING MAX(question_concept_id) IS NULL")
def unmapped_answered(spark, folder):
    return _facts(spark, folder).groupBy("question_id").agg(F.count("*").alias("n"), F.max("question_concept_id").alias("c")).where("c is null").drop("c")


# --- star schema, aggregates, scores -------------------------------------------------------------------------------

_STAMP = r"'^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?$'"
_SESSION_SQL = f"""
SELECT session_id, questionnaire_id, respondent_id, TRY_CAST(CASE WHEN regexp_matches(started_at, {_STAMP}) THEN started_at END AS TIMESTAMP) AS started_at,
       TRY_CAST(CASE WHEN regexp_matches(completed_at, {_STAMP}) THEN completed_at END AS TIMESTAMP) AS completed_at, COALESCE(is_complete, 0) <> 0 AS is_complete, admin_mode, COALESCE(is_proxy, 0) <> 0 AS is_proxy FROM response_session"""


def _sessions(spark, folder):
    s = table(spark, folder, "response_session")
    return star.dim_session(s, s.select("respondent_id", F.lit(1).alias("study_id")).distinct())


@query(f"""
WITH s AS ({_SESSION_SQL})
SELECT session_id, questionnaire_id, respondent_id, 1 AS study_id, started_at, completed_at, is_complete, admin_mode, is_proxy,
       CAST(round_even(EPOCH(completed_at) - EPOCH(started_at), 0) AS INTEGER) AS duration_sec, CAST(COALESCE(completed_at, started_at) AS DATE) AS session_date_key FROM s""")
def dim_session(spark, folder):
    return _sessions(spark, folder)


@query(f"""
WITH s AS ({_SESSION_SQL}), d AS (SELECT DISTINCT CAST(COALESCE(completed_at, started_at) AS DATE) AS date_key FROM s)
SELECT date_key, YEAR(date_key) AS year, QUARTER(date_key) AS quarter, MONTH(date_key) AS month, WEEK(date_key) AS week, DAYOFWEEK(date_key) AS day_of_week, DAYOFYEAR(date_key) AS day_of_year, DAYOFWEEK(date_key) IN (0, 6) AS is_weekend FROM d WHERE date_key IS NOT NULL""")
def dim_date(spark, folder):
    return star.dim_date(_sessions(spark, folder).select(F.col("session_date_key").alias("date_key")))


@query(f"""
WITH s AS ({_SESSION_SQL}), d AS (SELECT *, CAST(COALESCE(completed_at, started_at) AS DATE) AS session_date_key, round_even(EPOCH(completed_at) - EPOCH(started_at), 0) AS sec FROM s)
SELECT 1 AS study_id, questionnaire_id, session_date_key, COALESCE(admin_mode, 'unknown') AS admin_mode, COUNT(*) AS n_started, COUNT(*) FILTER (WHERE is_complete) AS n_completed,
       CAST(round_even(MEDIAN(sec), 0) AS INTEGER) AS median_duration_sec, ROUND(COUNT(*) FILTER (WHERE is_complete) / COUNT(*)::DOUBLE, 4) AS completion_rate FROM d WHERE session_date_key IS NOT NULL GROUP BY ALL""")
def session_completion(spark, folder):
    return star.session_completion(_sessions(spark, folder))


@query(r"""
SELECT 'response_session' AS table_name, 'started_at' AS column_name, session_id AS row_id, started_at AS value FROM response_session WHERE started_at IS NOT NULL AND (NOT regexp_matches(started_at, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?$') OR TRY_CAST(started_at AS TIMESTAMP) IS NULL)
UNION SELECT 'concept', 'valid_start_date', concept_id, valid_start_date FROM concept WHERE valid_start_date IS NOT NULL AND (NOT regexp_matches(valid_start_date, '^\d{4}[-/]\d{1,2}[-/]\d{1,2}$') OR TRY_CAST(replace(valid_start_date, '/', '-') AS DATE) IS NULL)""")
def cast_failures(spark, folder):
    return star.cast_failures({"response_session": (table(spark, folder, "response_session"), "session_id", {"started_at": "timestamp"}), "concept": (table(spark, folder, "concept"), "concept_id", {"valid_start_date": "date"})})


@query(r"""
WITH v AS (SELECT 'response_session' AS table_name, 'started_at' AS column_name, session_id AS row_id, started_at AS value, TRUE AS moment FROM response_session
           UNION ALL SELECT 'response_session', 'completed_at', session_id, completed_at, TRUE FROM response_session
           UNION ALL SELECT 'concept', 'valid_start_date', concept_id, valid_start_date, FALSE FROM concept
           UNION ALL SELECT 'concept', 'valid_end_date', concept_id, valid_end_date, FALSE FROM concept)
SELECT DISTINCT table_name, column_name, row_id, value FROM v WHERE value IS NOT NULL
    AND CASE WHEN moment THEN NOT regexp_matches(value, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?$') OR TRY_CAST(value AS TIMESTAMP) IS NULL
             ELSE NOT regexp_matches(value, '^\d{4}[-/]\d{1,2}[-/]\d{1,2}$') OR TRY_CAST(replace(value, '/', '-') AS DATE) IS NULL END""")
def every_cast_failure(spark, folder):
    """:func:`cast_failures` with the ends of sessions and of concepts, which its SQL leaves out."""
    return star.cast_failures({"response_session": (table(spark, folder, "response_session"), "session_id", {"started_at": "timestamp", "completed_at": "timestamp"}), "concept": (table(spark, folder, "concept"), "concept_id", {"valid_start_date": "date", "valid_end_date": "date"})})


@query("SELECT q.question_id, q.link_id, c.concept_name, c.vocabulary_id FROM (SELECT *, 4670 + (question_id % 100) + 229 AS concept_id FROM question) q LEFT JOIN concept c ON c.concept_id = q.concept_id")
def dim_question(spark, folder):
    q = table(spark, folder, "question").withColumn("concept_id", F.lit(4670) + F.col("question_id") % 100 + 229)
    return star.dim_question(q, table(spark, folder, "concept")).select("question_id", "link_id", "concept_name", "vocabulary_id")


@query("""
WITH f AS (SELECT * FROM fact_response WHERE option_value IS NOT NULL), t AS (SELECT questionnaire_id, question_id, COUNT(DISTINCT session_id) AS total FROM f GROUP BY 1, 2),
     n AS (SELECT study_id, questionnaire_id, question_id, option_value, COUNT(*) AS n, MIN(option_id) AS option_id, MIN(question_concept_id) AS question_concept_id, MIN(option_concept_id) AS option_concept_id FROM f GROUP BY 1, 2, 3, 4)
SELECT n.*, ROUND(100.0::DOUBLE * n.n / t.total, 2) AS pct FROM n JOIN t ON n.questionnaire_id = t.questionnaire_id AND n.question_id = t.question_id""")
def question_distribution(spark, folder):
    return star.question_distribution(_facts(spark, folder))


@query("""
SELECT f.study_id, f.questionnaire_id, f.question_id, f.question_concept_id, COUNT(*) AS n, ROUND(AVG(response_numeric), 6) AS mean, ROUND(MEDIAN(response_numeric), 6) AS median, ROUND(STDDEV_SAMP(response_numeric), 6) AS std_dev,
       MIN(response_numeric) AS min_val, MAX(response_numeric) AS max_val, ROUND(QUANTILE_CONT(response_numeric, 0.25), 6) AS p25, ROUND(QUANTILE_CONT(response_numeric, 0.75), 6) AS p75
FROM fact_response f JOIN question q ON q.question_id = f.question_id WHERE q.question_type IN ('numeric', 'slider') AND response_numeric IS NOT NULL GROUP BY 1, 2, 3, 4""")
def numeric_statistics(spark, folder):
    s = star.numeric_statistics(_facts(spark, folder), table(spark, folder, "question"))
    return s.withColumns({c: F.round(c, 6) for c in ("mean", "median", "std_dev", "p25", "p75")})


# Fixed values of the example scale: points of the frequency options, and labels of the sums of nine items.
POINTS = {"never": 0.0, "few_days": 1.0, "many_days": 2.0, "daily": 3.0}
BANDS = [(0.0, 4.0, "minimal"), (5.0, 9.0, "mild"), (10.0, 14.0, "moderate"), (15.0, 19.0, "marked"), (20.0, None, "severe")]
_POINTS_SQL = "CASE LOWER(TRIM(f.option_value, E' \\t')) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in POINTS.items()) + " END"
_SCORE_SQL = f"""
WITH s AS (SELECT f.session_id, f.respondent_id, f.questionnaire_id, CASE WHEN q.link_id = 'mood.i7' THEN 3.0 - {_POINTS_SQL} ELSE {_POINTS_SQL} END AS v, f.admin_mode
           FROM fact_response f JOIN question q ON q.question_id = f.question_id WHERE q.link_id LIKE 'mood.i%' AND f.questionnaire_id = 1),
     r AS (SELECT session_id, respondent_id, questionnaire_id, SUM(v)::DOUBLE AS score, COUNT(*) AS items_answered, 9::BIGINT AS items_total FROM s WHERE v IS NOT NULL GROUP BY 1, 2, 3),
     scored AS (SELECT *, CASE WHEN score <= 4 THEN 'minimal' WHEN score BETWEEN 5 AND 9 THEN 'mild' WHEN score BETWEEN 10 AND 14 THEN 'moderate' WHEN score BETWEEN 15 AND 19 THEN 'marked' WHEN score >= 20 THEN 'severe' END AS category FROM r)"""


def _scores(spark, folder):
    points = F.create_map(*(F.lit(x) for kv in POINTS.items() for x in kv))
    f = _facts(spark, folder).withColumn("response_numeric", F.try_element_at(points, F.lower(F.trim(F.translate("option_value", "\t", " ")))))
    q = table(spark, folder, "question").where("link_id like 'mood.i%'")
    items = q.select(F.lit(1).alias("rule_id"), "question_id", F.lit(1.0).alias("weight"), (F.col("link_id") == "mood.i7").alias("reverse"))
    rules = spark.sql("SELECT 1 AS rule_id, 'mood sum' AS name, 1 AS questionnaire_id, 'sum' AS formula")
    value = lambda x: "CAST(NULL AS DOUBLE)" if x is None else f"{x}D"
    rows = ", ".join(f"(1, {value(low)}, {value(high)}, '{label}', {i})" for i, (low, high, label) in enumerate(BANDS))
    bands = spark.sql(f"SELECT * FROM VALUES {rows} AS t(rule_id, low, high, label, place)")
    tops = q.select("question_id", F.lit(3.0).alias("value"))
    return scoring.scores(f, rules, items, bands, tops)


@query(_SCORE_SQL + " SELECT 1 AS rule_id, session_id, respondent_id, questionnaire_id, 'mood sum' AS name, score, items_answered, items_total, category FROM scored")
def respondent_scores(spark, folder):
    return _scores(spark, folder)


@query(_SCORE_SQL + " SELECT category, COUNT(*) AS n, ROUND(100.0 * COUNT(*) / (SUM(COUNT(*)) OVER ())::DOUBLE, 1) AS pct, MIN(score) AS least FROM scored GROUP BY 1")
def score_categories(spark, folder):
    s = _scores(spark, folder)
    n = s.groupBy("category").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    total = n.agg(F.sum("n").alias("total"))
    return n.withColumn("total", total.scalar()).select("category", "n", _share("n", "total").alias("pct"), "least")


@query(_SCORE_SQL + ", m AS (SELECT DISTINCT session_id, admin_mode FROM fact_response) SELECT m.admin_mode, COUNT(*) AS n, ROUND(AVG(score), 6) AS mean, MEDIAN(score) AS median, MIN(score) AS least, MAX(score) AS most FROM scored JOIN m ON m.session_id = scored.session_id GROUP BY 1")
def score_by_mode(spark, folder):
    modes = _facts(spark, folder).select("session_id", "admin_mode").distinct()
    return _scores(spark, folder).join(modes, "session_id").groupBy("admin_mode").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.median("score").alias("median"), F.min("score").alias("least"), F.max("score").alias("most"))


@query(_SCORE_SQL + """, v AS (SELECT respondent_id, COUNT(DISTINCT session_id) AS visits FROM fact_response WHERE questionnaire_id = 5 GROUP BY 1), b AS (SELECT respondent_id, MAX(score) AS score FROM scored GROUP BY 1)
SELECT v.respondent_id, v.visits, b.score FROM v JOIN b ON v.respondent_id = b.respondent_id""")
def instrument_overlap(spark, folder):
    v = _facts(spark, folder).where("questionnaire_id = 5").groupBy("respondent_id").agg(F.countDistinct("session_id").alias("visits"))
    return v.join(_scores(spark, folder).groupBy("respondent_id").agg(F.max("score").alias("score")), "respondent_id")


# --- OMOP ------------------------------------------------------------------------------------------------------------

_NUMBER_SQL = r"CASE WHEN regexp_matches(option_value, '^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$') THEN TRY_CAST(option_value AS DOUBLE) END"


def _persons(spark, folder):
    """Respondents with answers under an invented person number; others stay unmapped."""
    return _facts(spark, folder).select("respondent_id").distinct().withColumn("person_id", F.col("respondent_id") + 1_000_000)


@query(f"""
SELECT response_id AS observation_id, respondent_id + 1000000 AS person_id, question_concept_id AS observation_concept_id, response_date_key AS observation_date, session_id AS questionnaire_response_id,
       option_concept_id AS value_as_concept_id, response_text AS value_as_string, COALESCE(response_numeric, {_NUMBER_SQL}) AS value_as_number, option_value AS observation_source_value, 32836 AS observation_type_concept_id
FROM fact_response WHERE question_concept_id IS NOT NULL""")
def omop_observation(spark, folder):
    return star.omop_observation(_facts(spark, folder), _persons(spark, folder))


@query(f"""
WITH s AS ({_SESSION_SQL}) SELECT session_id AS survey_conduct_id, CASE WHEN respondent_id IN (SELECT respondent_id FROM fact_response) THEN respondent_id + 1000000 END AS person_id, questionnaire_id + 7000 AS survey_concept_id,
       CAST(started_at AS DATE) AS survey_start_date, CAST(completed_at AS DATE) AS survey_end_date, CASE WHEN is_proxy THEN 532063 ELSE 0 END AS assisted_concept_id, admin_mode AS survey_source_value FROM s""")
def omop_survey_conduct(spark, folder):
    q = table(spark, folder, "response_session").select("questionnaire_id").distinct().withColumn("concept_id", F.col("questionnaire_id") + 7000)
    return star.omop_survey_conduct(_sessions(spark, folder), q, _persons(spark, folder))


@query("""
WITH m AS (SELECT question_id, MAX(question_concept_id) AS concept_id, COUNT(response_id) AS n FROM fact_response GROUP BY 1)
SELECT q.question_id, q.link_id, q.question_text, COALESCE(m.n, 0) AS response_count FROM question q LEFT JOIN m ON m.question_id = q.question_id WHERE m.concept_id IS NULL""")
def omop_unmapped(spark, folder):
    mapped = _facts(spark, folder).groupBy("question_id").agg(F.max("question_concept_id").alias("concept_id"))
    q = table(spark, folder, "question").join(mapped, "question_id", "left")
    return star.omop_unmapped(_facts(spark, folder), q)


# --- graphs and versions -------------------------------------------------------------------------------------------------

_EDGES_SQL = "SELECT concept_id_1 AS a, concept_id_2 AS b FROM concept_relationship WHERE relationship_id = 'Replaced by' AND concept_id_2 IS NOT NULL AND concept_id_1 <> concept_id_2"
_REACH_SQL = f"""
WITH RECURSIVE e AS ({_EDGES_SQL}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS other FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.other = u.a)"""


def _replacements(spark, folder):
    return table(spark, folder, "concept_relationship").where("relationship_id = 'Replaced by'").select(F.col("concept_id_1").alias("src"), F.col("concept_id_2").alias("dst"))


@query(_REACH_SQL + " SELECT node, MIN(other) AS component FROM r GROUP BY node")
def concept_components(spark, folder):
    return graphs.components(_replacements(spark, folder))


@query(_REACH_SQL + ", g AS (SELECT node, MAX(other) AS root FROM r GROUP BY node) SELECT node, DENSE_RANK() OVER (ORDER BY root) AS group_id FROM g")
def equivalence_groups(spark, folder):
    return graphs.equivalence_groups(_replacements(spark, folder))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT concept_id_1 AS child, concept_id_2 AS parent FROM concept_relationship WHERE relationship_id = 'Is a' AND concept_id_2 IS NOT NULL AND concept_id_1 <> concept_id_2),
     w(node, ancestor, depth) USING KEY (node, ancestor) AS (SELECT child, parent, 1 FROM e
        UNION SELECT w.node, e.parent, w.depth + 1 FROM w JOIN e ON w.ancestor = e.child LEFT JOIN recurring.w k ON k.node = w.node AND k.ancestor = e.parent WHERE k.node IS NULL AND w.node <> e.parent)
SELECT node, ancestor, depth FROM w""")
def concept_ancestors(spark, folder):
    e = table(spark, folder, "concept_relationship").where("relationship_id = 'Is a'")
    return graphs.ancestors(e.select(F.col("concept_id_1").alias("child"), F.col("concept_id_2").alias("parent")))


@query("""
WITH p AS (SELECT questionnaire_id, question_id, MIN(display_order) AS place FROM questionnaire_question WHERE deleted_at IS NULL GROUP BY 1, 2), n AS (SELECT questionnaire_id - 1 AS questionnaire_id, question_id, place FROM p)
SELECT COALESCE(p.questionnaire_id, n.questionnaire_id) AS questionnaire_id, CAST(COALESCE(p.question_id, n.question_id) AS VARCHAR) AS link_id,
       CASE WHEN p.question_id IS NULL THEN 'added' WHEN n.question_id IS NULL THEN 'removed' ELSE 'reordered' END AS change
FROM p FULL JOIN n ON p.question_id = n.question_id AND p.questionnaire_id = n.questionnaire_id WHERE p.question_id IS NULL OR n.question_id IS NULL OR p.place <> n.place""")
def version_differences(spark, folder):
    """Differences of each questionnaire to the one with the next id."""
    p = table(spark, folder, "questionnaire_question").where("deleted_at is null").select("questionnaire_id", F.col("question_id").cast("string").alias("link_id"), F.lit("").alias("question_text"), "display_order")
    return graphs.version_differences(p, p.withColumn("questionnaire_id", F.col("questionnaire_id") - 1), ["questionnaire_id"])


@query("""
SELECT d.study_id, d.doc_id, COUNT(DISTINCT f.session_id) AS n_sessions FROM documents d JOIN fact_response f ON f.study_id = d.study_id AND f.loaded_at BETWEEN d.recorded_at AND d.recorded_at + INTERVAL 6 HOUR
WHERE d.doc_kind = 'erratum' GROUP BY 1, 2""")
def errata_sessions(spark, folder):
    """Sessions with answers loaded within six hours of an erratum of their study."""
    errata = table(spark, folder, "documents").where("doc_kind = 'erratum'").select("study_id", "doc_id", "recorded_at", (F.col("recorded_at") + F.expr("interval 6 hours")).alias("until"))
    hit = ranges.interval_join(_facts(spark, folder).select("study_id", "session_id", "loaded_at").distinct(), errata, ["study_id"], "loaded_at", "recorded_at", "until", 6 * 3600 * 1_000_000)
    return hit.groupBy("study_id", "doc_id").agg(F.countDistinct("session_id").alias("n_sessions"))


# --- nested responses -------------------------------------------------------------------------------------------------


@query("""
WITH i AS (SELECT rec_no, status, questionnaire, subject, UNNEST(item) AS x FROM phq9_fhir_responses), a AS (SELECT rec_no, status, questionnaire, subject, x.linkId AS link_id, UNNEST(x.answer) AS y FROM i)
SELECT COALESCE(status, 'completed') AS status, split_part(questionnaire, '|', 1) AS canonical, link_id, COALESCE(y.valueCoding.code, y.valueCoding.display) AS code, COUNT(*) AS n, COUNT(DISTINCT regexp_replace(subject.reference, '^[^/]*/', '')) AS n_subjects
FROM a WHERE y.valueCoding IS NOT NULL GROUP BY 1, 2, 3, 4""")
def response_codes(spark, folder):
    atoms = response_atoms.answer_atoms(table(spark, folder, "phq9_fhir_responses")).where("kind = 'coding' and parent_link_id is null")
    return atoms.groupBy("status", "canonical", "link_id", "code").agg(F.count("*").alias("n"), F.countDistinct("external_id").alias("n_subjects"))


# --- SQL features ------------------------------------------------------------------------------------------------------


@query("SELECT questionnaire_id, admin_mode, GROUPING_ID(questionnaire_id, admin_mode) AS level, COUNT(*) AS n, COUNT(DISTINCT session_id) AS n_sessions FROM fact_response GROUP BY CUBE (questionnaire_id, admin_mode)")
def mode_cube(spark, folder):
    return _facts(spark, folder).cube("questionnaire_id", "admin_mode").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.countDistinct("session_id").alias("n_sessions"))


@query("SELECT study_id, questionnaire_id, COUNT(*) AS n FROM fact_response GROUP BY GROUPING SETS ((study_id, questionnaire_id), (study_id), ())")
def study_rollup(spark, folder):
    return _facts(spark, folder).rollup("study_id", "questionnaire_id").agg(F.count("*").alias("n"))


@query("""
SELECT q.link_id, COUNT(*) AS n, ROUND(SKEWNESS(response_numeric), 4) AS skewness, ROUND(KURTOSIS(response_numeric), 4) AS kurtosis, ROUND(VAR_POP(response_numeric), 4) AS variance, COUNT(*) FILTER (WHERE response_numeric > 10) AS n_above
FROM fact_response f JOIN question q ON q.question_id = f.question_id WHERE q.question_type = 'numeric' AND response_numeric IS NOT NULL GROUP BY 1""")
def numeric_shape(spark, folder):
    v = F.col("response_numeric")
    return _typed(spark, folder, "numeric").where(v.isNotNull()).groupBy("link_id").agg(F.count("*").alias("n"), F.round(semantics.sample_skewness(v), 4).alias("skewness"), F.round(semantics.sample_kurtosis(v), 4).alias("kurtosis"), F.round(F.var_pop(v), 4).alias("variance"), F.count_if(v > 10).alias("n_above"))


@query("""
WITH d AS (SELECT DISTINCT question_id, LOWER(TRIM(option_value, E' \\t')) AS code FROM fact_response WHERE option_value IS NOT NULL)
SELECT q.link_id, COUNT(*) AS n_codes, STRING_AGG(code, ' | ' ORDER BY code) AS codes FROM d JOIN question q ON q.question_id = d.question_id GROUP BY 1""")
def data_dictionary(spark, folder):
    codes = _facts(spark, folder).where("option_value is not null").select("question_id", F.lower(F.trim(F.translate("option_value", "\t", " "))).alias("code")).distinct()
    j = codes.join(broadcast_if_small(table(spark, folder, "question").select("question_id", "link_id")), "question_id")
    return j.groupBy("link_id").agg(F.count("*").alias("n_codes"), F.array_join(F.array_sort(F.collect_list("code")), " | ").alias("codes"))


@query("""
SELECT column_name, n_null, ROUND(100.0 * n_null / total::DOUBLE, 4) AS pct_null FROM (
  SELECT 'response_text' AS column_name, COUNT(*) FILTER (WHERE response_text IS NULL) AS n_null, COUNT(*) AS total FROM fact_response UNION ALL
  SELECT 'response_numeric', COUNT(*) FILTER (WHERE response_numeric IS NULL), COUNT(*) FROM fact_response UNION ALL
  SELECT 'response_date', COUNT(*) FILTER (WHERE response_date IS NULL), COUNT(*) FROM fact_response UNION ALL
  SELECT 'response_boolean', COUNT(*) FILTER (WHERE response_boolean IS NULL), COUNT(*) FROM fact_response UNION ALL
  SELECT 'option_value', COUNT(*) FILTER (WHERE option_value IS NULL), COUNT(*) FROM fact_response)""")
def null_profile(spark, folder):
    names = ["response_text", "response_numeric", "response_date", "response_boolean", "option_value"]
    one = _facts(spark, folder).agg(F.count("*").alias("total"), *(F.count_if(F.col(c).isNull()).alias(c) for c in names))
    long = one.select("total", F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in names))))
    return long.select("column_name", "n_null", _share("n_null", "total", 4).alias("pct_null"))


@query("SELECT c.* FROM concept c WHERE UPPER(TRIM(c.vocabulary_id)) NOT IN (SELECT UPPER(TRIM(vocabulary_id)) FROM vocabulary WHERE vocabulary_id IS NOT NULL AND deleted_at IS NULL)")
def concepts_outside(spark, folder):
    key = F.upper(F.trim("vocabulary_id"))
    live = table(spark, folder, "vocabulary").where("deleted_at is null and vocabulary_id is not null").select(key.alias("k")).distinct()
    return table(spark, folder, "concept").where("vocabulary_id is not null").withColumn("k", key).join(live, "k", "left_anti").drop("k")


@query("SELECT s.respondent_id, COUNT(*) AS n FROM response_session s WHERE s.respondent_id IN (SELECT respondent_id FROM fact_response WHERE response_boolean) GROUP BY 1 ORDER BY n DESC, respondent_id LIMIT 25 OFFSET 5")
def busiest_respondents(spark, folder):
    """Twenty-five respondents after the five with most sessions, of those with some answer that is true."""
    some = _facts(spark, folder).where("response_boolean").select("respondent_id").distinct()
    return table(spark, folder, "response_session").join(some, "respondent_id", "left_semi").groupBy("respondent_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "respondent_id").offset(5).limit(25)


@query("""
SELECT s.session_id, s.started_at, s.admin_mode IS NOT DISTINCT FROM NULL AS without_mode, s.batch_id LIKE 'b2023-%' AS in_2023, s.questionnaire_id BETWEEN 2 AND 4 AS in_middle,
       (SELECT COUNT(*) FROM fact_response f WHERE f.session_id = s.session_id) AS n_answers FROM response_session s""")
def session_answers(spark, folder):
    n = _facts(spark, folder).groupBy("session_id").agg(F.count("*").alias("n_answers"))
    s = table(spark, folder, "response_session").join(n, "session_id", "left")
    marks = {"without_mode": F.col("admin_mode").eqNullSafe(F.lit(None)), "in_2023": F.col("batch_id").like("b2023-%"), "in_middle": F.col("questionnaire_id").between(2, 4)}
    return s.select("session_id", "started_at", *(c.alias(k) for k, c in marks.items()), F.coalesce("n_answers", F.lit(0)).alias("n_answers"))


@query("""
SELECT c.c_mktsegment, n.n_name, COUNT(*) AS n_orders, ROUND(SUM(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1, 2""")
def orders_by_segment(spark, folder):
    n = table(spark, folder, "nation").select("n_nationkey", "n_name")
    c = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_nationkey").join(broadcast_if_small(n), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("v"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "n_name").agg(F.sum("k").alias("n_orders"), F.round(F.sum("v"), 2).alias("total"))


# --- disclosure control --------------------------------------------------------------------------------------------------


@query("SELECT question_id, option_value, COUNT(*) AS n FROM fact_response WHERE option_value IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) >= 5")
def federated_counts(spark, folder):
    _facts(spark, folder).createOrReplaceTempView("fact_response")
    return disclosure.run_federated(spark, "SELECT question_id, option_value, COUNT(*) AS n FROM fact_response WHERE option_value IS NOT NULL GROUP BY question_id, option_value", 5).rows


# --- grids, ranks and reports ----------------------------------------------------------------------------------------------

_ATOMS_SQL = """
WITH a AS (SELECT rec_no, COALESCE(status, 'completed') AS status, NULL::VARCHAR AS up, UNNEST(item) AS x FROM gout_checkin_fhir_responses),
b AS (SELECT rec_no, status, x.linkId AS up, UNNEST(x.item) AS x FROM a), c AS (SELECT rec_no, status, x.linkId AS up, UNNEST(x.item) AS x FROM b),
r AS (SELECT rec_no, status, up, x.linkId AS link_id, UNNEST(x.answer) AS y FROM a UNION ALL SELECT rec_no, status, up, x.linkId, UNNEST(x.answer) FROM b UNION ALL SELECT rec_no, status, up, x.linkId, UNNEST(x.answer) FROM c)"""


def _atoms(spark, folder):
    return response_atoms.answer_atoms(table(spark, folder, "gout_checkin_fhir_responses"))


_GRID_SQL = _ATOMS_SQL + r""", g AS (SELECT up AS grid, CAST(regexp_extract(link_id, '\.r(\d+)$', 1) AS INTEGER) AS row, COALESCE(y.valueCoding.code, y.valueCoding.display) AS code FROM r WHERE y.valueCoding IS NOT NULL AND regexp_matches(link_id, '\.r\d+$'))"""


def _grid(spark, folder):
    row = F.regexp_extract("link_id", r"\.r(\d+)$", 1)
    return _atoms(spark, folder).where((F.col("kind") == "coding") & (row != "")).select(F.col("parent_link_id").alias("grid"), row.cast("int").alias("row"), "code")


@query(_GRID_SQL + " SELECT grid, row, code, COUNT(*) AS n FROM g GROUP BY 1, 2, 3")
def grid_counts(spark, folder):
    return _grid(spark, folder).groupBy("grid", "row", "code").agg(F.count("*").alias("n"))


@query(_GRID_SQL + """ SELECT grid, row, COUNT(*) AS total, COUNT(*) FILTER (WHERE code = '0') AS n_0, COUNT(*) FILTER (WHERE code = '1') AS n_1, COUNT(*) FILTER (WHERE code = '2') AS n_2,
  round_even(100.0 * COUNT(*) FILTER (WHERE code = '0') / COUNT(*)::DOUBLE, 1) AS pct_0, round_even(100.0 * COUNT(*) FILTER (WHERE code = '1') / COUNT(*)::DOUBLE, 1) AS pct_1, round_even(100.0 * COUNT(*) FILTER (WHERE code = '2') / COUNT(*)::DOUBLE, 1) AS pct_2 FROM g GROUP BY 1, 2""")
def grid_table(spark, folder):
    return report.grid_table(_grid(spark, folder), ["0", "1", "2"])


@query(_ATOMS_SQL + """, k AS (SELECT link_id, COALESCE(y.valueCoding.code, y.valueCoding.display) AS code, list_filter(y.extension, lambda e: e.url LIKE '%ordinal%')[1].valueDecimal AS rank FROM r WHERE y.valueCoding IS NOT NULL)
SELECT link_id, code, COUNT(*) AS n, ROUND(AVG(rank), 6) AS mean_rank, COUNT(*) FILTER (WHERE rank = 1) AS n_first FROM k WHERE rank IS NOT NULL GROUP BY 1, 2""")
def ranked_mean(spark, folder):
    r = _atoms(spark, folder).where("rank is not null")
    return r.groupBy("link_id", "code").agg(F.count("*").alias("n"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.count_if(F.col("rank") == 1).alias("n_first"))


@query("""
WITH i AS (SELECT rec_no, UNNEST(item) AS x FROM gout_checkin_fhir_responses), v AS (SELECT rec_no, COUNT(*) AS visits FROM i WHERE x.linkId = 'gout.visit' GROUP BY 1)
SELECT visits, COUNT(*) AS n_records FROM v GROUP BY 1""")
def visits_per_record(spark, folder):
    items = table(spark, folder, "gout_checkin_fhir_responses").select("rec_no", F.explode("item").alias("x"))
    return items.where("x.linkId = 'gout.visit'").groupBy("rec_no").agg(F.count("*").alias("visits")).groupBy("visits").agg(F.count("*").alias("n_records"))


@query(f"""
WITH s AS ({_SESSION_SQL}) SELECT COUNT(DISTINCT respondent_id) AS n_respondents, COUNT(*) AS n_sessions, ROUND(100 * AVG(is_complete::INTEGER), 1) AS pct_complete,
       MIN(CAST(COALESCE(completed_at, started_at) AS DATE)) AS first_day, MAX(CAST(COALESCE(completed_at, started_at) AS DATE)) AS last_day FROM s""")
def report_overview(spark, folder):
    return report.overview(_sessions(spark, folder))


@query("""
WITH n AS (SELECT question_id, option_value, COUNT(*) AS n FROM fact_response WHERE option_value IS NOT NULL GROUP BY 1, 2),
l AS (SELECT question_id, option_value, MIN(option_id) AS option_id FROM fact_response WHERE option_value IS NOT NULL GROUP BY 1, 2)
SELECT q.link_id, n.option_value, 'option ' || l.option_id AS option_text, l.option_id AS display_order, n.n, ROUND(100.0 * n.n / (SUM(n.n) OVER (PARTITION BY n.question_id))::DOUBLE, 1) AS pct
FROM n JOIN question q ON q.question_id = n.question_id LEFT JOIN l ON l.question_id = n.question_id AND l.option_value = n.option_value""")
def report_choices(spark, folder):
    f = _facts(spark, folder)
    options = f.where("option_value is not null").groupBy("question_id", "option_value").agg(F.min("option_id").alias("display_order")).withColumn("option_text", F.concat(F.lit("option "), F.col("display_order")))
    return report.choice_table(f, table(spark, folder, "question"), options)


@query("SELECT question_id, COUNT(*) AS n FROM fact_response WHERE response_text IS NOT NULL OR response_date IS NOT NULL GROUP BY 1")
def report_open_answers(spark, folder):
    return report.open_answers(_facts(spark, folder))


@query(_SCORE_SQL + " SELECT 'mood sum' AS name, COUNT(*) AS n, ROUND(AVG(score), 1) AS mean, MEDIAN(score) AS median, MIN(score) AS least, MAX(score) AS most FROM scored")
def report_scores(spark, folder):
    return report.score_statistics(_scores(spark, folder))


@query("""
WITH u AS (SELECT DISTINCT questionnaire_id, question_id FROM fact_response) SELECT u.questionnaire_id, p.display_order, q.link_id, q.question_text, q.question_type, NULL::VARCHAR AS parent_link_id
FROM u JOIN questionnaire_question p ON p.questionnaire_id = u.questionnaire_id AND p.question_id = u.question_id JOIN question q ON q.question_id = u.question_id""")
def report_questions(spark, folder):
    placements = table(spark, folder, "questionnaire_question").withColumn("parent_qq_id", F.lit(None).cast("bigint"))
    return report.question_list(_facts(spark, folder), table(spark, folder, "question"), placements)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT question_id AS a, CAST(question_concept_id AS BIGINT) AS b FROM fact_response WHERE question_concept_id IS NOT NULL), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS other FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.other = u.a), g AS (SELECT node, MAX(other) AS root FROM r GROUP BY 1), k AS (SELECT node AS question_id, DENSE_RANK() OVER (ORDER BY root) AS group_id FROM g)
SELECT k.group_id, COUNT(*) AS n, ROUND(AVG(f.response_numeric), 6) AS mean, COUNT(DISTINCT f.question_id) AS n_questions FROM fact_response f JOIN k ON k.question_id = f.question_id WHERE f.response_numeric IS NOT NULL GROUP BY 1""")
def pooled_by_equivalence(spark, folder):
    """Numeric answers pooled over questions that share a concept."""
    f = _facts(spark, folder)
    edges = f.where("question_concept_id is not null").select(F.col("question_id").alias("src"), F.col("question_concept_id").cast("bigint").alias("dst")).distinct()
    p = equivalence.pooled(f, graphs.equivalence_groups(edges))
    return p.select("group_id", "n", F.round("mean", 6).alias("mean"), "n_questions")


@query("""
SELECT session_id, MAX(CASE WHEN question_id = 155 THEN response_numeric END) AS hours, MAX(CASE WHEN question_id = 158 THEN response_numeric END) AS rest, BOOL_OR(CASE WHEN question_id = 164 THEN response_boolean END) AS snored
FROM fact_response WHERE questionnaire_id = 3 GROUP BY 1 HAVING MAX(CASE WHEN question_id = 155 THEN response_numeric END) IS NOT NULL""")
def two_question_pivot(spark, folder):
    on = lambda q, c: F.when(F.col("question_id") == q, F.col(c))
    p = _facts(spark, folder).where("questionnaire_id = 3").groupBy("session_id").agg(F.max(on(155, "response_numeric")).alias("hours"), F.max(on(158, "response_numeric")).alias("rest"), F.bool_or(on(164, "response_boolean")).alias("snored"))
    return p.where("hours is not null")


@query("""
SELECT question_concept_id AS concept_id, CAST(DATE_TRUNC('month', response_date_key) AS DATE) AS month, COUNT(*) AS n, COUNT(DISTINCT respondent_id) AS n_respondents, MODE(admin_mode ORDER BY admin_mode) IS NOT NULL AS has_mode,
       BIT_OR(repeat_index) AS repeats, ARG_MAX(response_id, loaded_at) IS NOT NULL AS any_loaded FROM fact_response WHERE question_concept_id IS NOT NULL GROUP BY 1, 2""")
def by_concept(spark, folder):
    return (
        _facts(spark, folder)
        .where("question_concept_id is not null")
        .groupBy(F.col("question_concept_id").alias("concept_id"), F.trunc("response_date_key", "month").alias("month"))
        .agg(F.count("*").alias("n"), F.countDistinct("respondent_id").alias("n_respondents"), F.mode("admin_mode").isNotNull().alias("has_mode"), F.bit_or("repeat_index").alias("repeats"), F.max_by("response_id", "loaded_at").isNotNull().alias("any_loaded"))
    )


@query("""
WITH n AS (SELECT site_code, questionnaire_id, COUNT(*) AS n FROM response_session WHERE site_code IS NOT NULL GROUP BY 1, 2)
SELECT site_code, SUM(n)::BIGINT AS n, MAP_FROM_ENTRIES(LIST(ROW(questionnaire_id, n) ORDER BY questionnaire_id))::VARCHAR AS by_questionnaire FROM n GROUP BY 1""")
def site_histogram(spark, folder):
    n = table(spark, folder, "response_session").where("site_code is not null").groupBy("site_code", "questionnaire_id").agg(F.count("*").alias("n"))
    entry = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("questionnaire_id", "n"))), lambda e: F.concat(e["questionnaire_id"], F.lit("="), e["n"])), ", ")
    return n.groupBy("site_code").agg(F.sum("n").alias("n"), F.concat(F.lit("{"), entry, F.lit("}")).alias("by_questionnaire"))


_MERGE_SQL = """
WITH s AS (SELECT *, CASE WHEN batch_id < 'b2024-06' THEN 0 ELSE 1 END AS source, CASE WHEN fhir_response_id <> '' THEN 'id:' || fhir_response_id ELSE concat('at:', respondent_id, '|', questionnaire_id, '|', COALESCE(started_at, '~')) END AS k FROM response_session),
w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY source, session_id) AS rn FROM s)"""


@query(_MERGE_SQL + " SELECT ROW_NUMBER() OVER (ORDER BY source, session_id) AS session_id, source, session_id AS old_id FROM w WHERE rn = 1")
def merged_sessions(spark, folder):
    """Sessions of two deliveries merged by natural key, the earlier winning, with new ids."""
    s = table(spark, folder, "response_session").select("session_id", "respondent_id", "questionnaire_id", "started_at", "fhir_response_id", "batch_id")
    natural = F.when(F.length("fhir_response_id") > 0, F.concat(F.lit("id:"), F.col("fhir_response_id"))).otherwise(F.concat(F.lit("at:"), "respondent_id", F.lit("|"), "questionnaire_id", F.lit("|"), F.coalesce("started_at", F.lit("~"))))
    s = s.withColumn("natural", natural)
    kept, _ = upsert.first_wins([s.where("batch_id < 'b2024-06'"), s.where("batch_id is null or batch_id >= 'b2024-06'")], ["natural"], "session_id")
    return kept.select(F.col("new_id").alias("session_id"), "source", F.col("session_id").alias("old_id"))


def wide_fhir_profile(spark, folder):
    """Null shares of the responses' top columns, as a profile of a nested table."""
    t = table(spark, folder, "gout_checkin_fhir_responses")
    names = [c for c in t.columns if c != "rec_no"]
    one = t.agg(F.count("*").alias("total"), *(F.count_if(F.col(c).isNull()).alias(c) for c in names))
    return one.select("total", F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in names))))


QUERIES["wide_fhir_profile"] = wide_fhir_profile
SQL["wide_fhir_profile"] = " UNION ALL ".join(f"SELECT COUNT(*) AS total, '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS n_null FROM gout_checkin_fhir_responses" for c in ("resourceType", "id", "status", "questionnaire", "authored", "subject", "item"))


from cohortspark.plans import study_questions  # noqa: E402, F401  (registers its queries here)
