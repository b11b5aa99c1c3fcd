"""More standard questions: the star schema's loading, comparisons between sites, versions and instruments, and quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators import equivalence, graphs, response_import, scoring, star
from cohortspark.operators.skew import broadcast_if_small, spread_join
from cohortspark.plans.catalogue import _ATOMS_SQL, _POINTS_SQL, _SCORE_SQL, _STAMP, _facts, _scores, _share, _typed, POINTS, query
from cohortspark.sources.tables import table

# --- loading of the star schema from the transactional side, as far as the tables tell it ----------------------------------

_OLTP_SQL = """
WITH placement AS (SELECT qq_id, MIN(questionnaire_id) AS questionnaire_id, MIN(question_id) AS question_id FROM questionnaire_question WHERE deleted_at IS NULL GROUP BY 1),
qn AS (SELECT q.question_id, q.question_type, c.concept_id FROM question q LEFT JOIN (SELECT question_id, MAX(question_concept_id) AS concept_id FROM fact_response GROUP BY 1) c ON c.question_id = q.question_id),
opt AS (SELECT option_id, MAX(option_value) AS option_value, MAX(option_concept_id) AS concept_id FROM fact_response WHERE option_id IS NOT NULL GROUP BY 1),
who AS (SELECT respondent_id, MIN(study_id) AS study_id FROM fact_response GROUP BY 1)"""


def _oltp(spark, folder) -> dict[str, DataFrame]:
    """Transactional tables behind the study's tables: answers with booleans and dates as text, sessions, undeleted placements,
    questions and options with their concepts, and the respondents that have answers."""
    f = table(spark, folder, "fact_response")
    answer = f.select("response_id", "session_id", "qq_id", "option_id", "grid_row_id", "grid_column_id", "repeat_index", F.coalesce(F.col("response_boolean").cast("string"), "response_text").alias("response_text"), "response_numeric", F.col("response_date").cast("string").alias("response_date"))
    concepts = f.groupBy("question_id").agg(F.max("question_concept_id").alias("concept_id"))
    return {
        "response": answer,
        "response_session": table(spark, folder, "response_session"),
        "questionnaire_question": table(spark, folder, "questionnaire_question").where("deleted_at is null").groupBy("qq_id").agg(F.min("questionnaire_id").alias("questionnaire_id"), F.min("question_id").alias("question_id")),
        "question": table(spark, folder, "question").join(concepts, "question_id", "left"),
        "respondent": f.groupBy("respondent_id").agg(F.min("study_id").alias("study_id")),
        "response_option": f.where("option_id is not null").groupBy("option_id").agg(F.max("option_value").alias("option_value"), F.max("option_concept_id").alias("concept_id")),
    }


@query(_OLTP_SQL + f""",
r AS (SELECT f.*, COALESCE(CAST(f.response_boolean AS VARCHAR), f.response_text) AS txt FROM fact_response f),
s AS (SELECT session_id, respondent_id, TRY_CAST(CASE WHEN regexp_matches(started_at, {_STAMP}) THEN started_at END AS TIMESTAMP) AS started, TRY_CAST(CASE WHEN regexp_matches(completed_at, {_STAMP}) THEN completed_at END AS TIMESTAMP) AS completed,
      admin_mode, COALESCE(is_proxy, 0) <> 0 AS is_proxy, interviewer_id FROM response_session)
SELECT r.response_id, r.session_id, s.respondent_id, p.questionnaire_id, COALESCE(w.study_id, -1) AS study_id, p.question_id, r.qq_id, r.option_id, r.grid_row_id, r.grid_column_id, r.repeat_index, r.txt AS response_text,
  CASE WHEN r.response_numeric IS NOT NULL THEN r.response_numeric WHEN q.question_type IN ('single_choice', 'multiple_choice', 'sata_other', 'likert', 'ranked') AND regexp_matches(o.option_value, '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$') THEN TRY_CAST(o.option_value AS DOUBLE) END AS response_numeric,
  r.response_date, CASE WHEN q.question_type = 'boolean' AND r.txt IN ('true', 'false') THEN r.txt = 'true' END AS response_boolean, o.option_value, q.concept_id AS question_concept_id, o.concept_id AS option_concept_id,
  CAST(COALESCE(s.completed, s.started) AS DATE) AS response_date_key, CAST(s.started AS DATE) AS session_start_key, s.admin_mode, s.is_proxy, s.interviewer_id
FROM r JOIN s ON s.session_id = r.session_id JOIN placement p ON p.qq_id = r.qq_id JOIN qn q ON q.question_id = p.question_id JOIN who w ON w.respondent_id = s.respondent_id LEFT JOIN opt o ON o.option_id = r.option_id""")
def fact_response(spark, folder):
    t = _oltp(spark, folder)
    return star.fact_response(t["response"], t["response_session"], t["questionnaire_question"], t["question"], t["respondent"], t["response_option"])


@query("SELECT concept_id, concept_name, domain_id, vocabulary_id, concept_class_id, standard_concept, concept_code FROM concept")
def dim_concept(spark, folder):
    return star.dim_concept(table(spark, folder, "concept"))


@query(_OLTP_SQL + " SELECT respondent_id, COALESCE(study_id, -1) AS study_id FROM who")
def dim_respondent(spark, folder):
    return star.dim_respondent(_oltp(spark, folder)["respondent"].withColumn("external_id", F.lit(None).cast("string"))).select("respondent_id", "study_id")


@query(_OLTP_SQL + """ SELECT o.option_id, o.option_value, o.concept_id, c.concept_name, c.concept_code FROM opt o LEFT JOIN (SELECT concept_id, MIN(concept_name) AS concept_name, MIN(concept_code) AS concept_code FROM concept GROUP BY 1) c ON c.concept_id = o.concept_id""")
def dim_response_option(spark, folder):
    concepts = table(spark, folder, "concept").groupBy("concept_id").agg(F.min("concept_name").alias("concept_name"), F.min("concept_code").alias("concept_code"))
    none = {c: F.lit(None).cast("string") for c in ("option_text", "concept_system")} | {c: F.lit(None).cast("int") for c in ("question_id", "display_order", "option_set_id", "is_other", "is_exclusive")}
    return star.dim_response_option(_oltp(spark, folder)["response_option"].withColumns(none), concepts).select("option_id", "option_value", "concept_id", "concept_name", "concept_code")


@query(_OLTP_SQL + """ SELECT q.question_id, q.concept_id, c.concept_name, c.vocabulary_id, c.concept_code FROM qn q LEFT JOIN concept c ON c.concept_id = q.concept_id""")
def dim_question_concepts(spark, folder):
    """:func:`star.dim_question` with the concepts under which questions were answered."""
    return star.dim_question(_oltp(spark, folder)["question"], table(spark, folder, "concept")).select("question_id", "concept_id", "concept_name", "vocabulary_id", "concept_code")


_DATE_SQL = r"CASE WHEN regexp_matches({0}, '^\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}$') THEN TRY_CAST(replace({0}, '/', '-') AS DATE) END"


@query("SELECT DISTINCT concept_id_1 AS question_id, concept_id_2 AS parent_question_id, 'other' AS change_type, " + _DATE_SQL.format("valid_start_date") + " AS effective_date FROM concept_relationship WHERE relationship_id = 'Replaced by'")
def lineage_mirror(spark, folder):
    r = table(spark, folder, "concept_relationship").where("relationship_id = 'Replaced by'")
    return star.dim_question_lineage(r.select(F.col("concept_id_1").alias("question_id"), F.col("concept_id_2").alias("parent_question_id"), F.lit("other").alias("change_type"), F.col("valid_start_date").alias("effective_date"))).distinct()


@query("""
WITH RECURSIVE t AS (SELECT DISTINCT concept_id_1 AS question_id_1, concept_id_2 AS question_id_2, CASE relationship_id WHEN 'Replaced by' THEN 'equivalent' ELSE 'related' END AS relationship FROM concept_relationship WHERE relationship_id IN ('Replaced by', 'Is a') AND concept_id_2 IS NOT NULL),
e AS (SELECT question_id_1 AS a, question_id_2 AS b FROM t WHERE relationship = 'equivalent' AND question_id_1 <> question_id_2), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS other FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.other = u.a),
g AS (SELECT node, MAX(other) AS root FROM r GROUP BY node), k AS (SELECT node, DENSE_RANK() OVER (ORDER BY root) AS group_id FROM g)
SELECT t.*, k.group_id FROM t LEFT JOIN k ON k.node = t.question_id_1""")
def equivalence_mirror(spark, folder):
    r = table(spark, folder, "concept_relationship").where("relationship_id in ('Replaced by', 'Is a') and concept_id_2 is not null")
    t = r.select(F.col("concept_id_1").alias("question_id_1"), F.col("concept_id_2").alias("question_id_2"), F.when(F.col("relationship_id") == "Replaced by", "equivalent").otherwise("related").alias("relationship")).distinct()
    return star.dim_question_equivalence(t).select("question_id_1", "question_id_2", "relationship", "group_id")


# --- answers by type -----------------------------------------------------------------------------------------------------


def _points():
    values = F.create_map(*(F.lit(x) for kv in POINTS.items() for x in kv))
    return F.try_element_at(values, F.lower(F.trim(F.translate("option_value", "\t", " "))))


@query(f"SELECT q.link_id, COUNT({_POINTS_SQL}) AS n, ROUND(AVG({_POINTS_SQL}), 6) AS mean FROM fact_response f JOIN question q ON q.question_id = f.question_id WHERE q.question_type = 'likert' GROUP BY 1")
def likert_means(spark, folder):
    return _typed(spark, folder, "likert").groupBy("link_id").agg(F.count(_points()).alias("n"), F.round(F.avg(_points()), 6).alias("mean"))


@query(f"SELECT f.session_id, q.link_id, MAX({_POINTS_SQL}) AS points FROM fact_response f JOIN question q ON q.question_id = f.question_id WHERE q.question_type = 'likert' AND {_POINTS_SQL} IS NOT NULL GROUP BY 1, 2")
def likert_scored(spark, folder):
    return _typed(spark, folder, "likert").withColumn("points", _points()).where("points is not null").groupBy("session_id", "link_id").agg(F.max("points").alias("points"))


def option_bar(facts: DataFrame, questions: DataFrame, link_id: str) -> DataFrame:
    """Answers to one question by option, with their share."""
    n = facts.join(broadcast_if_small(questions.where(F.col("link_id") == link_id).select("question_id")), "question_id").where("option_value is not null").groupBy("option_value").agg(F.count("*").alias("n"))
    return n.withColumn("total", n.agg(F.sum("n")).scalar()).select("option_value", "n", _share("n", "total").alias("pct"))


@query("SELECT f.option_value, COUNT(*) AS n, ROUND(100.0 * COUNT(*) / (SUM(COUNT(*)) OVER ())::DOUBLE, 1) AS pct FROM fact_response f JOIN question q ON q.question_id = f.question_id WHERE q.link_id = 'mood.burden' AND f.option_value IS NOT NULL GROUP BY 1")
def single_choice_bar(spark, folder):
    return option_bar(_facts(spark, folder), table(spark, folder, "question"), "mood.burden")


@query("""
SELECT q.link_id, COALESCE(f.option_value, '(other)') AS bucket, COUNT(*) AS n, COUNT(DISTINCT CASE WHEN f.option_value IS NULL THEN f.response_text END) AS n_texts FROM fact_response f JOIN question q ON q.question_id = f.question_id
WHERE q.question_type IN ('multiple_choice', 'sata_other') AND (f.option_value IS NOT NULL OR f.response_text IS NOT NULL) GROUP BY 1, 2""")
def sata_other(spark, folder):
    f = _typed(spark, folder, "multiple_choice", "sata_other").where("option_value is not null or response_text is not null")
    return f.groupBy("link_id", F.coalesce("option_value", F.lit("(other)")).alias("bucket")).agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("option_value").isNull(), F.col("response_text"))).alias("n_texts"))


@query("SELECT q.link_id, f.response_id, f.session_id, f.response_numeric FROM fact_response f JOIN question q ON q.question_id = f.question_id WHERE q.question_type IN ('slider', 'numeric') AND f.response_numeric IS NOT NULL")
def slider_values(spark, folder):
    return _typed(spark, folder, "slider", "numeric").where("response_numeric is not null").select("link_id", "response_id", "session_id", "response_numeric")


def triggered(facts: DataFrame, trigger: int, when: bool, target: int) -> DataFrame:
    """One row: sessions in which a boolean question has the value ``when``, and those of them with an answer to ``target``."""
    s = facts.where(F.col("question_id").isin(trigger, target)).groupBy("session_id").agg(F.bool_or(F.when(F.col("question_id") == trigger, F.col("response_boolean") == when)).alias("on"), F.bool_or(F.col("question_id") == target).alias("answered"))
    return s.agg(F.count_if("on").alias("n_triggered"), F.count_if(F.col("on") & F.col("answered")).alias("n_answered"))


@query("""
WITH s AS (SELECT session_id, BOOL_OR(CASE WHEN question_id = 134 THEN NOT response_boolean END) AS on_, BOOL_OR(question_id = 137) AS answered FROM fact_response WHERE question_id IN (134, 137) GROUP BY 1)
SELECT COUNT(*) FILTER (WHERE on_) AS n_triggered, COUNT(*) FILTER (WHERE on_ AND answered) AS n_answered FROM s""")
def skip_triggered(spark, folder):
    return triggered(_facts(spark, folder), 134, False, 137)


# --- scores ----------------------------------------------------------------------------------------------------------------


@query(_SCORE_SQL + """, v AS (SELECT respondent_id, COUNT(DISTINCT session_id) AS visits FROM fact_response GROUP BY 1)
SELECT s.category, COUNT(*) AS n, ROUND(AVG(v.visits), 6) AS mean_visits FROM scored s JOIN v ON v.respondent_id = s.respondent_id GROUP BY 1""")
def severity_visits(spark, folder):
    visits = _facts(spark, folder).groupBy("respondent_id").agg(F.countDistinct("session_id").alias("visits"))
    return spread_join(_scores(spark, folder), visits, ["respondent_id"], F.col("session_id")).groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("visits"), 6).alias("mean_visits"))


@query(_SCORE_SQL + " SELECT 'mood sum' AS name, questionnaire_id, items_answered, COUNT(*) AS n, ROUND(AVG(score), 6) AS mean FROM scored GROUP BY 2, 3")
def scores_direct(spark, folder):
    return _scores(spark, folder).groupBy("name", "questionnaire_id", "items_answered").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query(f"""
WITH p AS (SELECT f.session_id, f.respondent_id, f.questionnaire_id, f.question_id, {_POINTS_SQL} AS v FROM fact_response f JOIN question q ON q.question_id = f.question_id WHERE q.question_type = 'likert'),
m AS (SELECT question_id, MAX(v) AS top FROM p GROUP BY 1)
SELECT session_id, SUM(COALESCE(m.top, 0) - v) AS score, COUNT(*) AS items_answered FROM p JOIN m ON m.question_id = p.question_id WHERE v IS NOT NULL GROUP BY session_id, questionnaire_id, respondent_id""")
def reversed_scores(spark, folder):
    """Scores of reversed items, whose maximum is the greatest value among the options that occur."""
    f = _typed(spark, folder, "likert").withColumn("response_numeric", _points())
    q = table(spark, folder, "question").where("question_type = 'likert'")
    forms = _facts(spark, folder).select("questionnaire_id").where("questionnaire_id is not null").distinct()
    rules = forms.select(F.col("questionnaire_id").alias("rule_id"), F.lit("reversed").alias("name"), "questionnaire_id", F.lit("sum").alias("formula"))
    items = q.select("question_id", F.lit(1.0).alias("weight"), F.lit(True).alias("reverse")).join(rules.select("rule_id"), F.lit(True))
    bands = spark.sql("select cast(null as int) rule_id, cast(null as double) low, cast(null as double) high, cast(null as string) label, 0 place where false")
    return scoring.scores(f, rules, items, bands, f.select("question_id", F.col("response_numeric").alias("value"))).select("session_id", "score", "items_answered")


# --- quality ----------------------------------------------------------------------------------------------------------------


@query("""
WITH gated AS (SELECT DISTINCT p.questionnaire_id, p.question_id FROM skip_rule r JOIN questionnaire_question p ON p.qq_id = r.qq_id WHERE p.deleted_at IS NULL),
s AS (SELECT questionnaire_id, COUNT(DISTINCT session_id) AS sessions FROM fact_response GROUP BY 1), a AS (SELECT questionnaire_id, question_id, COUNT(DISTINCT session_id) AS answered FROM fact_response GROUP BY 1, 2)
SELECT a.questionnaire_id, a.question_id, CASE WHEN g.question_id IS NULL THEN 'true' ELSE 'structural' END AS kind, s.sessions - a.answered AS n_missing
FROM a JOIN s ON s.questionnaire_id = a.questionnaire_id LEFT JOIN gated g ON g.questionnaire_id = a.questionnaire_id AND g.question_id = a.question_id WHERE s.sessions > a.answered""")
def structural_missing(spark, folder):
    """Missing answers by question: structural where a rule may hide the question, else truly missing."""
    f = _facts(spark, folder)
    p = table(spark, folder, "questionnaire_question").where("deleted_at is null").select("qq_id", "questionnaire_id", "question_id")
    gated = table(spark, folder, "skip_rule").select("qq_id").distinct().join(p, "qq_id").select("questionnaire_id", "question_id", F.lit(True).alias("gated")).distinct()
    answered = f.groupBy("questionnaire_id", "question_id").agg(F.countDistinct("session_id").alias("answered"))
    m = answered.join(f.groupBy("questionnaire_id").agg(F.countDistinct("session_id").alias("sessions")), "questionnaire_id").where("sessions > answered")
    return m.join(gated, ["questionnaire_id", "question_id"], "left").select("questionnaire_id", "question_id", F.when(F.col("gated"), "structural").otherwise("true").alias("kind"), (F.col("sessions") - F.col("answered")).alias("n_missing"))


@query("""
SELECT doc_kind, study_id, COUNT(*) AS n FROM documents WHERE doc_kind IS NOT NULL GROUP BY 1, 2 ORDER BY CASE doc_kind WHEN 'erratum' THEN 0 WHEN 'note' THEN 1 ELSE 2 END, COUNT(DISTINCT source) DESC, doc_kind, study_id LIMIT 8""")
def errata_first(spark, folder):
    """The eight first groups of documents: errata before notes before others, those from most sources first."""
    rank = F.when(F.col("doc_kind") == "erratum", 0).when(F.col("doc_kind") == "note", 1).otherwise(2)
    n = table(spark, folder, "documents").where("doc_kind is not null").groupBy("doc_kind", "study_id").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))
    return n.orderBy(rank, F.desc("sources"), "doc_kind", F.asc_nulls_last("study_id")).limit(8).drop("sources")


def documents_where(documents: DataFrame, **wanted) -> DataFrame:
    """Documents that meet all given conditions; those not given, or None, don't count. kind, study, source, since, until."""
    tests = {"kind": lambda v: F.col("doc_kind") == v, "study": lambda v: F.col("study_id") == v, "source": lambda v: F.col("source") == v, "since": lambda v: F.col("recorded_at") >= v, "until": lambda v: F.col("recorded_at") < v}
    if unknown := wanted.keys() - tests.keys():
        raise ValueError(f"unknown conditions: {sorted(unknown)}")
    return reduce(lambda df, k: df.where(tests[k](wanted[k])), [k for k in tests if wanted.get(k) is not None], documents)


@query("SELECT source, COUNT(*) AS n FROM documents WHERE doc_kind = 'erratum' AND recorded_at >= TIMESTAMP '2023-06-01' GROUP BY 1")
def errata_open(spark, folder):
    return documents_where(table(spark, folder, "documents"), kind="erratum", since="2023-06-01", study=None).groupBy("source").agg(F.count("*").alias("n"))


@query("""
SELECT 'questionnaire_question' AS tbl, 'status' AS col, status AS value, COUNT(*) AS n FROM questionnaire_question WHERE status NOT IN ('active') OR status IS NULL GROUP BY 3
UNION ALL SELECT 'skip_rule', 'operator', operator, COUNT(*) FROM skip_rule WHERE operator NOT IN ('=', '!=') OR operator IS NULL GROUP BY 3
UNION ALL SELECT 'fact_response', 'admin_mode', admin_mode, COUNT(*) FROM fact_response WHERE admin_mode NOT IN ('web', 'phone') OR admin_mode IS NULL GROUP BY 3""")
def values_outside(spark, folder):
    """Values outside a list, with their number; null is outside every list."""
    lists = {"questionnaire_question": ("status", ["active"]), "skip_rule": ("operator", ["=", "!="]), "fact_response": ("admin_mode", ["web", "phone"])}
    parts = [table(spark, folder, t).where(~F.coalesce(F.col(c).isin(*v), F.lit(False))).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(t).alias("tbl"), F.lit(c).alias("col"), "value", "n") for t, (c, v) in lists.items()]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT rule_id, qq_id, MAX(enable_behavior) OVER (PARTITION BY qq_id) AS behavior, COUNT(*) OVER (PARTITION BY qq_id) AS n_rules FROM skip_rule WHERE qq_id IS NOT NULL")
def rule_behavior(spark, folder):
    w = Window.partitionBy("qq_id")
    return table(spark, folder, "skip_rule").where("qq_id is not null").select("rule_id", "qq_id", F.max("enable_behavior").over(w).alias("behavior"), F.count("*").over(w).alias("n_rules"))


# The questions of the check-in that are imported here (type, range), some of its options, and its grid.
_ITEMS = [("gout.flares", "numeric", 0.0, 12.0), ("gout.joints", "multiple_choice", None, None), ("gout.flare_on", "date", None, None), ("gout.joint_pain", "grid", None, None), ("gout.visit.at", "datetime", None, None), ("gout.visit.urate", "numeric", 3.0, 9.0),
          ("gout.kin", "multiple_choice", None, None), ("gout.priority", "ranked", None, None), ("gout.tablet", "boolean", None, None), ("gout.urate_on", "date", None, None), ("gout.urate", "numeric", 3.0, 9.0), ("gout.pain", "slider", 0.0, 10.0)]
_OPTIONS = [("gout.joints", "knee"), ("gout.joints", "instep"), ("gout.kin", "grandparent"), ("gout.kin", "parent"), ("gout.priority", "fewer_tablets")]
_FORM, _GRID_ROWS, _GRID_COLUMNS = "http://forms.example/instruments/gout-checkin", range(6), ["0", "1", "2", "3"]

_sql = lambda v: "NULL::DOUBLE" if v is None else repr(v)
_IMPORT_SQL = _ATOMS_SQL + f""",
defs AS (SELECT * FROM (VALUES {", ".join(f"({n}, '{link}', '{kind}', {_sql(low)}, {_sql(high)})" for n, (link, kind, low, high) in enumerate(_ITEMS, 1))}) t(qq_id, link_id, typ, low, high)),
opts AS (SELECT * FROM (VALUES {", ".join(f"({n}, '{link}', '{code}')" for n, (link, code) in enumerate(_OPTIONS, 1))}) t(option_id, link_id, code)),
v AS (SELECT r.rec_no, CASE WHEN r.up = 'gout.joint_pain' THEN r.up ELSE r.link_id END AS link_id, r.up IS NOT DISTINCT FROM 'gout.joint_pain' AS in_grid, TRY_CAST(regexp_extract(r.link_id, '\\.r(\\d+)$', 1) AS INTEGER) AS cell_row, COALESCE(y.valueCoding.code, y.valueCoding.display) AS code,
      CASE WHEN y.valueCoding IS NOT NULL THEN 'coding' WHEN y.valueBoolean IS NOT NULL THEN 'boolean' WHEN y.valueDecimal IS NOT NULL THEN 'decimal' WHEN y.valueInteger IS NOT NULL THEN 'integer' WHEN y.valueDate IS NOT NULL THEN 'date' WHEN y.valueDateTime IS NOT NULL THEN 'dateTime' WHEN y.valueString IS NOT NULL THEN 'string' END AS kind,
      COALESCE(y.valueDecimal, CAST(y.valueInteger AS DOUBLE)) AS num, COALESCE(CAST(y.valueBoolean AS VARCHAR), y.valueDate, y.valueDateTime, y.valueString) AS txt, list_filter(y.extension, lambda e: e.url LIKE '%ordinal%')[1].valueDecimal AS rank
      FROM r JOIN gout_checkin_fhir_responses g ON g.rec_no = r.rec_no WHERE split_part(g.questionnaire, '|', 1) = '{_FORM}'),
m AS (SELECT v.*, d.qq_id, o.option_id, CASE WHEN d.typ = 'grid' AND cell_row BETWEEN 0 AND 5 AND in_grid THEN cell_row + 10 END AS grid_row_id, CASE WHEN d.typ = 'grid' AND kind = 'coding' AND v.code IN ('0', '1', '2', '3') THEN CAST(v.code AS INTEGER) + 20 END AS grid_column_id,
      CASE d.typ WHEN 'numeric' THEN kind IN ('decimal', 'integer') WHEN 'slider' THEN kind IN ('decimal', 'integer') WHEN 'boolean' THEN kind = 'boolean' WHEN 'date' THEN kind = 'date' WHEN 'datetime' THEN kind IN ('date', 'dateTime') ELSE kind = 'coding' END AS fits, d.low, d.high
      FROM v JOIN defs d ON d.link_id = v.link_id LEFT JOIN opts o ON o.link_id = v.link_id AND o.code = v.code AND v.kind = 'coding' WHERE v.kind IS NOT NULL),
f AS (SELECT *, CASE WHEN NOT fits THEN 'type' WHEN in_grid AND (grid_row_id IS NULL OR grid_column_id IS NULL) THEN 'grid' WHEN kind IN ('decimal', 'integer') AND (num < low OR num > high) THEN 'range' END AS rule FROM m)"""


def _imported(spark, folder) -> response_import.Imported:
    rows = lambda schema, data: spark.createDataFrame(data, schema)
    place = {link: n for n, (link, *_) in enumerate(_ITEMS, 1)}
    study = {
        "questionnaire": rows("questionnaire_id int, canonical_url string", [(1, _FORM)]),
        "questionnaire_question": rows("qq_id int, questionnaire_id int, question_id int", [(n, 1, n) for n in place.values()]),
        "question": rows("question_id int, link_id string, question_type string, numeric_min double, numeric_max double", [(place[i[0]], *i) for i in _ITEMS]),
        "response_option": rows("option_id int, question_id int, option_value string", [(n, place[link], code) for n, (link, code) in enumerate(_OPTIONS, 1)]),
        "grid_row": rows("row_id int, question_id int, display_order int", [(10 + n, place["gout.joint_pain"], n) for n in _GRID_ROWS]),
        "grid_column": rows("column_id int, question_id int, column_value string", [(20 + n, place["gout.joint_pain"], c) for n, c in enumerate(_GRID_COLUMNS)]),
    }
    return response_import.import_responses(table(spark, folder, "gout_checkin_fhir_responses"), study)


@query(_IMPORT_SQL + """ SELECT rec_no, qq_id, option_id, grid_row_id, grid_column_id, CASE WHEN kind NOT IN ('date', 'dateTime') THEN txt END AS response_text,
COALESCE(CASE WHEN kind IN ('decimal', 'integer') THEN num END, CASE WHEN kind = 'coding' THEN rank END) AS response_numeric, CASE WHEN kind IN ('date', 'dateTime') THEN txt END AS response_date FROM f WHERE rule IS NULL OR rule = 'range'""")
def imported_answers(spark, folder):
    """The check-in's nested responses as rows of answers, with their options and cells."""
    return _imported(spark, folder).answers.drop("repeat_index")


@query(_IMPORT_SQL + " SELECT link_id, rule, CASE rule WHEN 'range' THEN 'warning' ELSE 'error' END AS severity, COUNT(*) AS n FROM f WHERE rule IS NOT NULL GROUP BY 1, 2")
def flag_summary(spark, folder):
    """Quality flags of the import, by question and rule."""
    return _imported(spark, folder).flags.groupBy("link_id", "rule", "severity").agg(F.count("*").alias("n"))


@query(f"""SELECT rec_no, regexp_replace(subject.reference, '^[^/]*/', '') AS external_id, id AS fhir_response_id, authored AS started_at, CASE WHEN COALESCE(status, 'completed') = 'completed' THEN authored END AS completed_at, (COALESCE(status, 'completed') = 'completed')::INTEGER AS is_complete
FROM gout_checkin_fhir_responses WHERE split_part(questionnaire, '|', 1) = '{_FORM}'""")
def imported_sessions(spark, folder):
    return _imported(spark, folder).sessions.drop("questionnaire_id")


# --- between versions and sites ----------------------------------------------------------------------------------------------


@query("SELECT question_id, questionnaire_id, COUNT(*) AS n, COUNT(DISTINCT session_id) AS n_sessions, ROUND(AVG(response_numeric), 6) AS mean FROM fact_response GROUP BY 1, 2")
def cross_version_items(spark, folder):
    """Each item in each questionnaire that asks it."""
    return _facts(spark, folder).groupBy("question_id", "questionnaire_id").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("n_sessions"), F.round(F.avg("response_numeric"), 6).alias("mean"))


_SITE_SQL = ", site AS (SELECT session_id, MIN(site_code) AS site_code FROM response_session GROUP BY 1)"


def _sites_of(spark, folder) -> DataFrame:
    return table(spark, folder, "response_session").groupBy("session_id").agg(F.min("site_code").alias("site_code"))


@query(_SCORE_SQL + _SITE_SQL + " SELECT t.site_code, s.category, COUNT(*) AS n, ROUND(100.0 * COUNT(*) / (SUM(COUNT(*)) OVER (PARTITION BY t.site_code))::DOUBLE, 1) AS pct FROM scored s JOIN site t ON t.session_id = s.session_id GROUP BY 1, 2")
def site_score_distribution(spark, folder):
    n = _scores(spark, folder).join(_sites_of(spark, folder), "session_id").groupBy("site_code", "category").agg(F.count("*").alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy("site_code"))).select("site_code", "category", "n", _share("n", "total").alias("pct"))


@query(_SCORE_SQL + _SITE_SQL + """, hit AS (SELECT DISTINCT f.session_id FROM documents d JOIN fact_response f ON f.study_id = d.study_id AND f.loaded_at BETWEEN d.recorded_at AND d.recorded_at + INTERVAL 6 HOUR WHERE d.doc_kind = 'erratum')
SELECT t.site_code, COUNT(*) AS n, ROUND(AVG(s.score), 6) AS mean FROM scored s JOIN site t ON t.session_id = s.session_id WHERE s.session_id NOT IN (SELECT session_id FROM hit WHERE session_id IS NOT NULL) GROUP BY 1""")
def site_mean_without_errata(spark, folder):
    """Mean score by site without the sessions that errata of their study touch."""
    from cohortspark.operators import ranges

    errata = table(spark, folder, "documents").where("doc_kind = 'erratum'").select("study_id", "recorded_at", (F.col("recorded_at") + F.expr("interval 6 hours")).alias("until"))
    touched = ranges.interval_join(_facts(spark, folder).select("study_id", "session_id", "loaded_at").distinct(), errata, ["study_id"], "loaded_at", "recorded_at", "until", 6 * 3600 * 1_000_000).select("session_id").distinct()
    return _scores(spark, folder).join(touched, "session_id", "left_anti").join(_sites_of(spark, folder), "session_id").groupBy("site_code").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query("WITH site AS (SELECT session_id, MIN(site_code) AS site_code FROM response_session GROUP BY 1) SELECT t.site_code, f.question_id, f.option_value, COUNT(*) AS n FROM fact_response f JOIN site t ON t.session_id = f.session_id WHERE f.option_value IS NOT NULL GROUP BY 1, 2, 3")
def site_items(spark, folder):
    return _facts(spark, folder).where("option_value is not null").join(_sites_of(spark, folder), "session_id").groupBy("site_code", "question_id", "option_value").agg(F.count("*").alias("n"))


# --- aggregates -----------------------------------------------------------------------------------------------------------------


@query("""
SELECT q.link_id, QUANTILE_DISC(response_numeric, 0.5) AS middle, ROUND(QUANTILE_CONT(response_numeric, 0.9), 6) AS p90, ROUND(STDDEV_POP(response_numeric), 6) AS sd, ROUND(VAR_SAMP(response_numeric), 6) AS variance
FROM fact_response f JOIN question q ON q.question_id = f.question_id WHERE q.question_type IN ('numeric', 'slider') AND response_numeric IS NOT NULL GROUP BY 1""")
def numeric_quantiles(spark, folder):
    v = F.col("response_numeric")
    f = _typed(spark, folder, "numeric", "slider").where(v.isNotNull())
    return f.groupBy("link_id").agg(F.expr("percentile_disc(0.5) within group (order by response_numeric)").alias("middle"), F.round(F.percentile(v, 0.9), 6).alias("p90"), F.round(F.stddev_pop(v), 6).alias("sd"), F.round(F.var_samp(v), 6).alias("variance"))


def numeric_sketch(spark, folder):
    """Approximate figures whose memory doesn't grow with the number of values: quartiles within 0.1 % of the ranks, distinct values within 5 %."""
    v = F.col("response_numeric")
    return _typed(spark, folder, "numeric", "slider").where(v.isNotNull()).groupBy("link_id").agg(F.percentile_approx(v, [0.25, 0.5, 0.75], 1000).alias("quartiles"), F.approx_count_distinct(v).alias("n_values"), F.any_value(v).alias("some_value"))


@query("""
WITH c AS (SELECT question_id, admin_mode, COUNT(*) AS n FROM fact_response WHERE admin_mode IS NOT NULL GROUP BY 1, 2), m AS (SELECT question_id, admin_mode, ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY n DESC, admin_mode) AS k FROM c)
SELECT f.question_id, MIN(m.admin_mode) AS usual_mode, ARG_MAX(f.response_id, (f.loaded_at, f.response_id)) AS newest, STRING_AGG(DISTINCT f.admin_mode, '|' ORDER BY f.admin_mode) AS modes, BIT_AND(f.response_id) AS bits_all, BIT_OR(f.response_id) AS bits_any, BOOL_AND(f.response_boolean) AS all_true
FROM fact_response f JOIN m ON m.question_id = f.question_id AND m.k = 1 WHERE f.loaded_at IS NOT NULL GROUP BY 1""")
def companion_aggregates(spark, folder):
    f = _facts(spark, folder)
    n = f.where("admin_mode is not null").groupBy("question_id", "admin_mode").agg(F.count("*").alias("n"))
    usual = n.groupBy("question_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "admin_mode")).alias("m"), F.array_join(F.array_sort(F.collect_set("admin_mode")), "|").alias("modes")).select("question_id", F.col("m.admin_mode").alias("usual_mode"), "modes")
    newest = F.max_by("response_id", F.struct("loaded_at", "response_id"))
    found = f.where("loaded_at is not null").groupBy("question_id").agg(newest.alias("newest"), F.bit_and("response_id").alias("bits_all"), F.bit_or("response_id").alias("bits_any"), F.bool_and("response_boolean").alias("all_true"))
    return found.join(usual, "question_id").select("question_id", "usual_mode", "newest", "modes", "bits_all", "bits_any", "all_true")


from cohortspark.plans.catalogue import QUERIES  # noqa: E402

QUERIES["numeric_sketch"] = numeric_sketch
