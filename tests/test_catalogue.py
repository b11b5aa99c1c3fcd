from __future__ import annotations

import glob
import os
from decimal import Decimal

import pytest
from conftest import rows_of, stamp
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortspark.operators import equivalence, graphs, synthetic
from cohortspark.plans import catalogue, report
from cohortspark.sources import instruments
from cohortspark.streaming import ingest

DATA = "/root/testdata/sf0.001"


def test_entry_points():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5)} <= names


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_queries_against_another_engine(spark):
    import duckdb

    db = duckdb.connect()
    db.execute("set TimeZone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")

    def plain(v):
        return round(float(v), 6) + 0.0 if isinstance(v, (float, Decimal)) else v

    for name, sql in catalogue.SQL.items():
        df = catalogue.QUERIES[name](spark, DATA)
        found = db.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(df.columns) == sorted(columns), name
        got = sorted((tuple(plain(x) for x in r) for r in df.select(columns).collect()), key=str)
        want = sorted((tuple(plain(x) for x in r) for r in found.fetchall()), key=str)
        assert got == want, name


@pytest.mark.parametrize("name", ["question_distribution", "numeric_statistics", "respondent_scores", "equivalence_groups", "merged_sessions", "response_codes", "grid_table", "errata_sessions", "choice_distribution"])
def test_empty_and_null_tables(spark, study, name):
    assert catalogue.QUERIES[name](spark, study()).count() == 0
    catalogue.QUERIES[name](spark, study(", n int, label string, score double, top double, old_id bigint", **{t: [{}, {}] for t in ("fact_response", "question", "response_session", "concept_relationship", "gout_checkin_fhir_responses", "phq9_fhir_responses", "documents")})).collect()


def test_every_cast_failure(spark, study):
    folder = study(response_session=[{"session_id": 1, "started_at": "2024-05-05T10:00:00", "completed_at": "05.05.2024"}], concept=[{"concept_id": 2, "valid_start_date": "1970-01-01", "valid_end_date": "never"}])
    want = [("concept", "valid_end_date", 2, "never"), ("response_session", "completed_at", 1, "05.05.2024")]
    assert rows_of(catalogue.QUERIES["every_cast_failure"](spark, folder)) == want


def test_equivalence(spark):
    schema = "question_id_1 int, question_id_2 int, relationship string, confidence string"
    table = equivalence.declare(spark.createDataFrame([], schema), spark.createDataFrame([(1, 2, "equivalent", "high"), (2, 3, "near_equivalent", "low"), (4, 5, "related", "high")], schema))
    assert table.count() == 6
    assert equivalence.declare(table, spark.createDataFrame([(1, 2, "equivalent", "low")], schema)).where("question_id_1 = 1 and confidence = 'low'").count() == 0
    with pytest.raises(ValueError):
        equivalence.declare(table, spark.createDataFrame([(1, 2, "same", "high")], schema))
    groups = graphs.equivalence_groups(equivalence.grouping_edges(table))
    assert rows_of(groups) == [(1, 1), (2, 1), (3, 1)]
    names = spark.createDataFrame([(1, "a"), (3, "c")], "question_id int, link_id string")
    assert [r.link_id for r in equivalence.neighbours(table, 2, names).collect()] == ["c", "a"]
    facts = spark.createDataFrame([(1, 2.0), (3, 4.0), (9, 5.0), (2, None)], "question_id int, response_numeric double")
    assert rows_of(equivalence.pooled(facts, groups)) == [(1, 2, 3.0, 2)]


def test_synthetic_answers(spark):
    q = spark.createDataFrame([(1, "likert", None, None), (2, "numeric", 5.0, 6.0), (3, "multiple_choice", None, None), (4, "boolean", None, None), (5, "likert", None, None)], "question_id int, question_type string, numeric_min double, numeric_max double")
    o = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (3, "x", 0), (3, "y", 1)], "question_id int, option_value string, display_order int")
    rows = synthetic.synthetic_answers(spark, q, o, 500)
    assert rows_of(rows) == rows_of(synthetic.synthetic_answers(spark, q.repartition(3), o, 500))
    n = {r.question_id: r.n for r in rows.groupBy("question_id").agg(F.countDistinct("session_id").alias("n")).collect()}
    assert 420 < n[1] < 480 and 5 not in n
    assert rows.where("question_id = 2 and not response_numeric between 5 and 6").count() == 0
    assert {r.option_value for r in rows.where("question_id = 1").collect()} == {"a", "b"}


def test_exchange_round_trip():
    resource = {
        "resourceType": "Questionnaire", "url": "http://x", "version": "1", "title": "T", "status": "active",
        "contained": [{"resourceType": "ValueSet", "id": "v", "compose": {"include": [{"concept": [{"code": "1", "display": "One"}]}]}}],
        "item": [
            {"linkId": "s", "type": "group", "item": [{"linkId": "a", "text": "A", "type": "choice", "answerOption": [{"valueCoding": {"code": "c", "display": "C"}}]}, {"linkId": "v", "text": "V", "type": "choice", "repeats": True, "answerValueSet": "#v"}]},
            {"linkId": "n", "text": "N", "type": "decimal", "extension": [{"url": instruments._MIN, "valueDecimal": 1}], "enableWhen": [{"question": "a", "operator": "=", "answerCoding": {"code": "c"}}, {"question": "a", "operator": "exists", "answerBoolean": False}]},
            {"linkId": "r", "text": "R", "type": "group", "repeats": True, "item": [{"linkId": "r1", "text": "R1", "type": "date"}]},
            {"linkId": "d", "type": "display", "text": "only shown"},
        ],
    }
    rows = instruments.read_questionnaire(resource)
    assert [(q["link_id"], q["question_type"]) for q in rows["question"]] == [("a", "single_choice"), ("v", "multiple_choice"), ("n", "numeric"), ("r", "repeating_group"), ("r1", "date")]
    assert [(w["operator"], w["trigger_value"]) for w in rows["skip_rule"]] == [("=", "c"), ("not_exists", None)]
    again = instruments.read_questionnaire(instruments.write_questionnaire(rows))
    assert again == rows
    with pytest.raises(ValueError):
        instruments.read_questionnaire({"resourceType": "Patient"})


def test_reports(spark):
    cells = spark.createDataFrame([("g", 1, "0"), ("g", 1, "1"), ("g", 1, "0"), ("g", 2, None)], "grid string, row int, code string")
    assert rows_of(report.grid_table(cells, ["0", "1"]).select("row", "total", "n_0", "pct_0")) == [(1, 3, 2, 66.7), (2, 1, 0, 0.0)]
    text = report.markdown(spark.createDataFrame([("a|b", None)], "x string, y int"), "T")
    assert "a\\|b |  |" in text
    assert report.as_csv(spark.createDataFrame([("a,b", 1)], "x string, y int")) == 'x,y\n"a,b",1\n'
    with pytest.raises(ValueError):
        report.markdown(spark.range(20), "T", 10)
    q = spark.createDataFrame([(1, "l", "t", "likert", None, None)], "question_id int, link_id string, question_text string, question_type string, numeric_min double, numeric_max double")
    o = spark.createDataFrame([(1, "b", 1), (1, "a", 0)], "question_id int, option_value string, display_order int")
    p = spark.createDataFrame([(9, 1, 1, "active"), (8, 2, 1, "deprecated")], "qq_id int, questionnaire_id int, question_id int, status string")
    assert report.dictionary(q, o, p).select("valid_values", "placements").first() == ("a | b", "9")


def test_stream(spark, tmp_path, monkeypatch):
    import json

    source = tmp_path / "in"
    source.mkdir()
    r = lambda n, i: json.dumps({"rec_no": n, "resourceType": "QuestionnaireResponse", "id": i, "authored": f"2024-01-0{n}T00:00:00Z", "item": [{"linkId": "q", "answer": [{"valueString": "x"}]}]})
    (source / "1.json").write_text("\n".join([r(1, "a"), r(2, "urn:uuid:A"), r(3, None), r(4, None)]))
    run = lambda: ingest.ingest_atoms(spark, ingest.response_stream(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    with monkeypatch.context() as m:  # fails after the identifiers were taken
        m.setattr(ingest, "answer_atoms", lambda rows: 1 / 0)
        with pytest.raises(Exception, match="ZeroDivision|division"):
            run()
    run()
    assert sorted(x.rec_no for x in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3, 4]
    (source / "2.json").write_text("\n".join([r(5, "A"), r(6, "b")]))
    run()
    assert sorted(x.rec_no for x in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3, 4, 6]
    q = ingest.windowed_counts(ingest.response_stream(spark, str(source)), window="1 day").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 6
    assert stamp("2024-01-01")


@pytest.mark.parametrize("name", ["fact_response", "reversed_scores", "structural_missing", "values_outside", "imported_answers", "flag_summary", "site_mean_without_errata", "companion_aggregates", "equivalence_mirror", "numeric_sketch"])
def test_study_questions_on_empty_and_null_tables(spark, study, name):
    assert catalogue.QUERIES[name](spark, study()).count() == 0
    tables = ("fact_response", "question", "response_session", "concept_relationship", "questionnaire_question", "skip_rule", "documents", "gout_checkin_fhir_responses")
    catalogue.QUERIES[name](spark, study(", n int, label string, points double, longer string", **{t: [{}, {}] for t in tables})).collect()


def test_documents_where(spark):
    from cohortspark.plans.study_questions import documents_where

    d = spark.createDataFrame([("note", 1, "a"), ("erratum", 1, "a"), ("erratum", None, "b")], "doc_kind string, study_id int, source string")
    assert [documents_where(d, **w).count() for w in ({}, {"kind": "erratum"}, {"kind": "erratum", "study": 1, "source": None})] == [3, 2, 1]
    with pytest.raises(ValueError):
        documents_where(d, colour="red")


def test_lineage_is_recorded(spark):
    schema = "question_id int, parent_question_id int, change_type string"
    old = spark.createDataFrame([(2, 1, "reword")], schema)
    new = equivalence.record_lineage(old, spark.createDataFrame([(2, 1, "reword"), (3, 2, "split")], schema))
    assert rows_of(new) == [(2, 1, "reword"), (3, 2, "split")]
    for row in ((2, 2, "reword"), (3, 2, "renamed"), (3, None, "split")):
        with pytest.raises(ValueError):
            equivalence.record_lineage(old, spark.createDataFrame([row], schema))
