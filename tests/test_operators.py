from __future__ import annotations

import json
import random
import sqlite3

import pandas as pd
import pytest
from conftest import rows_of, stamp
from pyspark.sql import functions as F

from cohortspark.functions import semantics
from cohortspark.operators import disclosure, graphs, ranges, response_atoms, scoring, site_merge, star, upsert
from cohortspark.plans import refresh
from cohortspark.sources import study_files


def test_guarded_casts(spark):
    df = spark.createDataFrame([("2024-06-01",), ("2024",), ("2024-06",), ("2024/06/01",), ("tomorrow",), ("2024-99-99",), (None,), ("2024-02-30",)], "s string")
    assert [str(r[0]) for r in df.select(semantics.iso_date(F.col("s"))).collect()] == ["2024-06-01", "None", "None", "2024-06-01", "None", "None", "None", "None"]
    df = spark.createDataFrame([("1.5",), ("1d",), ("1_000",), ("1e2",), (".5",), ("",), ("NaN",), (None,)], "s string")
    assert [r[0] for r in df.select(semantics.plain_number(F.col("s"))).collect()] == [1.5, None, None, 100.0, 0.5, None, None, None]
    df = spark.createDataFrame([("2025-01-01T10:00:00",), ("2025-01-01 10:00:00.25",), ("2025-01-01T10:00:00-05:00",), ("2025-01-01",)], "s string")
    assert [str(r[0]) for r in df.select(semantics.iso_timestamp(F.col("s"))).collect()] == ["2025-01-01 10:00:00", "2025-01-01 10:00:00.250000", "None", "None"]
    df = spark.createDataFrame([(2.5,), (3.5,), (-0.5,), (None,), (1e12,)], "d double")
    assert [r[0] for r in df.select(semantics.half_even_int(F.col("d"))).collect()] == [2, 4, 0, None, None]
    sunday = spark.createDataFrame([("2025-01-05",), ("2025-01-11",)], "s string").select(semantics.day_of_week(F.to_date("s")))
    assert [r[0] for r in sunday.collect()] == [0, 6]


def test_statistics(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "x double")
    k, s = df.agg(semantics.sample_kurtosis(F.col("x")), semantics.sample_skewness(F.col("x"))).first()
    exact = pd.Series([1.0, 2, 3, 10])
    assert (k, s) == pytest.approx((exact.kurt(), exact.skew()))
    assert df.limit(2).agg(semantics.sample_skewness(F.col("x"))).first()[0] is None
    low, high = semantics.wilson(F.col("k"), F.col("n"))
    r = spark.createDataFrame([(5, 10), (0, 0)], "k int, n int").select(low, high).collect()
    assert [round(x, 4) for x in r[0]] == [0.2366, 0.7634] and list(r[1]) == [None, None]


def test_components_and_groups(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(45)] + [(7, 7), (None, 3), (900, None)] + [(500, 500 + i) for i in range(1, 30)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    want = {x: root(x) for x in list(parent)}
    assert dict(map(tuple, graphs.components(df).collect())) == want
    groups = dict(map(tuple, graphs.equivalence_groups(df.orderBy(F.rand(3))).collect()))
    top = {r: max(x for x in want if want[x] == r) for r in set(want.values())}
    order = {t: i for i, t in enumerate(sorted(top.values()), 1)}
    assert groups == {x: order[top[r]] for x, r in want.items()}
    assert graphs.components(df.limit(0)).count() == 0


def test_ancestors(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 3), (4, 2), (5, 5), (None, 1)], "child bigint, parent bigint")
    got = {(a, b): d for a, b, d in graphs.ancestors(df).collect()}
    assert got[1, 2] == 1 and got[1, 3] == 1 and got[1, 4] == 2 and got[2, 4] == 2 and (5, 5) not in got and (2, 2) not in got
    only = graphs.ancestors(df, spark.createDataFrame([(3,)], "node bigint"))
    assert {r.node for r in only.collect()} == {3}


def test_ancestors_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(35)] + [(35, 30)], "child bigint, parent bigint")
    got = {(a, b): d for a, b, d in graphs.ancestors(df, spark.createDataFrame([(0,), (3,)], "node bigint")).collect()}
    assert got == {(n, a): a - n for n in (0, 3) for a in range(n + 1, 36)}


def test_components_that_do_not_settle(spark):
    with pytest.raises(RuntimeError):
        graphs.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "src bigint, dst bigint"), rounds=1)


def test_version_differences(spark):
    cols = "link_id string, question_text string, display_order int"
    old = spark.createDataFrame([("a", "A", 1), ("b", "B", 2), ("c", "C", 3), ("d", "D", 4), ("d", "D2", 9)], cols)
    new = spark.createDataFrame([("a", "A", 1), ("b", "B!", 5), ("d", "D", 3), ("e", None, 4)], cols)
    assert rows_of(graphs.version_differences(old, new)) == [("b", "reworded"), ("c", "removed"), ("d", "reordered"), ("e", "added")]


def test_interval_join_and_bands(spark):
    rng = random.Random(2)
    day = lambda m: stamp("2024-01-01").replace(hour=m // 60 % 24, minute=m % 60, day=1 + m // 1440)
    pts = [(rng.choice("ab"), i, day(rng.randint(0, 5000))) for i in range(150)] + [("a", 999, None), (None, 998, day(5))]
    ivs = [(rng.choice("ab"), i, day(s), day(s + rng.randint(0, 600))) for i in range(30) for s in [rng.randint(0, 4000)]] + [("a", 77, day(9), None)]
    p = spark.createDataFrame(pts, "k string, p int, t timestamp_ntz")
    v = spark.createDataFrame(ivs, "k string, v int, s timestamp_ntz, e timestamp_ntz")
    want = sorted((a[1], b[1]) for a in pts for b in ivs if a[0] and a[0] == b[0] and a[2] and b[3] and b[2] <= a[2] <= b[3])
    got = ranges.interval_join(p, v, ["k"], "t", "s", "e", 3600 * 10**6)
    assert sorted((r.p, r.v) for r in got.collect()) == want
    bands = spark.createDataFrame([(1, None, 4.0, "low", 0), (1, 4.0, 9.0, "mid", 1), (1, 10.0, None, "high", 2)], "r int, low double, high double, label string, place int")
    rows = spark.createDataFrame([(1, -5.0), (1, 4.0), (1, 9.5), (1, 99.0), (2, 1.0), (1, None)], "r int, x double")
    assert [r.label for r in ranges.banded(rows, bands, ["r"], "x").orderBy("r", F.col("x").asc_nulls_last()).collect()] == ["low", "low", None, "high", None, None]


def test_scores(spark):
    f = spark.createDataFrame([(1, 1, 1, 10, 2.0), (1, 1, 1, 11, 1.0), (1, 1, 1, 11, 1.0), (2, 1, 1, 10, None), (3, 2, 1, 12, 3.0), (4, 2, 2, 10, 3.0)], "session_id int, respondent_id int, questionnaire_id int, question_id int, response_numeric double")
    rules = spark.createDataFrame([(1, "sum", 1, "sum"), (2, "mean", 1, "mean"), (3, "none", 1, "sum")], "rule_id int, name string, questionnaire_id int, formula string")
    items = spark.createDataFrame([(1, 10, 1.0, False), (1, 11, 2.0, True), (2, 10, 1.0, False), (2, 12, None, False)], "rule_id int, question_id int, weight double, reverse boolean")
    bands = spark.createDataFrame([(1, None, 5.0, "some", 0)], "rule_id int, low double, high double, label string, place int")
    top = spark.createDataFrame([(11, 3.0)], "question_id int, value double")
    got = {(r.rule_id, r.session_id): (r.score, r.items_answered, r.items_total, r.category) for r in scoring.scores(f, rules, items, bands, top).collect()}
    assert got == {(1, 1): (10.0, 3, 2, None), (2, 1): (2.0, 1, 2, None), (2, 3): (3.0, 1, 2, None)}


def test_upserts_and_first_wins(spark):
    old = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    new = spark.createDataFrame([(None, "B"), (2, "c")], "k int, v string")
    assert rows_of(upsert.replace_rows(old, new, ["k"])) == [(1, "a"), (2, "c"), (None, "B")]
    assert rows_of(upsert.add_rows(old, new, ["k"])) == [(1, "a"), (2, "c"), (None, "b")]
    a = spark.createDataFrame([(5, "x"), (6, "y"), (9, None)], "id int, name string")
    b = spark.createDataFrame([(1, "y"), (2, "z"), (3, None), (4, "z")], "id int, name string")
    kept, ids = upsert.first_wins([a, b], ["name"], "id")
    assert rows_of(kept.select("source", "id", "name", "new_id")) == sorted([(0, 5, "x", 1), (0, 6, "y", 2), (0, 9, None, 3), (1, 2, "z", 4)], key=str)
    assert rows_of(ids) == [(0, 5, 1), (0, 6, 2), (0, 9, 3), (1, 1, 2), (1, 2, 4), (1, 3, 3), (1, 4, 4)]


def site(spark, n, text="T"):
    return {
        "question": spark.createDataFrame([(n * 10, "q1", text)], "question_id int, link_id string, question_text string"),
        "respondent": spark.createDataFrame([(n, 1, f"P{n}"), (n + 50, 1, "shared")], "respondent_id int, study_id int, external_id string"),
        "response_session": spark.createDataFrame([(n, 1, n, "f1", "2024"), (n + 5, 1, n + 50, None, "2025"), (n + 6, 1, n, f"g{n}", "2024")], "session_id int, questionnaire_id int, respondent_id int, fhir_response_id string, started_at string"),
        "response": spark.createDataFrame([(n, n, n * 10, "v"), (n + 1, n + 6, n * 10, "w")], "response_id int, session_id int, question_id int, option_value string"),
    }


def test_site_merge(spark):
    got = site_merge.merge_sites([site(spark, 1), site(spark, 2)])
    assert got["question"].count() == 1 and got["respondent"].count() == 3
    assert got["response_session"].count() == 4 and rows_of(got["duplicate_sessions"]) == [(1, 2), (1, 7)]
    assert sorted(r.option_value for r in got["response"].collect()) == ["v", "w", "w"]
    again = site_merge.merge_sites([site(spark, 1), site(spark, 1)])
    assert again["response_session"].count() == 3 and again["response"].count() == 2
    with pytest.raises(ValueError):
        site_merge.merge_sites([site(spark, 1), site(spark, 2, "other")])


def test_merge_of_definitions(spark):
    def one(n):
        f = lambda schema, *rows: spark.createDataFrame(rows, schema)
        return {
            "question": f("question_id int, link_id string, question_text string", (n, "a", "A"), (n + 1, "b", "B")),
            "response_option": f("option_id int, question_id int, option_value string", (n * 10, n, "x"), (n * 10 + 1, n + 1, f"only{n}")),
            "questionnaire": f("questionnaire_id int, canonical_url string, version string", (n + 5, None, "1")),
            "questionnaire_question": f("qq_id int, questionnaire_id int, question_id int, parent_qq_id int", (n + 7, n + 5, n, None), (n + 8, n + 5, n + 1, n + 7)),
            "skip_rule": f("rule_id int, qq_id int, trigger_qq_id int", (1, n + 8, n + 7)),
            "scoring_rule": f("scoring_rule_id int, questionnaire_id int, name string", (n + 2, n + 5, "sum"), (n + 3, n + 5, f"own{n}")),
            "scoring_rule_item": f("item_id int, scoring_rule_id int, qq_id int, weight double", (1, n + 2, n + 7, 1.0), (2, n + 3, n + 8, 2.0)),
            "respondent": f("respondent_id int, study_id int, external_id string", (n, None, f"p{n}")),
            "response_session": f("session_id int, respondent_id int, questionnaire_id int, started_at string, fhir_response_id string", (n, n, n + 5, "t", None)),
            "response": f("response_id int, session_id int, qq_id int, option_id int", (1, n, n + 7, n * 10), (2, n, n + 8, n * 10 + 1)),
            "question_equivalence": f("question_id_1 int, question_id_2 int, relationship string", (n, n + 1, "equivalent")),
        }

    got = site_merge.merge_sites([one(1), one(20)])
    n = {k: v.count() for k, v in got.items()}
    assert (n["question"], n["response_option"], n["questionnaire"], n["questionnaire_question"], n["skip_rule"], n["scoring_rule"], n["scoring_rule_item"]) == (2, 3, 1, 2, 1, 3, 3)
    assert (n["respondent"], n["response_session"], n["response"], n["question_equivalence"], n["duplicate_sessions"]) == (2, 2, 4, 1, 0)
    options = {r.option_id: r.option_value for r in got["response_option"].collect()}
    links = {r.question_id: r.link_id for r in got["question"].collect()}
    placed = {r.qq_id: (links[r.question_id], r.parent_qq_id) for r in got["questionnaire_question"].collect()}
    (top,) = [k for k, v in placed.items() if v == ("a", None)]
    assert [v for v in placed.values() if v != ("a", None)] == [("b", top)]
    assert sorted((placed[r.qq_id][0], options[r.option_id]) for r in got["response"].collect()) == [("a", "x"), ("a", "x"), ("b", "only1"), ("b", "only20")]
    assert len({r.response_id for r in got["response"].collect()}) == 4


def test_erasure_and_copy(spark):
    s = site(spark, 1)
    left = site_merge.erase_respondent(s, 1)
    assert left["respondent"].count() == 1 and left["response_session"].count() == 1 and left["response"].count() == 0
    placed = spark.createDataFrame([(1, 7, 10)], "qq_id int, questionnaire_id int, question_id int")
    out = site_merge.copy_structure(s | {"questionnaire": spark.createDataFrame([(7,), (8,)], "questionnaire_id int"), "questionnaire_question": placed}, 7)
    assert out["questionnaire"].count() == 1 and out["question"].count() == 1 and "response" not in out


# --- disclosure ---------------------------------------------------------------------------------------------------


@pytest.fixture
def answers(spark):
    rows = [(i, i % 7, "a" if i % 10 else "b", float(i)) for i in range(40)]
    spark.createDataFrame(rows, "session_id int, respondent_id int, option_value string, x double").createOrReplaceTempView("answers")


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT respondent_id, COUNT(*) FROM answers GROUP BY 1", "SELECT COUNT(DISTINCT Session_ID) AS n FROM answers", "SELECT * FROM answers", "SELECT option_value FROM answers",
        "garbage", "INSERT INTO answers VALUES (1)", "DROP TABLE answers", "SELECT COUNT(*) OVER (PARTITION BY x) AS n FROM answers", "SELECT COUNT(*) FROM parquet.`/tmp/x`",
        "SELECT COUNT(*) AS n FROM answers UNION ALL SELECT x FROM answers", "SELECT reflect('java.lang.System', 'exit', 0), COUNT(*) FROM answers", "SELECT COUNT(*) FROM read_files('/x')",
        "WITH c AS (SELECT * FROM answers) SELECT x, option_value FROM c", "SELECT MAX(q) AS m, COUNT(*) AS n FROM (SELECT * FROM answers) t(q, b, c, d)",
        "SELECT concat(count(*), ' ', max(to_json(struct(*)))) AS x FROM answers", "SELECT option_value, COUNT(*) AS n, MAX(struct(x, option_value)) AS m FROM answers GROUP BY 1", "SELECT MAX_BY(option_value, x) AS m, COUNT(*) AS n FROM answers",
    ],
)
def test_gate_refuses(spark, answers, sql):
    with pytest.raises(ValueError):
        disclosure.check(spark, sql)


def test_gate_lets_aggregates_through(spark, answers):
    for sql in ("SELECT option_value, COUNT(*) AS n FROM answers GROUP BY 1;", "WITH c AS (SELECT option_value AS o FROM answers) SELECT o, COUNT(*) AS n, AVG(1) AS m FROM c GROUP BY o ORDER BY n LIMIT 5", "SELECT COUNT(*) AS n FROM answers a JOIN answers b USING (session_id)"):
        disclosure.check(spark, sql)


def test_suppression(spark, answers):
    r = disclosure.run_federated(spark, "SELECT option_value, COUNT(*) AS n, AVG(x) AS mean FROM answers GROUP BY option_value", 5)
    assert [x.option_value for x in r.rows.collect()] == ["a"] and r.suppressed == 1 and r.risk == "high" and r.count_columns == ["n"]
    assert json.loads(r.as_json())["disclosure_control"]["suppressed_rows"] == 1
    unnamed = disclosure.run_federated(spark, "SELECT option_value, COUNT(*) FROM answers GROUP BY option_value", 5)
    assert unnamed.rows.count() == 1
    visible = [disclosure.run_federated(spark, "SELECT option_value, COUNT(*) AS n FROM answers GROUP BY option_value", k).rows.count() for k in (1, 4, 5, 37)]
    assert visible == sorted(visible, reverse=True)
    hidden = disclosure.run_federated(spark, "SELECT x AS g, count(*) + 0.5 AS k, max(option_value) AS m FROM answers GROUP BY 1 -- from", 5)
    assert hidden.rows.count() == 0 and hidden.suppressed == 40
    both = disclosure.run_federated(spark, "WITH c AS (SELECT option_value AS o, x FROM answers) SELECT o, AVG(x) AS m FROM c GROUP BY o UNION ALL SELECT 'all', AVG(x) FROM c", 5)
    assert sorted(r.o for r in both.rows.collect()) == ["a", "all"]
    with pytest.raises(ValueError):
        disclosure.run_federated(spark, "SELECT DISTINCT option_value, COUNT(*) AS n FROM answers GROUP BY 1")
    assert [disclosure.names_count(n) for n in ("n", "N_x", "n_", "x_n", "total", "totals", "num_x", "freq")] == [True, True, False, True, True, False, True, True]
    null = spark.createDataFrame([("x", None), ("y", 2)], "o string, n int")
    assert rows_of(disclosure.suppress(null, ["n"], 5)) == [("x", None)]
    assert [disclosure.risk_of(n) for n in (0, 2, 3, 4, 5)] == ["high", "high", "medium", "medium", "low"]


# --- star schema and files ----------------------------------------------------------------------------------------


def oltp(spark, answers):
    d = spark.createDataFrame
    return {
        "study": d([(1, "S", None, None, None, "2024-01-01", "soon")], "study_id int, name string, description string, principal_investigator string, irb_number string, start_date string, end_date string"),
        "questionnaire": d([(1, None, "Q", "1.0", "u", None)], "questionnaire_id int, study_id int, name string, version string, canonical_url string, fhir_status string"),
        "concept": d([(9, "C", "d", "V", "c", "S", "9-1")], "concept_id int, concept_name string, domain_id string, vocabulary_id string, concept_class_id string, standard_concept string, concept_code string"),
        "question": d([(1, "q1", "t", "likert", 9), (2, "q2", "t", "boolean", None), (3, "q3", "t", "numeric", 8)], "question_id int, link_id string, question_text string, question_type string, concept_id int"),
        "response_option": d([(1, 1, "Never", "0", 0, None, 0, None, 9, "sys"), (2, 1, "Often", "2", 1, None, 1, 1, None, "sys")], "option_id int, question_id int, option_text string, option_value string, display_order int, option_set_id int, is_other int, is_exclusive int, concept_id int, concept_system string"),
        "respondent": d([(1, None, "e")], "respondent_id int, study_id int, external_id string"),
        "response_session": d([(1, 1, 1, "2024-05-05T10:00:00", "2024-05-05T10:00:02.5", 1, None, 0, None), (2, 1, 1, "tomorrow", None, 0, "web", 1, None), (3, 1, 99, None, None, 0, None, 0, None)], "session_id int, questionnaire_id int, respondent_id int, started_at string, completed_at string, is_complete int, admin_mode string, is_proxy int, interviewer_id string"),
        "questionnaire_question": d([(1, 1, 1), (2, 1, 2), (3, 1, 3)], "qq_id int, questionnaire_id int, question_id int"),
        "response": d(answers, "response_id bigint, session_id int, qq_id int, option_id int, grid_row_id int, grid_column_id int, repeat_index int, response_text string, response_numeric double, response_date string, question_id string"),
    }


def given(i, session, qq, option=None, text=None, number=None):
    return (i, session, qq, option, None, None, None, text, number, None, "clash")


def test_refresh(spark, tmp_path):
    path, first = str(tmp_path / "star"), [given(1, 1, 1, 2), given(2, 1, 2, text="true"), given(3, 1, 3, number=4.0), given(4, 3, 1, 1), given(5, 1, 99)]
    run = refresh.refresh(spark, path, oltp(spark, first))
    assert (run["status"], run["rows_loaded"], run["max_response_id"], run["max_session_id"]) == ("complete", 3, 3, 2)
    facts = {r.response_id: r for r in refresh.star_table(spark, path, "fact_response").collect()}
    assert facts[1].response_numeric == 2.0 and facts[2].response_boolean is True and facts[2].response_numeric is None and facts[1].question_concept_id == 9
    sessions = {r.session_id: r for r in refresh.star_table(spark, path, "dim_session").collect()}
    assert sessions[1].duration_sec == 2 and sessions[2].started_at is None and sorted(sessions) == [1, 2]
    again = refresh.refresh(spark, path, oltp(spark, [*first, given(6, 2, 1, 1)]))
    assert again["rows_loaded"] == 1 and refresh.star_table(spark, path, "fact_response").count() == 4
    broken = oltp(spark, first)
    broken["response"] = broken["response"].drop("qq_id")
    with pytest.raises(Exception):
        refresh.refresh(spark, path, broken)
    assert refresh.watermark(spark, path)["refresh_id"] == 2 and refresh.star_table(spark, path, "fact_response").count() == 4
    assert refresh.refresh(spark, path, oltp(spark, first), full=True)["rows_loaded"] == 3
    failures = star.cast_failures({"response_session": (broken["response_session"], "session_id", {"started_at": "timestamp"}), "study": (broken["study"], "study_id", {"start_date": "date", "end_date": "date"})})
    assert rows_of(failures) == [("response_session", "started_at", 2, "tomorrow"), ("study", "end_date", 1, "soon")]
    assert star.cast_failures({"study": (broken["study"], "study_id", {"end_date": "date"})}, failures).count() == 0


def test_refresh_derives_scores_and_mirrors(spark, tmp_path):
    d, path = spark.createDataFrame, str(tmp_path / "star")
    tables = oltp(spark, [given(1, 1, 1, 2), given(2, 1, 3, number=4.0)])
    tables["questionnaire"] = tables["questionnaire"].withColumn("concept_id", F.lit(77))
    tables |= {
        "scoring_rule": d([(5, "total", 1, "sum")], "scoring_rule_id int, name string, questionnaire_id int, formula string"),
        "scoring_rule_item": d([(1, 5, 1, 1.0, 1), (2, 5, 3, 2.0, 0)], "item_id int, scoring_rule_id int, qq_id int, weight double, reverse_score int"),
        "scoring_category": d([(1, 5, "low", None, 7.0, 1), (2, 5, "high", 8.0, None, 2)], "category_id int, scoring_rule_id int, label string, min_score double, max_score double, display_order int"),
        "question_lineage": d([(1, 2, 1, "reword", "2024-02-30"), (2, 3, 1, "split", "2024/3/1")], "lineage_id int, question_id int, parent_question_id int, change_type string, effective_date string"),
        "question_equivalence": d([(1, 2, "equivalent"), (2, 1, "equivalent"), (1, 3, "related")], "question_id_1 int, question_id_2 int, relationship string"),
        "person_map": d([(1, 500)], "respondent_id int, omop_person_id int"),
    }
    refresh.refresh(spark, path, tables)
    star_of = lambda name: refresh.star_table(spark, path, name)
    assert rows_of(star_of("agg_respondent_scores").select("rule_id", "session_id", "score", "items_answered", "category")) == [(5, 1, 8.0, 2, "high")]  # (2 - 2) + 2 * 4
    assert sorted(str(r.effective_date) for r in star_of("dim_question_lineage").collect()) == ["2024-03-01", "None"]
    assert rows_of(star_of("dim_question_equivalence").select("question_id_1", "question_id_2", "group_id")) == [(1, 2, 1), (1, 3, 1), (2, 1, 1)]
    assert [r.person_id for r in star_of("omop_observation").collect()] == [500, 500] and star_of("omop_survey_conduct").count() == 2
    assert rows_of(star_of("omop_unmapped_questions").select("question_id", "response_count")) == [(2, 0)]


def test_refresh_lists_unreadable_dates(spark, tmp_path):
    path, tables = str(tmp_path / "star"), oltp(spark, [given(1, 1, 1, 2)])
    late = F.when(F.col("session_id") == 1, "5 May, 10 am").otherwise(F.col("completed_at"))
    tables["response_session"] = tables["response_session"].withColumn("completed_at", late)
    tables["response"] = tables["response"].withColumn("response_date", F.lit("2024-13-01"))
    want = [("response", "response_date", 1, "2024-13-01"), ("response_session", "completed_at", 1, "5 May, 10 am"), ("response_session", "started_at", 2, "tomorrow"), ("study", "end_date", 1, "soon")]
    for full in (False, False, True):
        refresh.refresh(spark, path, tables, full=full)
        assert rows_of(refresh.star_table(spark, path, "cast_failures")) == want
    tables["study"] = tables["study"].withColumn("end_date", F.lit("later"))
    refresh.refresh(spark, path, tables)
    assert rows_of(refresh.star_table(spark, path, "cast_failures")) == sorted([*want, ("study", "end_date", 1, "later")], key=str)


def test_export(spark, tmp_path):
    tables = {"dim_study": spark.range(3).toDF("study_id"), "other": spark.range(2).toDF("x")}
    path = str(tmp_path / "out")
    assert refresh.export(tables, path, ["dim_study", "absent"]) == ({"dim_study": 3}, ["absent"])
    with pytest.raises(FileExistsError):
        refresh.export(tables, path)
    assert not (tmp_path / "out" / "other.parquet").exists()
    assert refresh.export(tables, path, overwrite=True)[0] == {"dim_study": 3, "other": 2}


def test_components_of_small_and_large_graphs(spark):
    import random

    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(120)] + [(None, 1), (5, 5)]
    e = spark.createDataFrame(edges, "src int, dst int")
    for label in ("min", "max"):
        assert rows_of(graphs.components(e, label)) == rows_of(graphs.components(e, label, small=-1))
    assert graphs.components(e.limit(0)).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "child int, parent int")
    assert graphs.ancestors(chain).count() == 820


def test_import_of_responses(spark, tmp_path):
    from cohortspark.operators.response_import import import_responses

    a = lambda **v: {"answer": [v]}
    r = lambda n, items, **more: {"rec_no": n, "resourceType": "QuestionnaireResponse", "questionnaire": "u|2", "id": f"r{n}", "authored": "2024-01-01", "subject": {"reference": "Patient/S::1"}, "item": items} | more
    deep = {"linkId": "x", "item": [{"linkId": "y", "item": [{"linkId": "z", "item": [{"linkId": "c"} | a(valueCoding={"code": "B-1"})]}]}]}
    rows = [
        r(1, [{"linkId": "c"} | a(valueCoding={"code": "b"}), {"linkId": "n"} | a(valueDecimal=99.0), {"linkId": "unknown"} | a(valueString="s"), {"linkId": "t"} | a(valueDecimal=1.0)]),
        r(2, [{"linkId": "g", "item": [{"linkId": "g.r0"} | a(valueCoding={"code": "1"}), {"linkId": "g.r7"} | a(valueCoding={"code": "1"}), {"linkId": "g.rx"} | a(valueCoding={"code": "1"})]}, deep], status="in-progress"),
        r(3, [], questionnaire="other"),
        r(4, None),
    ]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, rows)))
    read = study_files.read_responses(spark, str(tmp_path / "r.json"), lines=True).withColumn("rec_no", F.substring("id", 2, 9).cast("int"))
    with pytest.raises(ValueError):
        study_files.read_responses(spark, str(tmp_path / "r.json"), depth=3, lines=True)
    f = lambda schema, *rows: spark.createDataFrame(rows, schema)
    study = {
        "questionnaire": f("questionnaire_id int, canonical_url string", (1, "u")),
        "questionnaire_question": f("qq_id int, questionnaire_id int, question_id int", *((i + 10, 1, i) for i in range(1, 5))),
        "question": f("question_id int, link_id string, question_type string, numeric_min double, numeric_max double", (1, "c", "single_choice", None, None), (2, "n", "numeric", 0.0, 5.0), (3, "t", "text", None, None), (4, "g", "grid", None, None)),
        "response_option": f("option_id int, question_id int, option_value string, concept_code string", (7, 1, "b", "B-1"), (8, 1, "b", None)),
        "grid_row": f("row_id int, question_id int, display_order int", (70, 4, 0)),
        "grid_column": f("column_id int, question_id int, column_value string", (80, 4, "1")),
    }
    got = import_responses(read, study)
    assert rows_of(got.sessions.select("rec_no", "questionnaire_id", "completed_at", "is_complete")) == [(1, 1, "2024-01-01", 1), (2, 1, None, 0), (4, 1, "2024-01-01", 1)]
    assert rows_of(got.answers.select("rec_no", "qq_id", "option_id", "grid_row_id", "grid_column_id", "response_numeric")) == [(1, 11, 7, None, None, None), (1, 12, None, None, None, 99.0), (2, 11, 7, None, None, None), (2, 14, None, 70, 80, None)]
    assert rows_of(got.flags) == [(1, 12, "n", "range", "warning"), (1, 13, "t", "type", "error"), (2, 14, "g", "grid", "error"), (2, 14, "g", "grid", "error")]
    assert rows_of(got.rejected) == [(3,)]


def test_aggregates(spark):
    f = spark.createDataFrame([(1, 1, 1, 1, "a"), (1, 1, 1, 1, "b"), (1, 1, 1, 2, "a"), (2, 1, 1, 3, "a"), (1, 1, 1, 4, None)], "study_id int, questionnaire_id int, question_id int, session_id int, option_value string")
    f = f.withColumns({c: F.lit(None).cast("int") for c in ("option_id", "question_concept_id", "option_concept_id")})
    got = {(r.study_id, r.option_value): (r.n, r.pct) for r in star.question_distribution(f).collect()}
    assert got == {(1, "a"): (2, 66.67), (1, "b"): (1, 33.33), (2, "a"): (1, 33.33)}


def test_files(spark, tmp_path):
    good = {"resourceType": "QuestionnaireResponse", "status": "completed", "questionnaire": "u|1", "subject": {"reference": "Patient/S::1"}, "item": [{"linkId": "g", "item": [{"linkId": "q", "answer": [{"valueCoding": {"code": "c"}, "extension": [{"url": "x/ordinalValue", "valueDecimal": 2}]}, {}]}]}, {"linkId": "g", "item": [{"linkId": "q", "answer": [{"valueInteger": 3}]}]}, {"linkId": "n", "answer": [{"valueDecimal": 99}]}]}
    (tmp_path / "a.json").write_text(json.dumps([good, {"resourceType": "Patient"}]))
    (tmp_path / "b.json").write_text(json.dumps(good))
    df = study_files.read_responses(spark, str(tmp_path / "*.json"))
    assert df.count() == 2
    atoms = response_atoms.answer_atoms(df.limit(1).withColumn("rec_no", F.lit(1)))
    got = sorted((r.link_id, r.repeat_index, r.kind, r.code, r.number, r.rank, r.external_id, r.canonical) for r in atoms.collect())
    assert got == [("n", None, "decimal", None, 99.0, None, "S::1", "u"), ("q", 0, "coding", "c", None, 2.0, "S::1", "u"), ("q", 1, "integer", None, 3.0, None, "S::1", "u")]
    questions = spark.createDataFrame([(1, "q", "likert", None, None), (2, "n", "numeric", 0.0, 50.0)], "question_id int, link_id string, question_type string, numeric_min double, numeric_max double")
    assert sorted((r.link_id, r.repeat_index or 0, r.flag) for r in response_atoms.checked_atoms(atoms, questions).collect()) == [("n", 0, "range"), ("q", 0, None), ("q", 1, "type")]
    db = tmp_path / "x.db"
    with sqlite3.connect(db) as c:
        c.execute("create table t (a integer, b text)")
        c.executemany("insert into t values (?, ?)", [(i, None if i == 3 else str(i)) for i in range(7)])
    assert rows_of(study_files.read_sqlite(spark, str(db), "t", "a bigint, b string", rows=3)) == sorted([(i, None if i == 3 else str(i)) for i in range(7)], key=str)
    with pytest.raises(ValueError):
        study_files.read_sqlite(spark, str(db), "absent", "a bigint")


def test_sql_file_and_instrument(spark):
    out = study_files.run_sql_file(spark, "-- a; comment\nSELECT ';' AS x;\n\nSELECT 2 AS y -- end")
    assert [o.first()[0] for o in out] == [";", 2]
    text = "questionnaire:\n  name: N\n  version: 2\n  option_sets: {s: [{text: Yes, value: y}]}\n  sections:\n  - title: A\n    questions:\n    - {link_id: a, text: A, type: single_choice, $set: s}\n    - {link_id: g, text: G, type: repeating_group, items: [{link_id: h, text: H, type: numeric, range: [0, 5]}]}\n"
    rows = study_files.read_instrument(text)
    assert [q["link_id"] for q in rows["question"]] == ["a", "g", "h"] and rows["question"][2]["numeric_max"] == 5
    assert rows["response_option"][0]["option_value"] == "y" and rows["questionnaire_question"][2]["parent_qq_id"] == 2
    with pytest.raises(ValueError):
        study_files.read_instrument(text.replace("link_id: h", "link_id: a"))


def test_command_line(spark, tmp_path, capsys):
    from cohortspark.__main__ import main

    folder = tmp_path / "in"
    spark.createDataFrame([(i % 9, "a" if i else "b") for i in range(30)], "session_id int, option_value string").write.parquet(str(folder / "answers.parquet"))
    assert main(["list"]) == 0 and "p4_found" in capsys.readouterr().out
    sql = tmp_path / "q.sql"
    sql.write_text("SELECT option_value, COUNT(*) AS n FROM answers GROUP BY option_value")
    assert main(["federated", str(sql), str(folder)]) == 0
    assert json.loads(capsys.readouterr().out)["rows"] == [{"option_value": "a", "n": 29}]
    sql.write_text("SELECT session_id FROM answers")
    assert main(["federated", str(sql), str(folder)]) == 1
    assert main(["export", str(folder), str(tmp_path / "out")]) == 0 and (tmp_path / "out" / "answers.parquet").exists()


def test_shared_folder(spark):
    from cohortspark.operators import storage

    assert storage.new_path(spark, "x").startswith(storage.shared_dir(spark))
    df = spark.range(3)
    assert storage.stored(df, "x").count() == 3
