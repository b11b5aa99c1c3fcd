from __future__ import annotations

import random

import pytest
from conftest import rows_of, stamp
from pyspark.sql import functions as F

from cohortspark.functions.text import bare_identifier
from cohortspark.operators import identifier_index, merkle, orphans, skew
from cohortspark.operators.identifier_index import IdentifierIndex, hashes
from cohortspark.operators.storage import new_path
from cohortspark.plans import problem_queries as q
from test_timestamps import SITES


# --- 2: deliveries -------------------------------------------------------------------------------


def test_bare_identifier(spark):
    same = ["abc-1", " ABC-1 ", "{ABC-1}", "urn:uuid:abc-1", "QuestionnaireResponse/abc-1", "QuestionnaireResponse/abc-1/_history/2", "https://h.example/fhir/QuestionnaireResponse/Abc-1|3", "abc-1\t", '"abc-1"']
    df = spark.createDataFrame([(s,) for s in same], "s string")
    assert {r[0] for r in df.select(bare_identifier(F.col("s"))).collect()} == {"abc-1"}
    none = spark.createDataFrame([(None,), ("",), ("  ",), ("{}",)], "s string")
    assert {r[0] for r in none.select(bare_identifier(F.col("s"))).collect()} == {None}


def test_deliveries(spark, study):
    s = lambda i, who, f=None, at=None, qn=1: {"session_id": i, "respondent_id": who, "questionnaire_id": qn, "fhir_response_id": f, "started_at": at, "site_code": "BER"}
    rows = [
        s(1, 7, "A-1"), s(2, 7, "urn:uuid:a-1"), s(3, 8, "a-1"), s(9, 7, " {A-1} "),
        s(4, 7, None, "2023-01-05T10:00:00Z"), s(5, 7, " ", "2023-01-05 11:00:00"), s(6, 7, None, "2023-01-05T10:00:00Z", 2), s(7, 7, None, "soon"), s(8, 7, None, "soon"),
        s(10, None, "a-1"), s(11, None, "a-1"), s(12, 7, None, None), s(13, 7, "b-2", "2023-01-05T10:00:00Z"),
    ]
    folder = study(study_site=SITES, response_session=rows)
    assert rows_of(q.p2_found(spark, folder)) == [(1, 2), (1, 9), (4, 5)]
    assert q.p2_kept_sessions(spark, folder).count() == len(rows) - 3


def test_index_over_batches_and_merges(spark):
    rng = random.Random(3)
    keys = [rng.randint(0, 300) for _ in range(2000)]
    index, seen = IdentifierIndex(spark, new_path(spark, "t"), prefixes=4, fan_in=1), {}
    for b in range(4):
        batch = list(enumerate(keys))[b * 500 : (b + 1) * 500]
        df = spark.createDataFrame([(i, f"k{k}") for i, k in batch], "owner bigint, k string").select("owner", "k", *hashes(F.col("k")))
        found = {(r.h1, r.h2): r for r in index.absorb(df.select("h1", "h2", "owner")).collect()}
        by = {r.k: (r.h1, r.h2) for r in df.collect()}
        for k, h in by.items():
            mine = [i for i, x in batch if f"k{x}" == k]
            assert (found[h].owner, found[h].n, found[h].first_owner) == (min(mine), len(mine), seen.get(k))
        for i, x in batch:
            seen.setdefault(f"k{x}", i)
    assert len(index.runs) == 2
    index.merge()
    assert len(index.runs) == 1
    assert sum(len(r.h1) for r in index.entries().collect()) == len(seen)


def test_index_opened_again_and_batch_run_again(spark):
    at = new_path(spark, "t")
    batch = lambda *rows: spark.createDataFrame(rows, "owner bigint, k string").select("owner", *hashes(F.col("k")))
    first_owners = lambda df: {r.owner: r.first_owner for r in df.collect()}
    assert first_owners(IdentifierIndex(spark, at).absorb(batch((1, "a"), (2, "b")), 0)) == {1: None, 2: None}
    assert first_owners(IdentifierIndex(spark, at).absorb(batch((3, "a"), (4, "c")), 1)) == {3: 1, 4: None}
    assert first_owners(IdentifierIndex(spark, at).absorb(batch((3, "a"), (4, "c")), 1)) == {3: 1, 4: None}
    index = IdentifierIndex(spark, at, fan_in=1)
    assert first_owners(index.absorb(batch((5, "c"), (6, "b"), (7, "d")), 2)) == {5: 4, 6: 2, 7: None}
    assert [r["batch"] for r in index.runs] == [1, 2] and sum(r["n"] for r in index.runs) == 4
    assert len([n for n in index._folder.names() if n.startswith("run-")]) == 2


def test_index_gets_more_prefixes(spark, monkeypatch):
    monkeypatch.setattr(identifier_index, "ARRAY", 5)
    index = IdentifierIndex(spark, new_path(spark, "t"), prefixes=2, fan_in=1)
    rows = lambda n: spark.range(n * 100, n * 100 + 150).select(F.col("id").alias("owner"), *hashes(F.col("id").cast("string")))
    for n in range(4):
        found = index.absorb(rows(n))
        assert found.where("first_owner is not null").count() == (50 if n else 0)
    assert index.prefixes >= 64 and index.entries().agg(F.max(F.size("h1"))).first()[0] < 60


def test_one_identifier_holds_a_third(spark, study, monkeypatch):
    monkeypatch.setattr(skew, "HOT_FLOOR", 10)
    rows = [{"session_id": i, "respondent_id": 1, "questionnaire_id": 1, "fhir_response_id": "hot" if i % 3 == 0 else f"r{i}"} for i in range(1, 301)]
    got = rows_of(q.p2_found(spark, study(response_session=rows)))
    assert got == sorted(((3, i) for i in range(6, 301, 3)), key=str)


# --- 3: references --------------------------------------------------------------------------------


def test_references(spark, study):
    t = stamp
    folder = study(
        questionnaire_question=[
            {"qq_id": 1, "loaded_at": t("2023-01-01")},
            {"qq_id": 2, "loaded_at": t("2023-01-01"), "deleted_at": t("2023-02-01")},
            {"qq_id": 3, "loaded_at": t("2023-01-01"), "deleted_at": t("2023-02-01")},
            {"qq_id": 3, "loaded_at": t("2023-06-01"), "status": "deprecated"},
            {"qq_id": None},
        ],
        skip_rule=[{"rule_id": i, "trigger_qq_id": f, "loaded_at": t("2023-03-05")} for i, f in enumerate([1, 2, 3, 4, None])] + [{"rule_id": 3, "trigger_qq_id": 4, "loaded_at": t("2023-03-05")}],
        vocabulary=[{"vocabulary_id": "Ab", "loaded_at": t("2022-01-01")}],
        concept=[{"concept_id": 1, "vocabulary_id": " AB ", "loaded_at": t("2023-01-01")}, {"concept_id": 2, "vocabulary_id": "zz", "loaded_at": t("2023-04-01"), "deleted_at": t("2023-05-01")}],
        concept_relationship=[{"concept_id_1": 9, "concept_id_2": 2, "relationship_id": "Is a", "loaded_at": t("2023-07-01")}, {"concept_id_1": 9, "concept_id_2": 1, "relationship_id": "Is a", "loaded_at": t("2022-12-31")}],
    )
    assert rows_of(q.p3_found(spark, folder)) == sorted(
        [
            ("skip_rule", "1", "deleted", "2023-03"),
            ("skip_rule", "2", "late", "2023-03"),
            ("skip_rule", "3", "missing", "2023-03"),
            ("concept", "2", "missing", "2023-04"),
            ("concept_relationship", "9/2/Is a", "deleted", "2023-07"),
            ("concept_relationship", "9/1/Is a", "late", "2022-12"),
        ],
        key=str,
    )
    assert ("skip_rule", "missing", "2023-03", 1) in rows_of(q.p3_orphan_counts(spark, folder))


def test_hot_reference(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_FLOOR", 5)
    child = spark.createDataFrame([(str(i), 7 if i % 3 == 0 else i + 100, stamp("2023-01-01")) for i in range(90)], "child_key string, fk bigint, loaded_at timestamp_ntz")
    parent = spark.createDataFrame([(i + 100, stamp("2022-01-01"), None) for i in range(90)], "key bigint, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    got = orphans.orphans(child, parent).collect()
    assert sorted(int(r.child_key) for r in got) == list(range(0, 90, 3)) and {r.kind for r in got} == {"missing"}


# --- 4: wide tables ------------------------------------------------------------------------------------

QUESTIONS = [{"question_id": i, "link_id": f"q.{t}", "question_type": t} for i, t in enumerate(["numeric", "slider", "boolean", "date", "text", "likert", "multiple_choice"], 1)]


def answer(i, question, session=1, at="2023-01-01", **more):
    return {"response_id": i, "session_id": session, "question_id": question, "loaded_at": stamp(at)} | more


def test_wide_values(spark, study):
    import datetime as dt

    facts = [
        answer(1, 1, response_numeric=2.5), answer(2, 1, at="2023-01-02", response_text=" 71,25 kg "), answer(3, 1, at="2023-01-03", response_text="refused"),
        answer(4, 2, response_text="1.234,5"), answer(5, 2, session=2, response_numeric=float("nan")), answer(6, 2, session=3, response_text="7 mg/dL"),
        answer(7, 3, response_text=" Ja "), answer(8, 3, session=2, response_boolean=False, response_text="false"), answer(9, 3, session=3, response_text="n/a"),
        answer(10, 4, response_text="28.12.2022"), answer(11, 4, session=2, response_text="12 Jan 2023"), answer(12, 4, session=3, response_date=dt.date(2020, 2, 29)), answer(13, 4, session=4, response_text="31.02.2022"),
        answer(14, 5, response_text="  hello "), answer(15, 5, session=2, response_text="   "), answer(16, 5, session=3, response_text="n/a"),
        answer(17, 6, option_value=" Few_Days\t"), answer(18, 6, at="2023-01-01", option_value="daily"), answer(19, 6, session=2, repeat_index=0, option_value="never"),
        answer(26, 1, session=9, response_numeric=1e60), answer(27, 1, session=9, response_text="9" * 400), answer(20, 7, option_value="B "), answer(21, 7, option_value="a"), answer(22, 7, option_value="b"), answer(23, 99, option_value="x"), answer(24, None, option_value="x"), answer(25, 6, session=None, option_value="x"),
    ]
    folder = study(question=QUESTIONS, fact_response=facts + facts[:3])
    assert rows_of(q.p4_found(spark, folder)) == sorted(
        [
            (1, "q.numeric", "71.25"), (1, "q.slider", "1234.50"), (3, "q.slider", "7.00"), (1, "q.boolean", "true"), (2, "q.boolean", "false"),
            (1, "q.date", "2022-12-28"), (2, "q.date", "2023-01-12"), (3, "q.date", "2020-02-29"), (1, "q.text", "hello"), (3, "q.text", "n/a"),
            (1, "q.likert", "daily"), (2, "q.likert#0", "never"), (1, "q.multiple_choice", "a|b"),
        ],
        key=str,
    )
    wide = q.p4_wide(spark, folder)
    kinds = dict(wide.dtypes)
    assert (kinds["q.numeric"], kinds["q.boolean"], kinds["q.date"], kinds["q.likert"]) == ("double", "boolean", "date", "string")
    assert wide.count() == 4


# --- 5: nested records ---------------------------------------------------------------------------------


def a(**v):
    names = ["valueCoding", "valueBoolean", "valueDecimal", "valueInteger", "valueDate", "valueDateTime", "valueString", "extension"]
    return tuple(v.get(n) for n in names)


def nested(rng: random.Random, depth: int = 3):
    def answers():
        return rng.choice([None, [], [rng.choice([None, a(valueInteger=rng.randint(0, 2)), a(valueString="s"), a(valueDecimal=1.005), a(valueCoding=(None, rng.choice(["c", "", None]), "D")), a(extension=[("u", None)])]) for _ in range(rng.randint(1, 3))]])

    def items(d):
        if rng.random() < 0.2:
            return rng.choice([None, []])
        out = []
        for _ in range(rng.randint(1, 3)):
            if rng.random() < 0.1:
                out.append(None)
                continue
            link = rng.choice(["x", "y", None, ""])
            out.append((link, answers(), items(d - 1)) if d > 1 else (link, answers()))
        return out

    return items(depth)


def test_nested_records_against_a_walk(spark, study):
    rng = random.Random(5)
    records = [{"rec_no": i, "item": nested(rng)} for i in range(120)] + [{"rec_no": 500}, {"rec_no": 501, "item": []}]
    folder = study(gout_checkin_fhir_responses=records)
    expected = []

    def value(y):
        if y[0] is not None and (y[0][1] or y[0][2]) is not None:
            return "coding", y[0][1] or y[0][2]
        for i, k in ((1, "boolean"), (2, "decimal"), (3, "integer"), (6, "string")):
            if y[i] is not None:
                return k, {"decimal": "1.01", "boolean": str(y[i]).lower()}.get(k, str(y[i]))
        return None

    def walk(rec, items, path, up):
        for n, it in enumerate(items or []):
            if it is None:
                continue
            at = [*path, str(n)]
            for k, y in enumerate(it[1] or []):
                if y is not None and (v := value(y)):
                    expected.append((rec, ".".join(at), k, up, it[0] or "", *v))
            walk(rec, it[2] if len(it) > 2 else None, at, it[0] or "")

    for r in records:
        walk(r["rec_no"], r.get("item"), [], "")
    assert rows_of(q.p5_found(spark, folder)) == sorted(expected, key=str)


def test_nested_records_round_trip(spark, study):
    rng = random.Random(8)
    records = [{"rec_no": i, "item": nested(rng)} for i in range(80)] + [{"rec_no": 500}, {"rec_no": 501, "item": []}]
    folder = study(gout_checkin_fhir_responses=records)
    flat = merkle.shred(spark.read.parquet(f"{folder}/gout_checkin_fhir_responses.parquet"))
    items = {r.item_hash: r for r in flat.items.collect()}
    answers = {r.answer_hash: r.value for r in flat.answers.collect()}
    plain = lambda r: None if r is None else tuple(plain(x) if hasattr(x, "__fields__") else [plain(y) for y in x] if isinstance(x, list) else x for x in r)

    def build(h, depth):
        if h is None:
            return None
        r = items[h]
        held = None if r.answers is None else [None if x is None else plain(answers[x]) for x in r.answers]
        below = (None if r.children is None else [build(x, depth - 1) for x in r.children],) if depth > 1 else ()
        return (r.link_id, held, *below)

    rebuilt = {}
    n_items = {r.rec_no: r.n_items for r in flat.records.collect()}
    for r in flat.roots.orderBy("rec_no", "ordinal").collect():
        rebuilt.setdefault(r.rec_no, []).append(build(r.item_hash, 3))
    for rec in records:
        want = rec.get("item")
        assert (n_items[rec["rec_no"]] is None) == (want is None)
        assert rebuilt.get(rec["rec_no"], []) == (want or [])
    assert flat.items.count() == flat.items.select("item_hash").distinct().count()


def test_shared_subtree_is_stored_once(spark, study, monkeypatch):
    monkeypatch.setattr(skew, "HOT_FLOOR", 10)
    same = [("g", None, [("h", [a(valueString="v")], None)])]
    folder = study(gout_checkin_fhir_responses=[{"rec_no": i, "item": same} for i in range(60)])
    assert q.p5_found(spark, folder).count() == 60 and q.p5_items(spark, folder).count() == 2 and q.p5_bridges(spark, folder).count() == 2


# --- all of them ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_empty_tables(spark, study, name):
    assert q.QUERIES[name](spark, study()).count() == 0


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_extra_columns_and_null_rows(spark, study, name):
    extra = ", site string, key string, value string, fk bigint, _salt int, hash string, col string, h1 bigint, attribute string, tree string"
    folder = study(extra, **{t: [{}, {}] for t in ("response_session", "fact_response", "phq9_fhir_responses", "gout_checkin_fhir_responses", "concept", "concept_relationship", "questionnaire_question", "skip_rule", "question", "vocabulary", "study_site")})
    q.QUERIES[name](spark, folder).collect()
