from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

ANSWER = "struct<valueCoding:struct<system:string,code:string,display:string>,valueBoolean:boolean,valueDecimal:double,valueInteger:bigint,valueDate:string,valueDateTime:string,valueString:string,extension:array<struct<url:string,valueDecimal:double>>>"
ITEM = f"array<struct<linkId:string,answer:array<{ANSWER}>,item:array<struct<linkId:string,answer:array<{ANSWER}>,item:array<struct<linkId:string,answer:array<{ANSWER}>>>>>>>"
RESPONSES = f"rec_no bigint, resourceType string, id string, status string, questionnaire string, authored string, subject struct<reference:string>, item {ITEM}"
SCHEMAS = {
    "response_session": "session_id bigint, questionnaire_id bigint, respondent_id bigint, site_code string, started_at string, completed_at string, is_complete int, admin_mode string, is_proxy int, interviewer_id string, fhir_response_id string, consent_version string, created_at string, batch_id string",
    "fact_response": "response_id bigint, session_id bigint, respondent_id bigint, questionnaire_id int, study_id int, question_id bigint, qq_id bigint, option_id int, grid_row_id int, grid_column_id int, repeat_index int, response_text string, response_numeric double, response_date date, response_boolean boolean, option_value string, question_concept_id int, option_concept_id int, response_date_key date, session_start_key date, admin_mode string, is_proxy boolean, interviewer_id string, loaded_at timestamp_ntz",
    "phq9_fhir_responses": RESPONSES,
    "gout_checkin_fhir_responses": RESPONSES,
    "concept": "concept_id bigint, concept_name string, domain_id string, vocabulary_id string, concept_class_id string, standard_concept string, concept_code string, valid_start_date string, valid_end_date string, loaded_at timestamp_ntz, deleted_at timestamp_ntz",
    "concept_relationship": "concept_id_1 bigint, concept_id_2 bigint, relationship_id string, valid_start_date string, valid_end_date string, loaded_at timestamp_ntz",
    "questionnaire_question": "qq_id bigint, questionnaire_id bigint, question_id bigint, display_order int, is_required int, status string, loaded_at timestamp_ntz, deleted_at timestamp_ntz",
    "skip_rule": "rule_id bigint, qq_id bigint, enable_behavior string, trigger_qq_id bigint, operator string, trigger_value string, trigger_default_value string, action string, loaded_at timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, doc_kind string, study_id int, recorded_at timestamp_ntz",
    "eval_items": "item_id bigint, text string, test_set string, released_on string",
    "question": "question_id bigint, link_id string, question_text string, question_type string, numeric_min double, numeric_max double",
    "vocabulary": "vocabulary_id string, vocabulary_name string, vocabulary_reference string, version string, loaded_at timestamp_ntz, deleted_at timestamp_ntz",
    "study_site": "site_code string, site_name string, time_zone string, date_order string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def study(spark, tmp_path):
    """study(table=[{column: value}], ...) writes a folder with these tables, all others empty; extra: columns added to each."""

    def make(extra: str = "", **tables) -> str:
        folder = str(tmp_path / "study")
        for name, schema in SCHEMAS.items():
            schema = schema + extra
            empty = spark.createDataFrame([], schema)
            if name not in tables:
                Path(folder).mkdir(exist_ok=True)
                pq.write_table(to_arrow_schema(empty.schema).empty_table(), f"{folder}/{name}.parquet")
                continue
            columns = empty.columns
            rows = [tuple(r.get(c) for c in columns) for r in tables.get(name, [])]
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        return folder

    return make


def stamp(text: str) -> datetime:
    return datetime.fromisoformat(text)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)
