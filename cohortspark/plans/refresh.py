"""Incremental refresh of a star schema kept as Parquet.

Every run writes its tables to folders of its own and takes effect by the one log entry that
names them; a run that fails leaves no trace but unused folders, and can be repeated. Sessions
and answers are appended by watermark, unreadable dates once each, everything else is written anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.semantics import plain_number
from cohortspark.operators import scoring, star

#: Texts of the transactional tables that the star schema reads as dates or moments: table, its id, columns.
DATES = {
    "response_session": ("session_id", {"started_at": "timestamp", "completed_at": "timestamp"}),
    "study": ("study_id", {"start_date": "date", "end_date": "date"}),
    "response": ("response_id", {"response_date": "date"}),
}
LOG = "refresh_id int, started_at string, completed_at string, max_response_id bigint, max_session_id bigint, rows_loaded bigint, status string, tables string"


def _log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).json(f"{path}/refresh_log")
    except Exception as e:  # no run yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LOG)


def watermark(spark: SparkSession, path: str) -> dict:
    """The last complete run's entry: refresh_id, highest ids and the folders of its tables; zeros before the first."""
    last = _log(spark, path).where("status = 'complete'").orderBy(F.desc("refresh_id")).limit(1).collect()
    if not last:
        return {"refresh_id": 0, "max_response_id": 0, "max_session_id": 0, "tables": {}}
    return last[0].asDict() | {"tables": json.loads(last[0]["tables"])}


def star_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the star schema as of the last complete run."""
    return spark.read.parquet(*watermark(spark, path)["tables"][name])


def refresh(spark: SparkSession, path: str, oltp: dict[str, DataFrame], extra: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] | None = None, full: bool = False) -> dict:
    """Brings the star schema under ``path`` up to date with the transactional tables; returns the run's log entry.

    Scores, lineage, equivalence and OMOP tables follow where ``oltp`` has scoring_rule, scoring_rule_item and
    scoring_category, question_lineage, question_equivalence, person_map. ``extra``: further tables, each made from the star tables so far. ``full`` reloads all sessions and answers.
    """
    last = watermark(spark, path)
    run, began = last["refresh_id"] + 1, datetime.now(timezone.utc).isoformat()
    after_r, after_s = (0, 0) if full else (last["max_response_id"], last["max_session_id"])
    at = f"{path}/run-{run:06d}-{uuid.uuid4().hex[:8]}"
    folders, done = {}, {}

    def put(name: str, df: DataFrame, append: bool = False) -> None:
        df.write.parquet(f"{at}/{name}")
        folders[name] = [*(last["tables"].get(name, []) if append and not full else []), f"{at}/{name}"]
        done[name] = spark.read.parquet(*folders[name])

    def entry(status: str, **more) -> dict:
        row = {"refresh_id": run, "started_at": began, "completed_at": datetime.now(timezone.utc).isoformat(), "max_response_id": 0, "max_session_id": 0, "rows_loaded": 0, "status": status, "tables": json.dumps(folders)} | more
        spark.createDataFrame([tuple(row[c.split()[0]] for c in LOG.split(", "))], LOG).coalesce(1).write.mode("append").json(f"{path}/refresh_log")
        return row

    try:
        put("dim_study", star.dim_study(oltp["study"]))
        put("dim_questionnaire", star.dim_questionnaire(oltp["questionnaire"]))
        put("dim_concept", star.dim_concept(oltp["concept"]))
        put("dim_question", star.dim_question(oltp["question"], oltp["concept"]))
        put("dim_response_option", star.dim_response_option(oltp["response_option"], oltp["concept"]))
        put("dim_respondent", star.dim_respondent(oltp["respondent"]))
        put("dim_session", star.dim_session(oltp["response_session"], oltp["respondent"], after_s), append=True)
        put("fact_response", star.fact_response(oltp["response"], oltp["response_session"], oltp["questionnaire_question"], oltp["question"], oltp["respondent"], oltp["response_option"], after_r), append=True)
        put("dim_date", star.dim_date(done["dim_session"].select(F.col("session_date_key").alias("date_key"))))
        put("agg_question_distribution", star.question_distribution(done["fact_response"]))
        put("agg_numeric_stats", star.numeric_statistics(done["fact_response"], oltp["question"]))
        put("agg_session_completion", star.session_completion(done["dim_session"]))
        for name, df in _derived(oltp, done).items():
            put(name, df)
        known = last["tables"].get("cast_failures") if not full else None
        put("cast_failures", star.cast_failures({t: (oltp[t], *of) for t, of in DATES.items()}, spark.read.parquet(*known) if known else None), append=True)
        for name, make in (extra or {}).items():
            put(name, make(done))
        new = spark.read.parquet(f"{at}/fact_response").count()
        top = lambda name, c: done[name].agg(F.max(c)).first()[0] or 0
        return entry("complete", max_response_id=max(after_r, top("fact_response", "response_id")), max_session_id=max(after_s, top("dim_session", "session_id")), rows_loaded=new)
    except Exception:
        entry("failed")
        raise


def _derived(oltp: dict[str, DataFrame], done: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Scores, lineage, equivalence and OMOP tables, each where the transactional tables it needs are given."""
    out: dict[str, DataFrame] = {}
    if {"scoring_rule", "scoring_rule_item", "scoring_category"} <= oltp.keys():
        rules = oltp["scoring_rule"].select(F.col("scoring_rule_id").alias("rule_id"), "name", "questionnaire_id", "formula")
        placed = oltp["questionnaire_question"].select("qq_id", "question_id")
        items = oltp["scoring_rule_item"].join(placed, "qq_id").select(F.col("scoring_rule_id").alias("rule_id"), "question_id", "weight", (F.coalesce("reverse_score", F.lit(0)) != 0).alias("reverse"))
        bands = oltp["scoring_category"].select(F.col("scoring_rule_id").alias("rule_id"), F.col("min_score").alias("low"), F.col("max_score").alias("high"), "label", F.col("display_order").alias("place"))
        out["agg_respondent_scores"] = scoring.scores(done["fact_response"], rules, items, bands, done["dim_response_option"].select("question_id", plain_number(F.col("option_value")).alias("value")))
    if "question_lineage" in oltp:
        out["dim_question_lineage"] = star.dim_question_lineage(oltp["question_lineage"])
    if "question_equivalence" in oltp:
        out["dim_question_equivalence"] = star.dim_question_equivalence(oltp["question_equivalence"])
    if "person_map" in oltp:
        persons = oltp["person_map"].select("respondent_id", F.col("omop_person_id").alias("person_id"))
        out["omop_survey_conduct"] = star.omop_survey_conduct(done["dim_session"], oltp["questionnaire"], persons)
        out["omop_observation"] = star.omop_observation(done["fact_response"], persons)
        out["omop_unmapped_questions"] = star.omop_unmapped(done["fact_response"], oltp["question"].join(oltp["questionnaire_question"].select("question_id").distinct(), "question_id", "left_semi"))
    return out


EXPORT_ORDER = ("dim_study", "dim_questionnaire", "dim_concept", "dim_question", "dim_response_option", "dim_respondent", "dim_session", "dim_date", "fact_response", "agg_question_distribution", "agg_numeric_stats", "agg_session_completion",
    "agg_respondent_scores", "dim_question_equivalence", "dim_question_lineage", "omop_survey_conduct", "omop_observation", "omop_unmapped_questions")


def export(tables: dict[str, DataFrame], path: str, names: list[str] | None = None, overwrite: bool = False) -> tuple[dict[str, int], list[str]]:
    """Writes tables as Parquet folders ``path/name.parquet``; returns row counts and the names there are no tables for.

    Nothing is written if any target exists and ``overwrite`` isn't set (FileExistsError).
    """
    wanted = names if names is not None else [n for n in (*EXPORT_ORDER, *tables) if n in tables]
    wanted = list(dict.fromkeys(wanted))
    known = [n for n in wanted if n in tables]
    if known and not overwrite:
        spark = tables[known[0]].sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for n in known:
            target = jvm.org.apache.hadoop.fs.Path(f"{path}/{n}.parquet")
            if target.getFileSystem(conf).exists(target):
                raise FileExistsError(str(target))
    counts = {}
    for n in known:
        tables[n].write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd").parquet(f"{path}/{n}.parquet")
        counts[n] = tables[n].sparkSession.read.parquet(f"{path}/{n}.parquet").count()
    return counts, [n for n in wanted if n not in tables]
