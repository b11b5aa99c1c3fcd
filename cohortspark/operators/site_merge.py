"""Studies of several sites merged into one, without duplicates."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.skew import broadcast_if_small
from cohortspark.operators.upsert import first_wins, numbered


@dataclass(frozen=True)
class Step:
    """How one table is merged. id: its own id, numbered anew; keys: its natural key, without one all rows are kept;
    refs: columns that hold another table's id; within: the reference whose row must have survived from the same
    site, else the row is left out; later: references to its own rows, set when all have their new ids; drop: columns made null."""

    table: str
    id: str | None
    keys: tuple[str, ...] = ()
    refs: dict[str, str] = field(default_factory=dict)
    within: str | None = None
    later: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()


_Q, _C = "question", "concept"
# Tables in the order in which they refer to each other, with their natural keys.
STEPS = (
    Step("vocabulary", None, ("vocabulary_id",)),
    Step("concept", "concept_id", ("vocabulary_id", "concept_code")),
    Step("concept_relationship", None, ("concept_id_1", "concept_id_2", "relationship_id"), {"concept_id_1": _C, "concept_id_2": _C}),
    Step("study", "study_id", ("name",)),
    Step("response_option_set", "option_set_id", ("name",)),
    Step("question", "question_id", ("link_id",), {"concept_id": _C}),
    Step("response_option", "option_id", ("question_id", "option_value"), {"question_id": _Q, "concept_id": _C, "option_set_id": "response_option_set"}),
    Step("grid_row", "row_id", ("question_id", "display_order"), {"question_id": _Q, "concept_id": _C}),
    Step("grid_column", "column_id", ("question_id", "display_order"), {"question_id": _Q, "concept_id": _C}),
    Step("questionnaire", "questionnaire_id", ("canonical_url", "version"), {"study_id": "study"}),
    Step("section", "section_id", ("questionnaire_id", "display_order"), {"questionnaire_id": "questionnaire"}),
    Step("questionnaire_question", "qq_id", ("questionnaire_id", "question_id"), {"questionnaire_id": "questionnaire", "question_id": _Q, "section_id": "section"}, later=("parent_qq_id", "count_qq_id")),
    Step("skip_rule", "rule_id", (), {"qq_id": "questionnaire_question", "trigger_qq_id": "questionnaire_question"}, within="qq_id"),
    Step("scoring_rule", "scoring_rule_id", ("questionnaire_id", "name"), {"questionnaire_id": "questionnaire"}),
    Step("scoring_rule_item", "item_id", (), {"scoring_rule_id": "scoring_rule", "qq_id": "questionnaire_question"}, within="scoring_rule_id"),
    Step("scoring_category", "category_id", (), {"scoring_rule_id": "scoring_rule"}, within="scoring_rule_id"),
    Step("respondent", "respondent_id", ("study_id", "external_id"), {"study_id": "study"}),
    Step("response_session", "session_id", ("_natural",), {"respondent_id": "respondent", "questionnaire_id": "questionnaire"}),
    Step("response", "response_id", (), {"session_id": "response_session", "qq_id": "questionnaire_question", "question_id": _Q, "option_id": "response_option", "grid_row_id": "grid_row", "grid_column_id": "grid_column"}, within="session_id"),
    Step("admin_event", "event_id", (), {"study_id": "study", "questionnaire_id": "questionnaire", "respondent_id": "respondent", "session_id": "response_session"}, within="session_id"),
    Step("data_quality_flag", "flag_id", (), {"session_id": "response_session", "qq_id": "questionnaire_question"}, within="session_id", drop=("response_id",)),
    Step("study_errata_log", "errata_id", (), {"study_id": "study", "questionnaire_id": "questionnaire", "question_id": _Q, "affects_session_from": "response_session", "affects_session_to": "response_session"}),
    Step("question_lineage", "lineage_id", ("question_id", "parent_question_id", "change_type"), {"question_id": _Q, "parent_question_id": _Q}),
    Step("question_equivalence", "equivalence_id", ("question_id_1", "question_id_2", "relationship"), {"question_id_1": _Q, "question_id_2": _Q}),
    Step("questionnaire_version_diff", "diff_id", ("from_questionnaire_id", "to_questionnaire_id", "change_type", "qq_id_from", "qq_id_to"), {"from_questionnaire_id": "questionnaire", "to_questionnaire_id": "questionnaire", "qq_id_from": "questionnaire_question", "qq_id_to": "questionnaire_question"}),
    Step("person_map", None, ("respondent_id",), {"respondent_id": "respondent"}),
)


def merge_sites(sites: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables of STEPS that the sites have, merged with new ids; in case of doubt the earlier site wins.

    A question's text must not differ between sites (ValueError, before anything is written). A session is known by its
    fhir_response_id or, without one, by respondent, questionnaire and started_at. Null parts of a key are equal;
    repeats within a site collapse too. Answers, events and flags of sessions that another site already holds are left
    out (those without a session stay), so are rules of placements that it holds; references to rows that no site has
    become null. The result also has ``duplicate_sessions`` (source, old_id). A table that some site lacks is empty there.
    """
    texts = reduce(DataFrame.unionByName, (s["question"].select("link_id", "question_text") for s in sites if "question" in s))
    clash = texts.groupBy("link_id").agg(F.countDistinct(F.coalesce("question_text", F.lit("\x00"))).alias("n")).where("n > 1").limit(5).collect()
    if clash:
        raise ValueError("questions differ between sites: " + ", ".join(str(r["link_id"]) for r in clash))
    maps: dict[str, DataFrame] = {}
    kept: dict[str, DataFrame] = {}
    out: dict[str, DataFrame] = {}
    for step in STEPS:
        some = next((s[step.table] for s in sites if step.table in s), None)
        if some is None:
            continue
        frames = [_remapped(s[step.table] if step.table in s else some.limit(0), n, step, maps, kept) for n, s in enumerate(sites)]
        if step.table == "response_session":
            frames = [_with_natural(f) for f in frames]
        out[step.table] = _merged(frames, step, maps, kept)
    if "response_session" in maps:
        first = kept["response_session"].select("source", "old_id")
        out["duplicate_sessions"] = maps["response_session"].join(first, ["source", "old_id"], "left_anti").select("source", "old_id")
    return out


def _new_ids(mapping: DataFrame, source: int, column: str) -> DataFrame:
    return broadcast_if_small(mapping.where(F.col("source") == source).select(F.col("old_id").alias(column), F.col("new_id").alias("_new")))


def _remapped(df: DataFrame, source: int, step: Step, maps: dict[str, DataFrame], kept: dict[str, DataFrame]) -> DataFrame:
    """A site's table with its references moved to the new ids, without rows whose parent came from another site."""
    if step.within in df.columns and step.refs[step.within] in kept:
        mine = _new_ids(kept[step.refs[step.within]], source, step.within).drop("_new")
        df = df.join(mine, step.within, "left_semi").unionByName(df.where(F.col(step.within).isNull()))
    for column, table in step.refs.items():
        if column in df.columns and table in maps:
            df = df.join(_new_ids(maps[table], source, column), column, "left").withColumn(column, F.col("_new")).drop("_new")
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in step.drop if c in df.columns})


def _with_natural(sessions: DataFrame) -> DataFrame:
    fallback = F.to_json(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("respondent_id", "questionnaire_id", "started_at") if c in sessions.columns)))
    given = F.col("fhir_response_id")
    return sessions.withColumn("_natural", F.when(F.length(given) > 0, F.concat(F.lit("id:"), given)).otherwise(F.concat(F.lit("at:"), fallback)))


def _merged(frames: list[DataFrame], step: Step, maps: dict[str, DataFrame], kept: dict[str, DataFrame]) -> DataFrame:
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (f.withColumn("source", F.lit(n)) for n, f in enumerate(frames)))
    keys = [k for k in step.keys if k in united.columns]
    if step.id not in united.columns:
        return (united.groupBy(*keys).agg(F.min_by(F.struct(*united.columns), "source").alias("r")).select("r.*") if keys else united).drop("source")
    if keys:
        survivors, maps[step.table] = first_wins(frames, keys, step.id)
    else:
        survivors = numbered(united, ["source", step.id], "new_id")
        maps[step.table] = survivors.select("source", F.col(step.id).alias("old_id"), "new_id")
    kept[step.table] = survivors.select("source", F.col(step.id).alias("old_id"), "new_id")
    for column in step.later:
        if column in survivors.columns:
            moved = maps[step.table].select("source", F.col("old_id").alias(column), F.col("new_id").alias("_new"))
            survivors = survivors.join(moved, ["source", column], "left").withColumn(column, F.col("_new")).drop("_new")
    return survivors.withColumn(step.id, F.col("new_id")).drop("new_id", "source", "_natural")


def copy_structure(tables: dict[str, DataFrame], questionnaire_id: int) -> dict[str, DataFrame]:
    """The questionnaire with its placements, questions and options, ids kept; answers are never copied."""
    placements = tables["questionnaire_question"].where(F.col("questionnaire_id") == questionnaire_id)
    mine = placements.select("question_id").distinct()
    out = {"questionnaire": tables["questionnaire"].where(F.col("questionnaire_id") == questionnaire_id), "questionnaire_question": placements}
    return out | {n: tables[n].join(mine, "question_id", "left_semi") for n in ("question", "response_option") if n in tables}


def erase_respondent(tables: dict[str, DataFrame], respondent_id: int) -> dict[str, DataFrame]:
    """All tables without the respondent: their sessions, the answers and flags of these, and rows that name the respondent."""
    gone = tables["response_session"].where(F.col("respondent_id") == respondent_id).select("session_id").distinct()
    out = {}
    for name, df in tables.items():
        if "respondent_id" in df.columns:
            df = df.where(~F.col("respondent_id").eqNullSafe(F.lit(respondent_id)))
        if "session_id" in df.columns:
            df = df.join(gone, "session_id", "left_anti")
        out[name] = df
    return out
