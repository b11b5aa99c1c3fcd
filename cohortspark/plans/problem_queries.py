"""The queries p1 to p5 over a study folder: problem operators applied to whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.text import bare_identifier, stripped
from cohortspark.operators import identifier_index, merkle, orphans, timezones, wide_table
from cohortspark.operators.storage import new_path, stored
from cohortspark.sources.tables import table


def _sites(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "study_site")
    return s.where("site_code is not null").groupBy(F.col("site_code").alias("site")).agg(F.min("time_zone").alias("time_zone"), F.min("date_order").alias("date_order"))


def _session_values(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "response_session")
    arrived = F.unix_micros(F.try_to_timestamp(F.col("created_at")))
    both = F.array(*(F.struct(F.lit(c).alias("fld"), F.col(c).alias("value")) for c in ("started_at", "completed_at")))
    return s.select(F.col("session_id").alias("row_key"), F.col("site_code").alias("site"), arrived.alias("arrived_us"), F.inline(both)).withColumn("src", F.lit("response_session"))


def _record_values(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "phq9_fhir_responses")
    site = stripped(F.regexp_extract("subject.reference", r"(?:^|/)([^/]*?)::", 1))
    return r.select(F.col("rec_no").alias("row_key"), site.alias("site"), F.lit(None).cast("bigint").alias("arrived_us"), F.lit("authored").alias("fld"), F.col("authored").alias("value"), F.lit("phq9_fhir_responses").alias("src"))


def _moments(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All values with their parts, and the zone chosen for each site."""
    sites = _sites(spark, folder)
    values = _session_values(spark, folder).unionByName(_record_values(spark, folder)).where("value is not null")
    parsed = stored(timezones.parse_values(values, sites), "parsed-moments")
    zones = stored(timezones.estimate_zones(parsed, sites, clean=True), "site-zones")
    return parsed, zones


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    parsed, zones = _moments(spark, folder)
    known = zones.join(_sites(spark, folder).select("site"), "site", "left_semi")
    return timezones.to_utc(parsed, known).where("utc_us is not null").select("src", "row_key", "fld", "utc_us").where("row_key is not null")


def p1_site_zones(spark: SparkSession, folder: str) -> DataFrame:
    """The zone estimated for each site, with the share of local values that violate it and the registry's zone."""
    return _moments(spark, folder)[1]


def _session_keys(spark: SparkSession, folder: str) -> DataFrame:
    """session_id with the two hashes of the response's identity; null hashes where it has none.

    Only started_at of sessions without identifier is read. Zones are estimated only where the registry lacks one,
    as the registry's usable zones stand anyway.
    """
    s = table(spark, folder, "response_session").select("session_id", "respondent_id", "questionnaire_id", "site_code", "started_at", "fhir_response_id", "created_at")
    sites = _sites(spark, folder)
    s = s.withColumn("bare", bare_identifier(F.col("fhir_response_id")))
    values = s.select("*", F.col("site_code").alias("site"), F.when(F.col("bare").isNull(), F.col("started_at")).alias("value"))
    clean = sites.where(F.col("time_zone").isNull() | ~F.col("time_zone").isin(*timezones.known_zones())).isEmpty()
    zones = sites if clean else _moments(spark, folder)[1]
    timed = timezones.to_utc(timezones.parse_values(values, sites), zones.join(sites.select("site"), "site", "left_semi"))
    respondent = F.col("respondent_id").cast("string")
    key = F.when(F.col("bare").isNotNull(), F.concat_ws("|", F.lit("id"), respondent, "bare")).otherwise(
        F.when(F.col("questionnaire_id").isNotNull() & F.col("utc_us").isNotNull(), F.concat_ws("|", F.lit("at"), respondent, "questionnaire_id", "utc_us"))
    )
    key = F.when(respondent.isNotNull(), key)
    keyed = timed.select("session_id", key.alias("key")).where("key is not null and session_id is not null")
    return keyed.select(F.col("session_id").alias("row_id"), *identifier_index.hashes(F.col("key")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    keyed = stored(_session_keys(spark, folder), "session-keys")
    found = identifier_index.surplus_deliveries(spark, keyed, new_path(spark, "session-index"))
    return found.select(F.col("kept_id").alias("session_id_1"), F.col("row_id").alias("session_id_2"))


def p2_kept_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """response_session with exactly one row of each response."""
    surplus = p2_found(spark, folder).select(F.col("session_id_2").alias("session_id"))
    return table(spark, folder, "response_session").join(surplus, "session_id", "left_anti")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    key = lambda c: F.upper(stripped(F.col(c)))
    whole = lambda name: table(spark, folder, name).distinct()
    parent = lambda name, k: table(spark, folder, name).select(k.alias("key"), "loaded_at", "deleted_at")
    child = lambda df, k, fk: df.select(k.cast("string").alias("child_key"), fk.alias("fk"), "loaded_at")
    concept_key = F.concat_ws("/", "concept_id_1", "concept_id_2", "relationship_id")
    cases = {
        "skip_rule": (child(whole("skip_rule"), F.col("rule_id"), F.col("trigger_qq_id")), parent("questionnaire_question", F.col("qq_id"))),
        "concept": (child(whole("concept"), F.col("concept_id"), key("vocabulary_id")), parent("vocabulary", key("vocabulary_id"))),
        "concept_relationship": (child(whole("concept_relationship"), concept_key, F.col("concept_id_2")), parent("concept", F.col("concept_id"))),
    }
    parts = [orphans.orphans(c, p).withColumn("tbl", F.lit(name)) for name, (c, p) in cases.items()]
    return reduce(DataFrame.unionByName, parts).select("tbl", "child_key", "kind", "period").distinct()


def p3_orphan_counts(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_counts(p3_found(spark, folder), ["tbl", "kind", "period"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    facts, questions = table(spark, folder, "fact_response"), table(spark, folder, "question")
    attributes = wide_table.discover(facts, questions)
    return wide_table.filled_cells(wide_table.wide_table(facts, questions, attributes), attributes)


def p4_wide(spark: SparkSession, folder: str) -> DataFrame:
    return wide_table.wide_table(table(spark, folder, "fact_response"), table(spark, folder, "question"))


def _flat(spark: SparkSession, folder: str) -> merkle.FlatTables:
    return merkle.shred(table(spark, folder, "gout_checkin_fhir_responses"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.answer_rows(_flat(spark, folder))


def p5_items(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct items: item_hash, link_id and the number of their answers and children."""
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).alias(f"n_{c}")
    return _flat(spark, folder).items.select("item_hash", "link_id", n("answers"), n("children"))


def p5_bridges(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(spark, folder).bridges()


QUERIES = {f.__name__: f for f in (p1_found, p1_site_zones, p2_found, p2_kept_sessions, p3_found, p3_orphan_counts, p4_found, p4_wide, p5_found, p5_items, p5_bridges)}
