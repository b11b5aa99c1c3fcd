"""Mixed timestamp forms and zones, normalised to UTC.

Zones that texts leave out are estimated for each site: the local times are aligned with
the (clean) times of ingestion, and of the candidate offset histories the one with the
fewest violations is taken. A violation is a moment later than its ingestion, or earlier
by more than the lag that the site's colleagues show in values with an explicit zone.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.timestamps import abbreviations, known_zones, local_to_utc, with_parsed
from cohortspark.operators.skew import broadcast_if_small

#: Candidate zones beside those of the registry: one for each offset history of larger regions.
CANDIDATES = ("UTC", "Europe/London", "Europe/Berlin", "Europe/Helsinki", "America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "America/Halifax", "America/Phoenix", "America/Sao_Paulo", "Asia/Kolkata", "Asia/Shanghai", "Asia/Tokyo", "Australia/Sydney", "Pacific/Auckland")
#: The registry's zone gives way only to a history that leaves so much smaller a share of violations ...
MARGIN = 0.25
#: ... over at least so many local values.
EVIDENCE = 200


def parse_values(values: DataFrame, sites: DataFrame) -> DataFrame:
    """``values`` (site, value, ...) with ``parts`` (see functions.timestamps), using the sites' date order.

    ``sites``: site, time_zone, date_order, one row for each site.
    """
    return with_parsed(values.join(broadcast_if_small(sites.select("site", "date_order")), "site", "left"), "parts", F.col("value"), F.col("date_order")).drop("date_order")


def lag_limit(parsed: DataFrame) -> float | None:
    """Lag in seconds, behind the moment, within which 80 % of the values with an explicit zone were ingested."""
    explicit = parsed.where((F.col("parts.kind") == "instant") & F.col("arrived_us").isNotNull()).select(((F.col("arrived_us") - F.col("parts.us")) / 1e6).alias("lag")).where("lag >= 0")
    row = explicit.agg(F.percentile_approx("lag", 0.8, 1000).alias("limit")).first()
    return row["limit"]


def estimate_zones(parsed: DataFrame, sites: DataFrame, candidates: Iterable[str] = CANDIDATES, clean: bool = False) -> DataFrame:
    """One row for each site with local values or a registry entry: site, time_zone (chosen), declared, n_local, declared_share, best_zone, best_share.

    ``parsed``: the result of :func:`parse_values` with ``arrived_us``, the UTC microseconds of ingestion.
    Each candidate is scored over all local values in one pass with partial aggregation; the lag limit
    is taken over all explicit values. Of candidates with equally few violations the registry's wins,
    then the first by name. Without a usable registry zone the best candidate is taken if there is any
    evidence. A ``clean`` registry's usable zones stand whatever the values. Null sites are left out; an empty table gives the registry's zones.
    """
    known = set(known_zones())
    declared = sites.where(F.col("site").isNotNull()).select("site", F.when(F.col("time_zone").isin(*known), F.col("time_zone")).alias("declared"))
    zones = sorted({*candidates, *(r[0] for r in declared.select("declared").where("declared is not null").distinct().limit(len(known)).collect())})
    limit = lag_limit(parsed)
    local = parsed.where((F.col("parts.kind") == "local") & F.col("site").isNotNull() & F.col("arrived_us").isNotNull())
    wrong = []
    for i, z in enumerate(zones):
        lag = (F.col("arrived_us") - F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("parts.us"), z))) / 1e6
        wrong.append(F.avg(F.when((lag < 0) | (lag > F.lit(limit)), 1.0).otherwise(0.0)).alias(f"v{i}"))
    scores = local.groupBy("site").agg(F.count("*").alias("n_local"), *wrong)
    share = F.map_from_arrays(F.array(*map(F.lit, zones)), F.array(*(F.col(f"v{i}") for i in range(len(zones)))))
    best = F.array_min(F.array(*(F.struct(F.col(f"v{i}").alias("share"), F.lit(z).alias("zone")) for i, z in enumerate(zones))))
    scored = declared.join(scores, "site", "full").withColumn("best", F.when(F.col("n_local") > 0, best)).withColumn("declared_share", F.try_element_at(share, F.col("declared")))
    replaced = F.lit(not clean) & (F.col("n_local") >= EVIDENCE) & (F.col("declared_share") - F.col("best.share") > MARGIN)
    return scored.select(
        "site",
        F.when(F.col("declared").isNull() | F.coalesce(replaced, F.lit(False)), F.col("best.zone")).otherwise(F.col("declared")).alias("time_zone"),
        "declared",
        F.coalesce("n_local", F.lit(0)).alias("n_local"),
        "declared_share",
        F.col("best.zone").alias("best_zone"),
        F.col("best.share").alias("best_share"),
    )


def to_utc(parsed: DataFrame, zones: DataFrame) -> DataFrame:
    """``parsed`` with ``utc_us``, null where the value denotes no single moment.

    ``zones``: site, time_zone. Local values and zone abbreviations take the site's zone; a zone named in
    the text is used as it stands; unknown names and abbreviations that the site's zone doesn't use give null.
    """
    spark = parsed.sparkSession
    used = [r[0] for r in zones.select("time_zone").where("time_zone is not null").distinct().limit(len(known_zones())).collect()]
    short = [(z, a.lower(), m) for z in used for a, m in abbreviations(z).items()]
    names = F.broadcast(spark.createDataFrame(short, "time_zone string, __tz_abbr string, __tz_minutes int"))
    full = F.broadcast(spark.createDataFrame([(z.lower(), z) for z in known_zones()], "__tz_abbr string, __tz_zone string"))
    zone = F.col("parts.zone")
    df = parsed.withColumn("__tz_abbr", F.when(F.col("parts.kind") == "zoned", zone)).join(broadcast_if_small(zones.select("site", "time_zone")), "site", "left")
    df = df.join(names, ["time_zone", "__tz_abbr"], "left").join(full, "__tz_abbr", "left")
    us = F.col("parts.us")
    return df.withColumn(
        "utc_us",
        F.when(F.col("parts.kind") == "instant", us)
        .when(F.col("parts.kind") == "local", local_to_utc(us, F.col("time_zone")))
        .when(F.col("__tz_minutes").isNotNull(), us - F.col("__tz_minutes").cast("bigint") * 60_000_000)
        .when(F.col("__tz_zone").contains("/"), local_to_utc(us, F.col("__tz_zone"))),
    ).drop("__tz_abbr", "__tz_minutes", "__tz_zone", "time_zone")
