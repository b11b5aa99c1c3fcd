"""References to records that do not exist: missing, deleted, or loaded only afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.skew import hot_keys, salted_join
from cohortspark.operators.storage import stored


def orphans(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Orphan references of ``child``: child_key, kind, period.

    ``child``: child_key, fk, loaded_at (exact duplicates already removed); ``parent``: key, loaded_at, deleted_at.
    The distinct non-null foreign keys (counted before the shuffle) are anti-joined with the parent keys for
    ``missing``; those whose parents all have a deleted_at are ``deleted``; those with some child loaded before
    the first undeleted parent are candidates for ``late``. Only these keys are joined back to the child rows,
    keys that many children share being spread over tasks. A child without loaded_at is never late and has a
    null period; null keys on either side match nothing.
    """
    parents = parent.where("key is not null").groupBy("key").agg(F.min(F.when(F.col("deleted_at").isNull(), F.coalesce("loaded_at", F.lit("0001-01-01").cast(parent.schema["loaded_at"].dataType)))).alias("live_from"))
    keys = stored(child.where("fk is not null").groupBy("fk").agg(F.count("*").alias("n"), F.min("loaded_at").alias("first_child")), "orphan-keys")
    missing = keys.join(parents, keys.fk == parents.key, "left_anti").select("fk", "n", F.lit("missing").alias("kind"), F.lit(None).cast(parent.schema["loaded_at"].dataType).alias("live_from"))
    other = (
        keys.join(parents, keys.fk == parents.key)
        .where("live_from is null or first_child < live_from")
        .select("fk", "n", F.when(F.col("live_from").isNull(), "deleted").otherwise("late").alias("kind"), "live_from")
    )
    bad = stored(missing.unionByName(other), "orphan-bad")
    total = keys.agg(F.sum("n")).first()[0] or 0
    rows = salted_join(child, bad.drop("n"), ["fk"], hot_keys(bad, ["fk"], "n", total), F.col("child_key"))
    return rows.where("kind <> 'late' or loaded_at < live_from").select("child_key", "kind", F.date_format("loaded_at", "yyyy-MM").alias("period"))


def orphan_counts(listed: DataFrame, by: list[str]) -> DataFrame:
    """Orphans counted per group (table, kind, period)."""
    return listed.groupBy(*by).agg(F.count("*").alias("n_orphans"))
