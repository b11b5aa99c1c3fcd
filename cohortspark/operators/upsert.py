"""Writes by key without primary keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(old: DataFrame, new: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (old[k].eqNullSafe(new[k]) for k in keys))


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key; null keys are equal. Of rows of ``new`` with one key any stays."""
    new = new.dropDuplicates(keys)
    return old.join(new, _same(old, new, keys), "left_anti").unionByName(new, allowMissingColumns=True)


def add_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` whose key it lacks; null keys are equal."""
    new = new.dropDuplicates(keys)
    return old.unionByName(new.join(old, _same(new, old, keys), "left_anti"), allowMissingColumns=True)


def first_wins(sources: list[DataFrame], natural: list[str], old_id: str) -> tuple[DataFrame, DataFrame]:
    """Merges tables by natural key, the earlier source winning.

    Returns the survivors, with ``new_id`` (ascending by source and old id), and the map source, old_id, new_id of
    every input row. Null parts of a key are equal. Repeats within a source collapse too. The survivor of each key
    is found by partial aggregation, so a key that many rows share is combined before the shuffle; new ids come
    from a range sort and partition offsets, not from one task.
    """
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (s.withColumn("source", F.lit(i)) for i, s in enumerate(sources)))
    marks = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in natural]
    united = united.withColumn("_key", F.sha2(F.to_json(F.array(*marks)), 256))
    least = united.groupBy("_key").agg(F.min(F.struct("source", F.col(old_id).alias("id"))).alias("first"))
    ids = numbered(least.select("_key", "first.source", "first.id"), ["source", "id"], "new_id")
    survivors = united.join(ids.select("_key", F.col("source").alias("_s"), F.col("id").alias("_i"), "new_id"), "_key").where((F.col("source") == F.col("_s")) & (F.col(old_id) == F.col("_i"))).drop("_key", "_s", "_i").dropDuplicates(["source", old_id])
    mapping = united.select("source", F.col(old_id).alias("old_id"), "_key").join(ids.select("_key", "new_id"), "_key").select("source", "old_id", "new_id").distinct()
    return survivors, mapping


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with 1, 2, ... in ``order``, numbered in all partitions at once."""
    from cohortspark.operators.storage import stored

    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranked = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), within.alias("_within")), "numbered")
    sizes = sorted((r["_part"], r["n"]) for r in ranked.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    starts = df.sparkSession.createDataFrame(offsets, "_part int, _start bigint")
    return ranked.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_within") + 1).drop("_part", "_within", "_start")
