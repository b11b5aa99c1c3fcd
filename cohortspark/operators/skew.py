"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of all rows, so there are at most 1/HOT_SHARE hot keys.
HOT_SHARE = 0.001
#: Below this many rows no key is treated as hot.
HOT_FLOOR = 50_000
SALTS = 32


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to have at most ``max_rows`` rows, else unchanged."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def hot_keys(counts: DataFrame, keys: list[str], n: str, total: int, share: float = HOT_SHARE, floor: int | None = None) -> DataFrame:
    """Keys of ``counts`` holding more than ``share`` of ``total`` rows: fewer than 1/share, whatever the data.

    They are found at once, so that a plan using them in several places doesn't count again.
    """
    least = max(HOT_FLOOR if floor is None else floor, int(total * share))
    kept = counts.where(F.col(n) > least).select(*keys)
    found = kept.limit(int(1 / share) + 1).collect() if total > least else []
    return counts.sparkSession.createDataFrame(found, kept.schema) if found else kept.where(F.lit(False))


def salted_join(rows: DataFrame, unique: DataFrame, keys: list[str], hot: DataFrame, spread: Column, salts: int = SALTS) -> DataFrame:
    """Inner join of ``rows`` with ``unique`` (one row for each key), hot keys spread over ``salts`` partitions.

    ``hot`` holds the hot keys (see :func:`hot_keys`, hence safe to broadcast), ``spread`` is an
    expression over ``rows`` that differs between rows of one key. Rows with a null key don't match.
    """
    marked = F.broadcast(hot.withColumn("__skew_hot", F.lit(True)))
    left = rows.join(marked, keys, "left").withColumn("__skew_salt", F.when(F.col("__skew_hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("__skew_hot")
    right = unique.join(marked, keys, "left").withColumn("__skew_salt", F.explode(F.when(F.col("__skew_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__skew_hot")
    return left.join(right, [*keys, "__skew_salt"]).drop("__skew_salt")


def spread_join(rows: DataFrame, unique: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """:func:`salted_join` that finds the hot keys of ``rows`` itself; ``rows`` is read twice, so pass a stored table.

    Where no key is hot the salts vanish from the plan but for a constant.
    """
    total = rows.count()
    if total <= HOT_FLOOR:
        return rows.join(unique, keys)
    return salted_join(rows, unique, keys, hot_keys(rows.groupBy(*keys).agg(F.count("*").alias("__skew_n")), keys, "__skew_n", total), spread)
