"""Joins on ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, width_us: int) -> DataFrame:
    """Points with every interval of the same keys that holds them (start <= at <= end).

    Both sides are cut into buckets of ``width_us`` microseconds, an interval being copied to each bucket it touches, so
    it is an equi-join on keys and bucket with a residual check, not a nested loop. Null times match nothing. ``width_us``
    should be about the length of the intervals.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / width_us).cast("bigint")
    p = points.where(F.col(at).isNotNull()).withColumn("_bucket", bucket(at))
    i = intervals.where(F.col(start) <= F.col(end)).withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    return p.join(i, [*keys, "_bucket"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_bucket")


def banded(rows: DataFrame, bands: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with the label of the first band (low, high, label, place) that holds ``value``; open ends are null, none gives null.

    ``bands`` are few for each key: they are gathered in one array a key, which is joined and searched in order.
    """
    held = bands.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "low", "high", "label"))).alias("_bands"))
    v = F.col(value)
    fits = F.filter("_bands", lambda b: (b["low"].isNull() | (v >= b["low"])) & (b["high"].isNull() | (v <= b["high"])))
    return rows.join(F.broadcast(held) if held.limit(10_001).count() <= 10_000 else held, keys, "left").withColumn("label", F.try_element_at(fits, F.lit(1))["label"]).drop("_bands")
