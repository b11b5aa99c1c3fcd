"""Guarded casts and statistics with one defined meaning on any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$"
_STAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?$"
_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def iso_date(c: Column) -> Column:
    """Date of a full year-month-day text, else null; year or year and month alone are no dates."""
    return F.when(c.rlike(_DATE), F.replace(c, F.lit("/"), F.lit("-")).try_cast("date"))


def iso_timestamp(c: Column) -> Column:
    """Timestamp without zone of an ISO text with seconds and no offset, else null."""
    return F.when(c.rlike(_STAMP), F.replace(c, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz"))


def plain_number(c: Column) -> Column:
    """Double of a decimal text, else null; no type suffixes, marks or blanks."""
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def half_even_int(c: Column) -> Column:
    """Integer nearest to a double, halves to the even one; null if it is too large."""
    return F.rint(c).try_cast("int")


def day_of_week(c: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(c) - 1


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from one timestamp without zone to another, as a double."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return (micros(end) - micros(start)) / 1e6


def sample_skewness(c: Column) -> Column:
    """Skewness with the correction for samples; null under three values."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: Column) -> Column:
    """Excess kurtosis with the correction for samples; null under four values."""
    n = F.count(c)
    return F.when(n > 3, ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval of k successes in n; null for n = 0."""
    p, nn = k / F.nullif(n, F.lit(0)), F.nullif(n, F.lit(0)).cast("double")
    middle = p + z * z / (2 * nn)
    half = z * F.sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn))
    return (middle - half) / (1 + z * z / nn), (middle + half) / (1 + z * z / nn)


def histogram(values: Column, counts: Column) -> Column:
    """Map of value to count, from one row a value; to be used after counting by value."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(values, counts))))
