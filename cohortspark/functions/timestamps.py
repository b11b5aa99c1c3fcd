"""Written moments: parsing into parts, and conversion to one UTC instant.

A value is read once into ``struct<kind, us, zone>``:

* ``instant``: ``us`` is the UTC moment (an offset, ``Z`` or an epoch number stood in the text);
* ``zoned``: ``us`` is local time, ``zone`` the zone or zone abbreviation in the text;
* ``local``: ``us`` is local time of the record's site;
* null: the text denotes no moment (no time of day, impossible date or time, other text).

Digits beyond microseconds are dropped, omitted seconds are zero.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = "struct<kind:string,us:bigint,zone:string>"

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_HALF = r"(?: ?([ap])\.?m\b\.?)?"
_ZONE = r" ?(z|[+-]\d{1,2}(?::?\d{2})?|utc[+-]\d{1,2}(?::?\d{2})?|[a-z]+(?:[/_][a-z0-9_+/-]+)?)?(?: ?\[([a-z0-9_+/-]+)\])?"
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
#: Form of the text (already in lower case with single blanks) and the group of each part:
#: year, month, day, hour, minute, second, fraction, half of the day, zone, zone in brackets.
_FORMS = [
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[t ]{_TIME}{_HALF}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    ("basic", rf"^(\d{{4}})(\d{{2}})(\d{{2}})t(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    ("site", rf"^(\d{{1,2}})[./-](\d{{1,2}})[./-](\d{{4}}),?[t ]{_TIME}{_HALF}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    ("month", rf"^(?:[a-z]{{3,9}},? )?{_MONTH} (\d{{1,2}}),? (\d{{4}}),? {_TIME}{_HALF}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    ("mail", rf"^(?:[a-z]{{3,9}},? )?(\d{{1,2}})[ -]{_MONTH}[ -](\d{{4}}),? {_TIME}{_HALF}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
]
_EPOCH = r"^[+-]?\d{1,19}(?:\.\d+)?(?:e\+?\d{1,2})?$"
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"


def tidy(c: Column) -> Column:
    """Lower case, one kind of blank and of minus sign, nothing around it."""
    return F.lower(F.trim(F.regexp_replace(F.translate(c, "−‐‑‒–   \t\r\n", "-----      "), " +", " ")))


def with_parsed(df: DataFrame, out: str, value: Column, date_order: Column) -> DataFrame:
    """``df`` with the column ``out``, the ``PARTS`` of a written moment.

    ``date_order`` (dmy or mdy) says how numeric dates are read; where it is null they denote no moment.
    """
    v = F.col("__m_v")
    canon = F.lit(None).cast("string")
    for name, pattern, parts in reversed(_FORMS):
        canon = F.when(v.rlike(pattern), F.concat(F.lit(name + "|"), F.regexp_replace(v, pattern, parts))).otherwise(canon)
    df = df.withColumn("__m_v", tidy(value)).withColumn("__m_order", date_order).withColumn("__m_f", F.split(F.when(~v.rlike(_EPOCH), canon), r"\|"))
    steps = [*_calendar_steps(F.col("__m_f"), F.col("__m_order")), {out: F.when(v.rlike(_EPOCH), _epoch(v)).otherwise(_calendar())}]
    for step in steps:
        df = df.withColumns(step)
    return df.drop("__m_v", "__m_order", "__m_f", *(c for step in steps[:-1] for c in step))


def _epoch(v: Column) -> Column:
    n = v.try_cast("decimal(38,9)")
    size = F.abs(n)
    us = F.when(size < 100_000_000_000, n * 1_000_000).when(size < 100_000_000_000_000, n * 1000).when(size < 100_000_000_000_000_000, n).otherwise(n / 1000)
    return F.when(size < 9_000_000_000_000_000_000, F.struct(F.lit("instant").alias("kind"), F.floor(us).cast("bigint").alias("us"), F.lit(None).cast("string").alias("zone")))


def _calendar_steps(p: Column, date_order: Column) -> list[dict[str, Column]]:
    """Columns to add one after the other, from the split fields: form, year, month, day, hour, minute, second, fraction, half, zone, bracket."""
    form, first, second = p[0], p[2].try_cast("int"), p[3].try_cast("int")
    dmy = (form == "site") & (date_order == "dmy")
    month_name = ((F.position(F.substring(p[2], 1, 3), F.lit(_MONTHS)) + 3) / 4).cast("int")
    raw_hour = p[4].cast("int")
    zone = F.col("__m_zone")
    digits = F.regexp_replace(zone, "[^0-9]", "")
    long = F.length(digits) > 2
    hour_of, minute_of = F.col("__m_oh"), F.col("__m_om")
    return [
        {
            "__m_month": F.when(form.isin("month", "mail"), month_name).when(dmy, second).otherwise(first),
            "__m_day": F.when(dmy, first).otherwise(second),
            "__m_year": F.when((form != "site") | date_order.isin("dmy", "mdy"), p[1].try_cast("int")),
            "__m_hour": F.when(p[8] == "", raw_hour).when(raw_hour.between(1, 12), raw_hour % 12 + F.when(p[8] == "p", 12).otherwise(0)),
            "__m_second": F.when(p[6] == "", F.lit(0)).otherwise(p[6].try_cast("int")),
            "__m_fraction": F.rpad(F.substring(p[7], 1, 6), 6, "0").cast("bigint"),
            "__m_zone": F.regexp_replace(p[9], "^utc(?=[+-])", ""),
        },
        {
            "__m_start": F.unix_micros(F.try_make_timestamp(F.col("__m_year"), F.col("__m_month"), F.col("__m_day"), F.col("__m_hour"), p[5].cast("int"), F.when(F.col("__m_second") < 60, F.col("__m_second")).cast("decimal(16,6)"), F.lit("UTC"))) + F.col("__m_fraction"),
            "__m_oh": F.when(zone.rlike("^[+-]"), F.when(long, F.expr("substr(regexp_replace(__m_zone, '[^0-9]', ''), 1, length(regexp_replace(__m_zone, '[^0-9]', '')) - 2)")).otherwise(digits)).try_cast("int"),
            "__m_om": F.when(long, F.substring(digits, -2, 2)).otherwise(F.lit("0")).try_cast("int"),
            "__m_bracket": p[10],
        },
        {"__m_offset": F.when((hour_of <= 18) & (minute_of < 60), F.when(zone.startswith("-"), -1).otherwise(1) * (hour_of * 60 + minute_of)).cast("bigint")},
    ]


def _calendar() -> Column:
    """``PARTS`` from the columns of :func:`_calendar_steps`."""
    us, zone, none = F.col("__m_start"), F.col("__m_zone"), F.lit(None)
    named = F.when(zone != "", zone).otherwise(F.col("__m_bracket"))
    signed = F.col("__m_oh").isNotNull()
    kind = F.when(signed | zone.isin("z", "utc"), "instant").when(named != "", "zoned").otherwise("local")
    moment = us - F.when(signed, F.col("__m_offset")).otherwise(F.lit(0)) * 60_000_000
    return F.when(moment.isNotNull(), F.struct(kind.alias("kind"), moment.alias("us"), F.when(kind == "zoned", named).otherwise(none).alias("zone")))


@cache
def known_zones() -> tuple[str, ...]:
    """All IANA zone names of this installation (about 600)."""
    return tuple(sorted(z for z in zoneinfo.available_timezones() if z[0].isupper() and z not in ("Factory",)))


@cache
def abbreviations(zone: str) -> dict[str, int]:
    """Zone abbreviation to offset in minutes, as used by ``zone`` from 1990 to 2037, the latest use winning.

    Numeric names such as ``+03`` are left out.
    """
    tz, found = zoneinfo.ZoneInfo(zone), {}
    for year in range(1990, 2038):
        for month in range(1, 13):
            t = dt.datetime(year, month, 15, 12, tzinfo=tz)
            if t.tzname().isalpha():
                found[t.tzname()] = int(t.utcoffset().total_seconds() // 60)
    return found


def local_to_utc(us: Column, zone: Column) -> Column:
    """UTC microseconds of local microseconds in ``zone``; of a repeated local time the earlier moment, of a skipped one null."""
    local = F.timestamp_micros(us)
    utc = F.to_utc_timestamp(local, zone)
    return F.when(F.from_utc_timestamp(utc, zone) == local, F.unix_micros(utc))
