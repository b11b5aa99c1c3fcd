"""Usable values out of answers as people and devices write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortspark.functions.text import blank_to_null, stripped

# Words for yes and no in English, German and Spanish, and month abbreviations of these languages.
TRUE = ("true", "t", "yes", "y", "1", "ja", "j", "wahr", "si", "sí", "s", "verdadero")
FALSE = ("false", "f", "no", "n", "0", "nein", "falsch", "falso")
MONTHS = {"jan": 1, "ene": 1, "feb": 2, "mar": 3, "mär": 3, "mrz": 3, "apr": 4, "abr": 4, "may": 5, "mai": 5, "jun": 6, "jul": 7, "aug": 8, "ago": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12, "dic": 12}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def number(c: Column) -> Column:
    """Double from text with a decimal point or comma, thousands marks and a unit; null if it is no number.

    Of points and commas the last kind is decimal if it stands once; a kind that stands several times marks thousands.
    """
    shape = r"^([+-]?[0-9][0-9.,]*)(?:\s*[\p{L}%°][\p{L}0-9%°/²^]*)?$"
    last_kind = F.regexp_replace(F.regexp_extract(stripped(c), shape, 1), r"\.(?=[\d.]*,)|,(?=[\d,]*\.)", "")
    plain = _let(last_kind, lambda d: F.when(d.rlike(r"[.,].*[.,]"), F.regexp_replace(d, "[.,]", "")).otherwise(F.translate(d, ",", ".")))
    return plain.try_cast("double")


def boolean(c: Column) -> Column:
    """Boolean from words in three languages or 1 and 0, else null."""
    return _let(F.lower(stripped(c)), lambda s: F.when(s.isin(*TRUE), True).when(s.isin(*FALSE), False))


def date(c: Column) -> Column:
    """Date from ``2023-02-01``, ``1.2.2023`` (day first) or ``1 Feb 2023``, else null."""
    iso, dotted, named = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[t ]\d.*)?$", r"^(\d{1,2})\.\s?(\d{1,2})\.\s?(\d{4})$", r"^(\d{1,2})\.?[ -](\p{L}{3})\p{L}*\.?,?[ -](\d{4})$"
    numbers = F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv))
    whole = lambda p: F.try_make_timestamp(p[0].try_cast("int"), p[1].try_cast("int"), p[2].try_cast("int"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"), F.lit("UTC"))
    fields = lambda s: F.when(s.rlike(iso), F.split(F.regexp_replace(s, iso, "$1-$2-$3"), "-")).when(s.rlike(dotted), F.split(F.regexp_replace(s, dotted, "$3-$2-$1"), "-")).when(s.rlike(named), _let(F.split(F.regexp_replace(s, named, "$3-$2-$1"), "-"), lambda p: F.array(p[0], F.try_element_at(numbers, p[1]).cast("string"), p[2])))
    day = _let(_let(F.lower(stripped(c)), fields), whole)
    return F.date_from_unix_date((F.unix_micros(day) / 86_400_000_000).cast("int"))


def code(c: Column) -> Column:
    """Option code in lower case without blanks around it, else null."""
    return F.lower(blank_to_null(c))


def two_decimals(c: Column) -> Column:
    """A number with exactly two decimals after a point; null beyond 36 digits."""
    return c.try_cast("decimal(38,2)").cast("string")
