"""Cleaning of short coded strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind at either end, no-break spaces and zero-width marks included.
_EDGES = r"^[\s  -‏ ⁠﻿]+|[\s  -‏ ⁠﻿]+$"


def stripped(c: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(c, _EDGES, "")


def blank_to_null(c: Column) -> Column:
    """Stripped; null where nothing remains."""
    s = stripped(c)
    return F.when(F.length(s) > 0, s)


def bare_identifier(c: Column) -> Column:
    """The bare identifier in a written reference, in lower case; null if nothing remains.

    Drops, in any combination: blanks, brackets and quotes around it, a scheme (``urn:uuid:``),
    a server and resource name (``https://host/Type/``), a version (``/_history/2``, ``|2``).
    """
    wraps = r"""^[\s {}\[\]()<>"'`]+|[\s {}\[\]()<>"'`]+$"""
    s = F.regexp_replace(F.lower(c), wraps, "")
    s = F.regexp_replace(s, r"/_history(/.*)?$|\|.*$|[?#].*$|/+$", "")
    s = F.regexp_replace(s, r"^.*[/:]", "")
    s = F.regexp_replace(s, wraps, "")
    return F.when(F.length(s) > 0, s)
