"""Normal forms of keys and labels, and UTC instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"^\s*$"


def normal_key(c: Column) -> Column:
    """Key for comparison: surrounding spaces trimmed, lower case; null, empty and blank all give null."""
    k = F.lower(F.trim(c.cast("string")))
    return F.when(~k.rlike(_BLANK), k)


def normal_label(c: Column) -> Column:
    """Spelling-independent form of a label such as ``source`` or ``edge_type``; null stays null."""
    return F.lower(F.trim(c.cast("string")))


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp; zone-less ones are read as UTC (the session's zone must be UTC)."""
    return F.unix_micros(c.cast("timestamp"))
