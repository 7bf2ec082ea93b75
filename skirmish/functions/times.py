"""Wall-clock arithmetic without time zones.

``timestampdiff`` and ``date_format`` go through the session's zone even for TIMESTAMP_NTZ, which
bends local stamps around clock changes; these expressions do not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wall_seconds(c: Column | str) -> Column:
    """Whole seconds of a stamp since 2000-01-01 00:00:00 on the same clock; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    days = F.datediff(F.to_date(c), F.lit("2000-01-01").cast("date")).cast("bigint")
    return days * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60 + F.second(c)


def from_wall_seconds(c: Column | str) -> Column:
    """The TIMESTAMP_NTZ of :func:`wall_seconds`."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_add("SECOND", c, F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))


def stamp_text(c: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of a TIMESTAMP_NTZ, fractions cut."""
    c = F.col(c) if isinstance(c, str) else c
    return F.substring(c.cast("string"), 1, 19)
