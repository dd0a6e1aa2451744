"""Timestamp texts of events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions.text import col

ZONED = (
    r"^\d{4}-\d{2}-\d{2}[Tt _]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s?([Zz]|[+-]\d{2}:?\d{2})$"
)

UNZONED = r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"


def event_time(ts: Column | str) -> Column:
    """ISO-8601 in UTC with ``Z``; the fraction is shown only when there is one."""
    utc = F.to_utc_timestamp(col(ts).cast("timestamp"), F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(utc, "SSSSSS")
    return F.concat(
        whole,
        F.when(fraction == "000000", F.lit("")).otherwise(F.concat(F.lit("."), fraction)),
        F.lit("Z"),
    )


def utc_time(text: Column | str) -> Column:
    """Parse an ISO-8601 text; one that names no zone is in UTC. NULL for any other text."""
    text = col(text)
    plain = F.regexp_replace(text, "[Tt_]", " ")
    wall = F.when(plain.rlike(UNZONED), F.concat(
        plain, F.when(F.length(plain) == 10, " 00:00:00").when(F.length(plain) == 16, ":00").otherwise(""), F.lit("+00:00")))
    return F.coalesce(zoned_time(text), wall.try_cast("timestamp"))


def zoned_time(text: Column | str) -> Column:
    """Parse a timestamp that names its zone; NULL for any other text."""
    text = col(text)
    return F.when(text.rlike(ZONED), text.try_cast("timestamp"))
