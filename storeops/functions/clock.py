"""Instants, local days and local midnights; zones are always named, never the session's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the zone of the stores.
ZONE = "Europe/Copenhagen"


def instant(text: Column, source_tz: str = "UTC") -> Column:
    """UTC wall time of an ISO date-time string; a zone in the text wins over ``source_tz``; null if it can't be parsed."""
    zoned = text.rlike(r"(?i)(z|[+-]\d\d:?\d\d)$")
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(text).cast("timestamp_ntz"))
    plain = F.convert_timezone(F.lit(source_tz), F.lit("UTC"), F.call_function("try_to_timestamp", F.regexp_replace(text, "T", " ")).cast("timestamp_ntz"))
    return F.when(zoned, utc).otherwise(plain)


def local_time(ts: Column, tz: str = ZONE) -> Column:
    """Wall time in ``tz`` of a UTC wall time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)


def local_date(ts: Column, tz: str = ZONE) -> Column:
    return local_time(ts, tz).cast("date")


def local_midnight(day: Column, tz: str = ZONE, mode: str = "true") -> Column:
    """UTC wall time at which the local day begins.

    ``noon_offset`` takes the zone's offset at UTC noon of the day instead of
    that at midnight, so it is an hour off on the days on which clocks change.
    """
    start = day.cast("timestamp_ntz")
    if mode == "true":
        return F.convert_timezone(F.lit(tz), F.lit("UTC"), start)
    if mode != "noon_offset":
        raise ValueError(f"mode is 'true' or 'noon_offset', not {mode!r}")
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), start + F.expr("interval 12 hours")) - F.expr("interval 12 hours")


def unix_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a UTC wall time."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def utc_day_floor(seconds: Column) -> Column:
    """The beginning of the UTC day of unix seconds."""
    return seconds - F.pmod(seconds, F.lit(86_400).cast("bigint"))
