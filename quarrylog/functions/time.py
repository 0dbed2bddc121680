"""Time stamps of logs, and grids of them.  All times are without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of the three kinds of logs.
FORMATS = {"postgresql": "yyyy-MM-dd HH:mm:ss", "mysql57": "yyyy-MM-dd HH:mm:ss", "mysql55": "yyMMdd HH:mm:ss"}
#: Characters of a fraction of three digits and a zone of three letters.
ZONE_SUFFIX = 8


def parse(text: Column, kind: str) -> Column:
    """The time without zone; null if the text has another format.  Years of two digits are 1969 to 2068."""
    ts = F.try_to_timestamp(text, F.lit(FORMATS[kind])).cast("timestamp_ntz")
    return F.when(F.year(ts) > 2068, F.timestamp_add("YEAR", F.lit(-100), ts)).otherwise(ts) if "yyyy" not in FORMATS[kind] else ts


def without_zone(text: Column) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - ZONE_SUFFIX)


def day_and_time(day: Column, time: Column) -> Column:
    """A day and a time of day, without the latter's fraction."""
    return F.concat_ws(" ", day, F.split_part(time, F.lit("."), F.lit(1)))


def padded_hour(text: Column) -> Column:
    """``yymmdd  H:MM:SS`` with two digits for the hour."""
    return F.regexp_replace(text, "  ", " 0")


def minute(ts: Column) -> Column:
    return F.date_trunc("minute", ts).cast("timestamp_ntz")


def epoch_minutes(ts: Column) -> Column:
    """Whole minutes since 1970."""
    return F.timestamp_diff("MINUTE", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def from_minutes(minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def minutes_spanned(first: Column, last: Column) -> Column:
    """How many minutes a closed span has."""
    return F.timestamp_diff("MINUTE", first, last) + 1


def floor_bucket(ts: Column, minutes: int) -> Column:
    """The start of the bucket [t, t + minutes) of a time."""
    at = epoch_minutes(ts)
    return from_minutes(at - F.pmod(at, F.lit(minutes)))


def ceil_bucket(ts: Column, minutes: int) -> Column:
    """The end of the bucket (t - minutes, t] of a time on a whole minute."""
    at = epoch_minutes(ts)
    return from_minutes(at + F.pmod(-at, F.lit(minutes)))


def grid(first: Column, last: Column, minutes: int) -> Column:
    """array of the times from first to last."""
    return F.sequence(first, last, F.expr(f"INTERVAL {minutes} MINUTE"))


def steps_back(date: Column, steps: int, minutes: int, ahead: int = 0) -> Column:
    """array of the ``steps`` times before a date, and of those up to ``ahead`` minutes after it."""
    start = F.timestamp_add("MINUTE", F.lit(-steps * minutes), date)
    return F.sequence(start, F.timestamp_add("MINUTE", F.lit(ahead - minutes), date), F.expr(f"INTERVAL {minutes} MINUTE"))
