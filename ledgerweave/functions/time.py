"""Clocks of an activity log. A written timestamp is kept as text; its date and year are those of the
offset it was written in, its hour that of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def parse_timestamp(ts: Column) -> Column:
    """The instant, or null unless the text is a timestamp with an offset."""
    return F.when(ts.rlike(RFC3339), F.upper(ts).try_cast("timestamp"))


def epoch_second(ts: Column) -> Column:
    return F.unix_timestamp(parse_timestamp(ts))


def written_year(ts: Column) -> Column:
    return F.when(parse_timestamp(ts).isNotNull(), F.substring(ts, 1, 4).cast("int"))


def date_key(ts: Column) -> Column:
    """First ten characters; a shorter text has no date."""
    return F.when(F.octet_length(ts) >= 10, F.substring(ts, 1, 10))


def local_hour(ts: Column) -> Column:
    return F.hour(parse_timestamp(ts)).cast("long")


def weekday(date: Column) -> Column:
    """English name of the day, or null."""
    return F.date_format(date.try_cast("date"), "EEEE")


def short_date(date: Column) -> Column:
    """As in "Apr 5"; the text itself if it's no date."""
    return F.coalesce(F.date_format(date.try_cast("date"), "MMM d"), date)


def hour_label(hour: Column) -> Column:
    return F.when(hour == 0, "12am").when(hour < 12, F.concat(hour.cast("string"), F.lit("am"))).when(hour == 12, "12pm").otherwise(F.concat((hour - 12).cast("string"), F.lit("pm")))


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes, 0 if the end is before the start or either is missing."""
    return F.greatest(F.coalesce(F.timestamp_diff("MINUTE", start, end), F.lit(0)), F.lit(0)).cast("long")
