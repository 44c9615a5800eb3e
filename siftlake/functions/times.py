"""Time parsing, bounds and run durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlake.functions import text

# Full date, calendar or week form, basic or extended, with an optional time and
# offset. Valid for Java and RE2. Groups: 1 year, 2 month, 3 day, 4 week, 5 weekday.
_TIME = (
    r"(?:[01][0-9]|2[0-3])"
    r"(?::[0-5][0-9](?::[0-5][0-9](?:[.,][0-9]+)?)?|[0-5][0-9](?:[0-5][0-9](?:[.,][0-9]+)?)?)?"
)
_ZONE = r"(?:Z|[+-](?:[01][0-9]|2[0-3])(?::?[0-5][0-9](?::?[0-5][0-9](?:[.,][0-9]+)?)?)?)"
ISO_PATTERN = (
    r"(?s)\A([0-9]{4})(?:-([0-9]{2})-([0-9]{2})|([0-9]{2})([0-9]{2})|-W([0-9]{2})(?:-([1-7]))?|W([0-9]{2})([1-7])?)"
    r"(?:[^0-9Z]" + _TIME + _ZONE + r"?)?\z"
)
# The usual form, which a cast reads as it stands: extended date, seconds with up to six digits, and
# an offset within the casts' limit of 18 hours.
_USUAL = (
    r"\A(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"(?:[T ](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]{1,6})?(?:Z|[+-](?:0[0-9]|1[0-7]):[0-5][0-9])?)?\z"
)


def is_iso_datetime(value: Column) -> Column:
    """True for text that holds a whole ISO-8601 date, with or without a time. The pattern
    fixes the places of the parts, so only matching text is cut up and checked as a date."""
    s = F.btrim(value, F.lit(" \t\n\r\f\x0b"))
    year, extended = F.substring(s, 1, 4), F.substring(s, 5, 1) == "-"
    date = F.when(extended, F.substring(s, 1, 10)).otherwise(
        F.concat_ws("-", year, F.substring(s, 5, 2), F.substring(s, 7, 2)))
    week = F.regexp_extract(s, r"^[0-9]{4}-?W([0-9]{2})", 1).try_cast("int")
    weeks_in_year = F.weekofyear(F.concat(year, F.lit("-12-28")).try_cast("date"))
    valid = F.when(F.substring(s, 5, 2).contains("W"), week.between(1, 53) & (week <= weeks_in_year)).otherwise(
        date.try_cast("date").isNotNull())
    usual = F.substring(s, 1, 10).try_cast("date").isNotNull()
    return F.when(s.rlike(_USUAL), usual).when(s.rlike(ISO_PATTERN), (year != "0000") & valid).otherwise(False)


_DATE = r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8}|[0-9]{4}-W[0-9]{2}(?:-[1-7])?|[0-9]{4}W[0-9]{2}[1-7]?)"
_CLOCK = r"([0-9]{2}):?([0-9]{2})?:?([0-9]{2})?(?:[.,]([0-9]+))?"


def iso_timestamp(value: Column) -> Column:
    """The time of every text that `is_iso_datetime` accepts, else null: one of the usual form is
    cast, of others the parts are cut out and put together as one that a cast knows. Without an offset the time is of
    the session's zone; digits beyond micros are cut off."""
    s = F.btrim(value, F.lit(" \t\n\r\f\x0b"))
    year, digits = F.substring(s, 1, 4), F.regexp_replace(F.regexp_extract(s, _DATE, 0), "-", "")
    week = F.regexp_extract(digits, "W([0-9]{2})", 1).try_cast("int")
    day = F.coalesce(F.regexp_extract(digits, "W[0-9]{2}([1-7])", 1).try_cast("int"), F.lit(1))
    monday = F.date_trunc("week", F.concat(year, F.lit("-01-04")).try_cast("timestamp_ntz")).cast("date")
    date = F.when(week.isNotNull(), F.date_add(monday, (week - 1) * 7 + day - 1)).otherwise(
        F.concat_ws("-", year, F.substring(digits, 5, 2), F.substring(digits, 7, 2)).try_cast("date"))
    clock = F.regexp_extract(s, _DATE + "[^0-9Z](.*)$", 1)

    def part(group: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(clock, "^" + _CLOCK, group), F.lit("")), F.lit("0"))

    time = F.concat(F.lpad(part(1), 2, "0"), F.lit(":"), F.lpad(part(2), 2, "0"), F.lit(":"), F.lpad(part(3), 2, "0"),
                    F.lit("."), F.rpad(F.substring(part(4), 1, 6), 6, "0"))
    zone = F.regexp_extract(clock, r"([Z+-].*)$", 1)
    local = F.concat(date.cast("string"), F.lit(" "), time)
    shift = [F.coalesce(F.nullif(F.regexp_extract(zone, r"^[+-]([0-9]{2}):?([0-9]{2})?:?([0-9]{2})?", g), F.lit("")), F.lit("0")).cast("int")
             for g in (1, 2, 3)]
    seconds = (shift[0] * 3600 + shift[1] * 60 + shift[2]) * F.when(zone.startswith("-"), -1).otherwise(1)
    utc = F.concat(local, F.lit("Z")).try_cast("timestamp") - F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.when(s.rlike(_USUAL), s.try_cast("timestamp")).when(is_iso_datetime(value), F.when(zone == "", local.try_cast("timestamp")).otherwise(utc))


def parse_time(value: Column) -> Column:
    """Tolerant ISO time; missing or invalid text counts as the distant past."""
    parsed = iso_timestamp(value)
    return F.coalesce(parsed, F.lit("0001-01-01 00:00:00").cast("timestamp"))


def within(ts: Column, after: Column | None = None, before: Column | None = None) -> Column:
    """Exclusive optional bounds; no bound means every row."""
    condition = F.lit(True)
    if after is not None:
        condition = condition & (ts > after)
    if before is not None:
        condition = condition & (ts < before)
    return condition


def time_range(ts: Column, start: Column, end: Column) -> Column:
    """Half-open range, start included."""
    return (ts >= start) & (ts < end)


def elapsed_seconds(start: Column, end: Column) -> Column:
    return F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))


def run_duration(status: Column, stored: Column, start: Column, now: Column) -> Column:
    """Stored text once finished, otherwise the time since the start."""
    kept = F.when(F.coalesce(stored, F.lit("")) != "", stored).otherwise(F.lit("-"))
    return F.when((F.lower(status) == "finished") | start.isNull(), kept).otherwise(
        text.duration_hms(elapsed_seconds(start, now))
    )
