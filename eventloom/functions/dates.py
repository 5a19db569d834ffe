"""Dates are text ('YYYY-MM-DD' or the undated marker); compare them only through `event_date`.

No function reads the clock: callers pass `as_of` (a date) or `now` (a timestamp).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab
from .text import strip


def iso_day(text: Column) -> Column:
    """A date, unpadded forms accepted; null when the text is none."""
    shaped = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text)
    return F.try_to_date(shaped, "yyyy-M-d")


def event_date(date: Column) -> Column:
    """The date column as a date; null for the undated marker."""
    return iso_day(F.nullif(date, F.lit(vocab.ALWAYS)))


def is_always(date: Column) -> Column:
    return date == vocab.ALWAYS


def padded_date(date: Column) -> Column:
    """'YYYY-MM-DD' or the undated marker; null when neither."""
    return F.when(date == vocab.ALWAYS, date).otherwise(iso_day(date).cast("string"))


def padded_time(time: Column) -> Column:
    """'HH:MM'; null when the text is no time of day."""
    valid = time.rlike(r"^([01]?\d|2[0-3]):[0-5]?\d$")
    hour, minute = F.split(time, ":")[0], F.split(time, ":")[1]
    return F.when(valid, F.concat(F.lpad(hour, 2, "0"), F.lit(":"), F.lpad(minute, 2, "0")))


def iso_date_part(value: Column) -> Column:
    """The date an ISO date or date-time starts with."""
    return iso_day(F.substring(value, 1, 10)).cast("string")


def iso_time_part(value: Column) -> Column:
    """'HH:MM' of an ISO date-time; null without one."""
    clock = F.substring(value, 12, 5)
    has_clock = value.contains("T") & (F.length(value) >= 16)
    return F.when(
        has_clock & iso_date_part(value).isNotNull() & clock.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"),
        clock,
    )


def parse_dmy(value: Column) -> Column:
    """'DD.MM.YYYY' as 'YYYY-MM-DD'."""
    text = strip(value)
    shaped = F.when(text.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), text)
    return F.try_to_date(shaped, "d.M.yyyy").cast("string")


def parse_dmy_clock(value: Column) -> Column:
    """'DD.MM.YYYY HH:MM' as a timestamp."""
    shaped = F.when(value.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}\s+\d{1,2}:\d{1,2}$"), value)
    return F.try_to_timestamp(F.regexp_replace(shaped, r"\s+", " "), F.lit("d.M.yyyy H:m"))


def unix_to_local(seconds: Column, offset: str = vocab.SOCIAL_OFFSET) -> Column:
    """Unix seconds as wall-clock time at a fixed offset; zero and below is null."""
    whole = F.when(seconds > 0, seconds.cast("long"))
    return F.from_utc_timestamp(F.timestamp_seconds(whole), offset)


def iso_to_unix(value: Column) -> Column:
    """Unix seconds of an ISO date-time with its zone."""
    shaped = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), value)
    return F.unix_micros(F.try_to_timestamp(shaped)).cast("double") / 1e6


def range_end_date(start: Column, end: Column) -> Column:
    """The last day of a range, the only day otherwise."""
    return F.coalesce(F.nullif(end, start), start)


def local_today(now: Column, city: Column) -> Column:
    """The date at a moment, in the time zone of a city."""
    zones = F.create_map(*[F.lit(x) for pair in vocab.CITY_ZONES.items() for x in pair])
    zone = F.coalesce(zones[city], F.lit(vocab.DEFAULT_ZONE))
    return F.from_utc_timestamp(now, zone).cast("date")


def format_event_date(
    date: Column, time_start: Column, time_end: Column | None = None
) -> Column:
    """Date as shown on a card; with `time_end` as shown on the event's own page."""
    day = event_date(date)
    months = F.array(*[F.lit(m) for m in vocab.MONTHS])
    text = F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), F.element_at(months, F.month(day)))
    start = F.nullif(time_start, F.lit(""))
    shown = F.when(start.isNotNull(), F.concat(text, F.lit(", "), start)).otherwise(text)
    if time_end is None:
        return F.when(is_always(date), vocab.DAILY).otherwise(shown)
    end = F.nullif(time_end, F.lit(""))
    ranged = F.when(
        start.isNotNull() & end.isNotNull(), F.concat(text, F.lit(", "), start, F.lit("–"), end)
    ).otherwise(shown)
    return F.when(is_always(date), vocab.DAILY_DETAIL).otherwise(ranged)


def weekend_days(as_of: Column) -> Column:
    """The Saturday and Sunday among the seven days from `as_of`."""
    week = F.sequence(as_of, F.date_add(as_of, 6))
    return F.filter(week, lambda d: F.weekday(d) >= 5)
