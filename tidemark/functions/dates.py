"""Dates, times of day and clocks as sources write them, as column expressions; null where nothing is meant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: accepted spellings of a day, tried in order; fixed values
FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "MMM d, yyyy", "MMM d yyyy", "M/d/yyyy", "yyyyMMdd")
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
REPORT_ZONE = "America/New_York"
REPORT_NAME = r"(?i)^Injury-Report_(\d{4}-\d{2}-\d{2})_(\d{1,2})(?:_(\d{2}))?(AM|PM)\.pdf$"
OFFSET = r"(Z|[+-]\d{2}:\d{2})$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_of(c: str | Column) -> Column:
    """The day of a text in one of FORMATS, or of an ISO time with an offset."""
    c = F.trim(_col(c))
    iso = F.to_date(F.try_to_timestamp(F.when(c.rlike(rf"^\d{{4}}-\d{{2}}-\d{{2}}T.*{OFFSET}"), F.substring(c, 1, 10)), F.lit("yyyy-MM-dd")))
    return F.coalesce(*(F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in FORMATS), iso)


def utc_time(c: str | Column) -> Column:
    """An ISO time with an offset; a time without one is null, as nobody can say when it was."""
    c = F.trim(_col(c))
    return F.when(c.rlike(OFFSET), F.try_to_timestamp(c))


def report_time(name: str | Column) -> Column:
    """The UTC time that a report's file name tells in New York's time, on a 12-hour clock.

    A time that the end of summer time repeats is the later one, of winter time.
    """
    part = lambda k: F.regexp_extract(_col(name), REPORT_NAME, k)
    hour = F.nullif(part(2), F.lit("")).try_cast("int")
    at = hour % 12 + F.when(F.upper(part(4)) == "PM", 12).otherwise(0)
    minute = F.coalesce(F.nullif(part(3), F.lit("")).try_cast("int"), F.lit(0))
    local = F.try_to_timestamp(F.concat(part(1), F.format_string(" %02d:%02d", at, minute)), F.lit("yyyy-MM-dd HH:mm"))
    utc = lambda t: F.to_utc_timestamp(t, REPORT_ZONE)
    hour_on = F.make_interval(hours=F.lit(1))
    # an hour later no repeated time is left; where summer time begins the plain reading is the later one
    return F.when(hour.between(1, 12), F.greatest(utc(local), utc(local + hour_on) - hour_on))


def minutes_of(c: str | Column) -> Column:
    """MM:SS or a number, as minutes; negative minutes and seconds outside [0, 60) mean nothing."""
    c = F.trim(_col(c))
    m, s = (F.regexp_extract(c, r"^(\d+(?:\.\d+)?):(\d+(?:\.\d+)?)$", k).try_cast("double") for k in (1, 2))
    return F.when(c.contains(":"), F.when(s < 60, m + s / 60)).otherwise(c.try_cast("double"))


def clock_seconds(c: str | Column) -> Column:
    """PT11M42.00S or MM:SS in seconds."""
    iso, colon = r"^PT(\d+)M([\d.]+)S$", r"^(\d+):(\d+)$"
    seconds = lambda p: F.regexp_extract(c, p, 1).try_cast("double") * 60 + F.regexp_extract(c, p, 2).try_cast("double")
    return F.coalesce(seconds(iso), seconds(colon))


def elapsed_seconds(period: str | Column, clock: str | Column, regular: int = 720, extra: int = 300, periods: int = 4) -> Column:
    """Seconds of play since the start: periods of `regular` seconds, after `periods` of them of `extra`; the clock runs down."""
    p = _col(period)
    before = F.least(p - 1, F.lit(periods)) * regular + F.greatest(p - 1 - periods, F.lit(0)) * extra
    return before + F.when(p <= periods, regular).otherwise(extra) - clock_seconds(clock)


def named_days(c: str | Column) -> Column:
    """All days written with a month's name and a year, in order."""
    found = F.regexp_extract_all(_col(c), F.lit(rf"\b((?:{MONTHS})[a-z]* \d{{1,2}}, \d{{4}})"), 1)
    short = lambda x: F.regexp_replace(x, r"^([A-Z][a-z]{2})[a-z]*", "$1")
    return F.array_compact(F.transform(found, lambda x: F.to_date(F.try_to_timestamp(short(x), F.lit("MMM d, yyyy")))))


#: the full names of months; fixed values
FULL_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def mentioned_days(c: str | Column) -> Column:
    """The different days of this century's first hundred years that a text mentions, in order: 2024-01-31, or January 31, 2024 with
    or without the comma and in any case. Mentions are no proof of when something happened."""
    iso = F.regexp_extract_all(_col(c), F.lit(r"\b(20\d{2}-\d{2}-\d{2})\b"), 1)
    named = F.regexp_extract_all(_col(c), F.lit(rf"(?i)\b((?:{'|'.join(FULL_MONTHS)})\s+\d{{1,2}},?\s+20\d{{2}})\b"), 1)

    def day(x: Column) -> Column:
        part = lambda k: F.regexp_extract(x, r"(?i)^([a-z]+)\s+(\d{1,2}),?\s+(20\d{2})$", k)
        month = F.array_position(F.array(*(F.lit(m.lower()) for m in FULL_MONTHS)), F.lower(part(1)))
        return F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(2), 2, "0")).try_cast("date")

    days = F.concat(F.transform(iso, lambda x: x.try_cast("date")), F.transform(named, day))
    return F.array_sort(F.array_distinct(F.array_compact(days)))


def section_day(c: str | Column, year: str | Column) -> Column:
    """The day of a section heading that ends in (Mon DD)."""
    part = F.regexp_extract(_col(c), rf"\(((?:{MONTHS}) \d{{1,2}})\)\s*$", 1)
    return F.to_date(F.try_to_timestamp(F.concat(F.nullif(part, F.lit("")), F.lit(", "), _col(year).cast("string")), F.lit("MMM d, yyyy")))


def season_bounds(season: str | Column) -> tuple[Column, Column]:
    """A season named 2019-20 lasts from the first of July of its first year to that of the next, which is out."""
    first = F.substring(_col(season), 1, 4).try_cast("int")
    return F.make_date(first, F.lit(7), F.lit(1)), F.make_date(first + 1, F.lit(7), F.lit(1))
