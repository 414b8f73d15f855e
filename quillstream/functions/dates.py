"""Event time: parsing that never invents a date, half-open windows and issue labels."""

from __future__ import annotations

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?( ?(Z|[+-]\d{2}:?\d{2}))?)?$"
_PREFIX = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
_DAY = r"^\d{4}-\d{2}-\d{2}"
_MAIL = r"^([A-Za-z]{3}, *)?\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}(:\d{2})? ([+-]\d{4}|GMT|UTC|UT|Z)$"


def parse_datetime(text: Column) -> Column:
    """A timestamp from ISO or mail form, else from its first 19 or 10 characters; null if none reads as a date.

    Text without an offset is UTC.  Needs the session time zone UTC.
    """
    t = F.trim(text)
    iso = F.when(t.rlike(_ISO), F.try_to_timestamp(F.replace(F.replace(t, F.lit(","), F.lit(".")), F.lit(" "), F.lit("T"))))
    iso = F.coalesce(iso, F.when(t.rlike(_ISO), F.try_to_timestamp(t)))
    second = F.when(t.rlike(_PREFIX), F.try_to_timestamp(F.concat(F.replace(F.substring(t, 1, 19), F.lit(" "), F.lit("T")), F.lit("Z"))))
    day = F.when(t.rlike(_DAY), F.try_to_timestamp(F.concat(F.substring(t, 1, 10), F.lit("T00:00:00Z"))))
    bare = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3}, *", ""), r" (GMT|UTC|UT|Z)$", " +0000")
    with_seconds = F.regexp_replace(bare, r"(\d{4} \d{2}:\d{2}) ", "$1:00 ")
    mail = F.when(t.rlike(_MAIL), F.try_to_timestamp(with_seconds, F.lit("d MMM yyyy HH:mm:ss Z")))
    return F.coalesce(iso, second, day, mail)


def in_window(t: Column, start: datetime, end: datetime) -> Column:
    """start <= t < end; null counts as outside."""
    return F.coalesce((t >= F.lit(start)) & (t < F.lit(end)), F.lit(False))


def rolling_window(now: datetime, days: int, tz: str = "UTC", completed_days: bool = False) -> tuple[datetime, datetime]:
    """The last `days` days before now, by the wall clock of tz; whole local days if completed_days."""
    local = now.astimezone(ZoneInfo(tz))
    end = local.replace(hour=0, minute=0, second=0, microsecond=0) if completed_days else local
    return end - timedelta(days=days), end


def calendar_window(first: datetime, last: datetime, tz: str = "UTC") -> tuple[datetime, datetime]:
    """The local days from first to last, both included, as a half-open window."""
    zone = ZoneInfo(tz)
    return datetime(first.year, first.month, first.day, tzinfo=zone), datetime(last.year, last.month, last.day, tzinfo=zone) + timedelta(days=1)


def issue_label(end: Column) -> Column:
    """ISO year and week of the last instant before `end`, as 2026-W33."""
    last = end - F.expr("INTERVAL 1 MICROSECOND")
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), last).cast("int"), F.weekofyear(last))


# Short names of months in Spanish, and the form of an issue's label.
MONTHS = ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic")
ISSUE = r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}"
#: Characters of embedded scripts that are looked through for a date, and of a date.
SCAN, DATE_CHARS = 1_000_000, 64


def issue_date(t: Column) -> Column:
    """Day, Spanish month and year: 17 ago 2026."""
    return F.concat_ws(" ", F.dayofmonth(t).cast("string"), F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(t)), F.year(t).cast("string"))


def issue_date_end(end: Column) -> Column:
    """The last day that a half-open window covers."""
    return issue_date(end - F.expr("INTERVAL 1 MICROSECOND"))


def issue_datetime(t: Column) -> Column:
    """Date and time of day in the session's zone: 17 ago 2026, 08:05 UTC."""
    return F.concat(issue_date(t), F.lit(", "), F.date_format(t, "HH:mm"), F.lit(" "), F.current_timezone())


def window_days(start: Column, end: Column) -> Column:
    """Length of a window in days."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(86400e6)


def issue_week_text(label: Column) -> Column:
    """2026-W33 as Semana 33; any other label as it is."""
    week = F.regexp_extract(label, r"^\d{4}-W(\d{2})$", 1)
    return F.when(week != "", F.concat(F.lit("Semana "), week.cast("int").cast("string"))).otherwise(label)


def issue_label_in(path: Column) -> Column:
    """The label in /<label>/newsletter.html; null for any other path."""
    label = F.regexp_extract(path, rf"\A/({ISSUE})/newsletter\.html\z", 1)
    return F.when(label != "", label)


def embedded_date(scripts: Column, key: str) -> Column:
    """The date that a JSON key has in embedded scripts, escaped or not; the first place of the key settles it, even if it holds no date."""
    name = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in key)
    pattern = rf'\\?"{name}\\?"\s*:\s*(?:\\?"([^"\\]{{0,{DATE_CHARS}}})\\?"|[A-Za-z0-9_.+-]{{1,{DATE_CHARS}}})'
    return parse_datetime(F.regexp_extract(F.substring(scripts, 1, SCAN), pattern, 1))
