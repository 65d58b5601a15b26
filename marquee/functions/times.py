"""Paris time: the night boundary, windows, and instants as Columns."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

PARIS = ZoneInfo("Europe/Paris")
NIGHT_ENDS, EVENING_STARTS = 4, 17
DEFAULT_HOURS, LONG_HOURS = 2, 12
SOON = timedelta(minutes=5)


@dataclass(frozen=True)
class Window:
    key: str
    start: datetime
    end: datetime
    ongoing: bool  # whether long runs that already run belong to it


def now_bucket(now: datetime) -> datetime:
    """now, down to five minutes."""
    return now - timedelta(minutes=now.minute % 5, seconds=now.second, microseconds=now.microsecond)


def paris(day: date, hour: int = 0, minute: int = 0) -> datetime:
    """The instant of a Paris wall-clock time."""
    return datetime(day.year, day.month, day.day, hour, minute, tzinfo=PARIS).astimezone(UTC)


def night_day(now: datetime) -> date:
    """The Paris day that a moment belongs to: a day ends at four the next morning."""
    local = now.astimezone(PARIS)
    return local.date() - timedelta(days=local.hour < NIGHT_ENDS)


def window(name: str | None, now: datetime) -> Window | None:
    """The window of a name, an alias or a date; None if there is none or it is over."""
    if not name:
        return None
    # Aliases of the window names.
    alias = {"ce-soir": "tonight", "soir": "tonight", "aujourdhui": "today", "demain": "tomorrow", "week-end": "weekend", "semaine": "week", "mois": "month", "maintenant": "now", "3h": "next3h"}
    key = alias.get(name.strip().lower(), name.strip().lower())
    today = night_day(now)
    morning = lambda n: paris(today + timedelta(days=n), NIGHT_ENDS)
    friday = today + timedelta(days=4 - today.weekday())  # of this week, Monday first
    made = {
        "now": lambda: Window("now", now, now + timedelta(hours=2), True),
        "next3h": lambda: Window("next3h", now, now + timedelta(hours=3), False),
        "tonight": lambda: Window("tonight", max(now, paris(today, EVENING_STARTS)), morning(1), False),
        "today": lambda: Window("today", now, morning(1), True),
        "tomorrow": lambda: Window("tomorrow", paris(today + timedelta(days=1), 6), morning(2), True),
        "weekend": lambda: Window("weekend", max(now, paris(friday, 18)), paris(friday + timedelta(days=3), NIGHT_ENDS), True),
        "week": lambda: Window("week", now, morning(7), True),
        "month": lambda: Window("month", now, morning(30), True),
    }
    if key in made:
        return made[key]()
    try:
        day = date.fromisoformat(key)
    except ValueError:
        return None
    if len(key) != 10:
        return None
    start, end = paris(day, 6), paris(day + timedelta(days=1), NIGHT_ENDS)
    return None if end < now else Window("date", max(start, now), end, True)


def stamp(t: datetime) -> Column:
    """A UTC instant as a literal of the tables' timestamps (without zone, in UTC)."""
    t = t.astimezone(UTC) if t.tzinfo else t
    return F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def to_paris(ts: Column) -> Column:
    """Wall-clock time in Paris of a UTC timestamp without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit("Europe/Paris"), ts)


def from_paris(ts: Column) -> Column:
    return F.convert_timezone(F.lit("Europe/Paris"), F.lit("UTC"), ts)


def paris_day(ts: Column) -> Column:
    return to_paris(ts).cast("date")


def night_day_of(ts: Column) -> Column:
    """Paris day with the night boundary."""
    return (to_paris(ts) - F.expr(f"interval {NIGHT_ENDS} hours")).cast("date")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def effective_end(start: Column, end: Column, hours: int = DEFAULT_HOURS) -> Column:
    return F.coalesce(end, start + F.expr(f"interval '{hours}' hour"))


def long_run(start: Column, end: Column) -> Column:
    return end.isNotNull() & (end > start + F.expr(f"interval '{LONG_HOURS}' hour"))


def ongoing(start: Column, end: Column, now: Column) -> Column:
    return (start <= now) & (effective_end(start, end) >= now)


def in_window(start: Column, end: Column, w: Window, now: datetime) -> Column:
    """Starts in the window, or runs into it: long runs if it takes them, others if it starts now."""
    lo, hi = stamp(w.start), stamp(w.end)
    own = start >= lo
    if w.ongoing:
        own = own | long_run(start, end)
    if w.start <= now + SOON:
        own = own | ~long_run(start, end)
    return (start <= hi) & (effective_end(start, end) >= lo) & own


def slot(ts: Column) -> Column:
    """Six parts of the Paris day."""
    h = F.hour(to_paris(ts))
    return F.when(h < 4, "night").when(h < 12, "morning").when(h < 14, "noon").when(h < 18, "afternoon").when(h < 21, "evening").otherwise("late")


def repaired_end(start: Column, end: Column) -> Column:
    """An end before its start by less than a day is the next morning's; earlier ones go."""
    day = F.expr("interval '1' day")
    return F.when(end >= start, end).when(end + day >= start, end + day)


def window_columns(name: str, now: Column) -> tuple[Column, Column]:
    """(start, end) of a named window for a column of instants: window() for rows instead of one moment."""
    today = night_day_of(now)
    at = lambda days, hour: from_paris(F.to_timestamp_ntz(F.concat(F.date_add(today, days).cast("string"), F.lit(f" {hour:02d}:00:00"))))
    friday = F.lit(4) - F.weekday(today)
    to = lambda hours: now + F.expr(f"interval '{hours}' hour")
    return {
        "now": lambda: (now, to(2)), "next3h": lambda: (now, to(3)), "tonight": lambda: (F.greatest(now, at(0, EVENING_STARTS)), at(1, NIGHT_ENDS)), "today": lambda: (now, at(1, NIGHT_ENDS)), "tomorrow": lambda: (at(1, 6), at(2, NIGHT_ENDS)),
        "weekend": lambda: (F.greatest(now, at(friday, 18)), at(friday + 3, NIGHT_ENDS)), "week": lambda: (now, at(7, NIGHT_ENDS)), "month": lambda: (now, at(30, NIGHT_ENDS)),
    }[name]()
