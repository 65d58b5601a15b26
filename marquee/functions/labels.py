"""French labels of when an outing takes place, and dates as sources write them, as Columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import times
from .titles import let

# Names of days (Monday first) and months, in full and short.
DAYS = ("lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche")
SHORT_DAYS = ("lun.", "mar.", "mer.", "jeu.", "ven.", "sam.", "dim.")
MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")
SHORT_MONTHS = ("janv.", "févr.", "mars", "avr.", "mai", "juin", "juil.", "août", "sept.", "oct.", "nov.", "déc.")
OPENING_HOURS = 4  # an entry this long that has begun has opening hours


def _name(names: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), i)


def _weekday(day: Column) -> Column:
    return F.weekday(day) + 1


def clock(ts: Column) -> Column:
    """'20h', '20h30' in Paris."""
    local = times.to_paris(ts)
    minute = F.minute(local)
    return F.concat(F.hour(local).cast("string"), F.lit("h"), F.when(minute == 0, "").otherwise(F.lpad(minute.cast("string"), 2, "0")))


def short_day(ts: Column) -> Column:
    """'12 nov.'"""
    day = times.paris_day(ts)
    return F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), _name(SHORT_MONTHS, F.month(day)))


def day_label(ts: Column) -> Column:
    """'lun. 12 oct.'"""
    return F.concat(_name(SHORT_DAYS, _weekday(times.paris_day(ts))), F.lit(" "), short_day(ts))


def long_day(ts: Column, now: datetime) -> Column:
    """'lundi 12 octobre', with the year unless it is this one."""
    day = times.paris_day(ts)
    year = F.year(day)
    return F.concat_ws(" ", _name(DAYS, _weekday(day)), F.dayofmonth(day).cast("string"), _name(MONTHS, F.month(day)), F.when(year != now.astimezone(times.PARIS).year, year.cast("string")))


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def _nights(ts: Column, now: datetime) -> Column:
    return F.datediff(times.night_day_of(ts), F.lit(times.night_day(now)))


def when(start: Column, end: Column, time_known: Column, now: datetime) -> Column:
    """What matters on a card: 'Ce soir · 20h30', 'Demain · 19h', 'Sam. 12 oct. · 21h', 'En cours · jusqu'au 12 nov.' and the like."""
    n = times.stamp(now)
    left, ahead = _nights(end, now), _nights(start, now)
    until = F.concat(F.lit("jusqu'au "), short_day(end))
    run = F.when(start > n, F.concat(F.lit("Du "), short_day(start), F.lit(" au "), short_day(end))).when(left <= 0, "Dernier jour aujourd'hui").when(left == 1, "Dernier jour demain")
    run = run.when(left <= 7, F.concat(F.lit("Plus que "), left.cast("string"), F.lit(" jours · "), until)).otherwise(F.concat(F.lit("En cours · "), until))
    open_ = end.isNotNull() & (end >= start + F.expr(f"interval '{OPENING_HOURS}' hour"))
    going = F.when(~time_known, "Aujourd'hui").when(open_, F.concat(F.lit("Aujourd'hui · jusqu'à "), clock(end))).otherwise(F.concat(F.lit("En ce moment · depuis "), clock(start)))
    hour = F.hour(times.to_paris(start))
    evening = (hour >= times.EVENING_STARTS) | (hour < times.NIGHT_ENDS)
    day = F.when(ahead == 0, F.when(evening, "Ce soir").otherwise("Aujourd'hui")).when(ahead == 1, "Demain").when(ahead.between(2, 6), _capital(_name(DAYS, _weekday(times.paris_day(start))))).otherwise(_capital(day_label(start)))
    later = F.concat(day, F.when(time_known, F.concat(F.lit(" · "), clock(start))).otherwise(""))
    return F.when(times.long_run(start, end), run).when(times.ongoing(start, end, n), going).otherwise(later)


def badge(start: Column, end: Column, time_known: Column, now: datetime) -> Column:
    """A short label for an image, or null: 'J-2', 'Dernier jour', 'Dans 40 min', 'Dans 2 h', 'En cours'."""
    n = times.stamp(now)
    left = _nights(end, now)
    run = F.when((start <= n) & (left <= 0), "Dernier jour").when((start <= n) & (left <= 3), F.concat(F.lit("J-"), left.cast("string")))
    seconds = times.seconds_between(start, n)
    minutes = F.floor(seconds / 60 + 0.5)
    soon = F.when(minutes < 60, F.concat(F.lit("Dans "), minutes.cast("string"), F.lit(" min"))).otherwise(F.concat(F.lit("Dans "), F.floor(minutes / 60 + 0.5).cast("string"), F.lit(" h")))
    return F.when(times.long_run(start, end), run).when(time_known & (seconds > 0) & (seconds < 3 * 3600), soon).when(time_known & times.ongoing(start, end, n), "En cours")


def full(start: Column, end: Column, time_known: Column, now: datetime) -> Column:
    """struct(primary, secondary): the date line of a page."""
    n, long_ = times.stamp(now), times.long_run(start, end)
    run = F.when(start <= n, F.concat(F.lit("En cours — "), F.regexp_replace(when(start, end, time_known, now), "^En cours · ", "")))
    until = F.when(end.isNotNull() & (times.night_day_of(start) == times.night_day_of(end)), F.concat(F.lit(" – "), clock(end))).otherwise("")
    one = F.when(time_known, F.concat(clock(start), until)).otherwise("Horaire non communiqué")
    span = F.concat(F.lit("Du "), long_day(start, now), F.lit(" au "), long_day(end, now))
    return F.struct(F.when(long_, span).otherwise(_capital(long_day(start, now))).alias("primary"), F.when(long_, run).otherwise(one).alias("secondary"))


def film_times(at: Column, now: datetime) -> Column:
    """The next showings of a film (array of starts in order): 'Ce soir · 18h, 20h30, 22h15', of the first day only; empty if none is left."""
    left = F.filter(at, lambda x: x >= times.stamp(now) - F.expr("interval '15' minute"))

    def line(xs: Column) -> Column:
        first = xs[0]
        more = F.transform(F.slice(F.filter(xs, lambda x: times.night_day_of(x) == times.night_day_of(first)), 2, 2), clock)
        return F.when(F.size(xs) == 0, "").otherwise(F.array_join(F.concat(F.array(when(first, F.lit(None).cast("timestamp_ntz"), F.lit(True), now)), more), ", "))

    return let(left, line)


# ---------------------------------------------------------------- dates as sources write them

_DAY = r"^\d{4}-\d{2}-\d{2}$"
_LOCAL = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?$"
_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:Z|[+-]\d{2}:?\d{2})$"
_MAIL = r"^(?:[A-Z][a-z]{2}, )?\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}(?::\d{2})? (?:GMT|UTC|[+-]\d{4})$"


def instant(written: Column, is_end: bool = False, midnight_unknown: bool = False) -> Column:
    """struct(at, time_known) of a written date: UTC without zone.

    A date alone is noon in Paris (23:59 for an end) and its time is unknown; a time without zone is
    Paris's; one with a zone, or of a mail header, is converted. ``midnight_unknown``: a source
    that writes midnight for no time. Anything else is null and unknown.
    """
    text = F.trim(written)
    noon = "23:59:00" if is_end else "12:00:00"
    day = F.to_date(F.when(text.rlike(_DAY), text).otherwise(F.when(text.rlike(_LOCAL), F.substring(text, 1, 10))))
    local = F.when(text.rlike(_LOCAL), F.try_to_timestamp(F.replace(text, F.lit("T"), F.lit(" "))).cast("timestamp_ntz"))
    zoned = F.when(text.rlike(_ZONED), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"\s*([+-]\d{2})(\d{2})$", "$1:$2"), r"\s+(?=[Z+-])", "")))
    mail = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^[A-Z][a-z]{2}, ", ""), "(GMT|UTC)$", "+0000"), r"^(\d) ", "0$1 ")
    mail = F.when(text.rlike(_MAIL), F.coalesce(F.try_to_timestamp(mail, F.lit("dd MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(mail, F.lit("dd MMM yyyy HH:mm Z"))))
    utc = F.to_timestamp_ntz(F.date_format(F.coalesce(zoned, mail), "yyyy-MM-dd HH:mm:ss"))
    known = F.coalesce(utc, times.from_paris(local))
    midnight = F.date_format(times.to_paris(known), "HH:mm:ss") == "00:00:00" if midnight_unknown else F.lit(False)
    alone = F.when(text.rlike(_DAY) & F.try_to_timestamp(text).isNotNull(), day).otherwise(F.when(midnight, times.paris_day(known)))
    from_day = times.from_paris(F.to_timestamp_ntz(F.concat(alone.cast("string"), F.lit(" " + noon))))
    return F.struct(F.when(alone.isNotNull(), from_day).otherwise(known).alias("at"), (alone.isNull() & known.isNotNull()).alias("time_known"))


def series_on_sale(openings: Column, now: datetime) -> Column:
    """Of the openings of a series' sessions: the earliest still to come, else the last."""
    n = times.stamp(now)
    return F.coalesce(F.array_min(F.filter(openings, lambda x: x > n)), F.array_max(openings))


def agreed_time(starts: Column) -> Column:
    """HH:MM in Paris if all sessions start then, else null."""
    hours = F.array_distinct(F.transform(starts, lambda x: F.date_format(times.to_paris(x), "HH:mm")))
    return F.when(F.size(hours) == 1, hours[0])
