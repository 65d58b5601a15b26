"""French dates in text, as Columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .text import let

# Months by name, without accents, with their short forms.
MONTHS = {
    "janvier": 1, "janv": 1, "jan": 1, "fevrier": 2, "fevr": 2, "fev": 2, "mars": 3, "mar": 3, "avril": 4, "avr": 4, "mai": 5, "juin": 6, "juillet": 7, "juil": 7,
    "aout": 8, "septembre": 9, "sept": 9, "sep": 9, "octobre": 10, "oct": 10, "novembre": 11, "nov": 11, "decembre": 12, "dec": 12,
}
GRACE_DAYS = 30
_MONTH = "|".join(sorted(MONTHS, key=lambda m: (-len(m), m)))
#: Days before a month's name share it: "12 et 13 mars", "du 3 au 9 mai".
_WORDED = rf"((?:\b\d{{1,2}}(?:er)?\s*(?:,|-|et|au|a)\s*(?:le\s+)?)*\b\d{{1,2}}(?:er)?)\s+({_MONTH})\b\.?(?:\s+(\d{{4}}))?"
_SLASHED = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
_WRITTEN = r"\b(\d{4})-(\d{2})-(\d{2})\b"
_LENGTH = r"\bduree\s*:?\s*\d+\s*h(?:\s*\d+)?|\b\d+\s*h\s*\d*\s*de spectacle"
_CLOCK = r"\b([01]?\d|2[0-3])\s*(?:h|:)\s*([0-5]\d)?(?!\d)(?!\s*€)"


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date, or null if there is none such."""
    return F.try_to_date(F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string")), "y-M-d")


def _next(month: Column, day: Column, today: date) -> Column:
    """This year's date, or next year's if it is over by more than the grace."""
    this = _day(F.lit(today.year), month, day)
    late = this < F.date_sub(F.lit(today), GRACE_DAYS)
    return F.when(late, _day(F.lit(today.year + 1), month, day)).otherwise(F.coalesce(this, _day(F.lit(today.year + 1), month, day)))


def dates(c: Column, today: date) -> Column:
    """struct(start, end, time) of "12 et 13 mars à 20h30", "du 3 au 9 mai 2026", "jusqu'au 4 juin", "05/06/2026": Paris days, and HH:MM or null.

    ``end`` is null for one day. A date without a year is the next one, with a grace for those just over. Lengths ("durée 1h30") are no times.
    """
    number = F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv))

    def group(m: Column, pattern: str, i: int) -> Column:
        return F.regexp_extract(m, pattern, i)

    def worded(m: Column) -> Column:
        month, year = number[group(m, _WORDED, 2)], F.nullif(group(m, _WORDED, 3), F.lit(""))
        days = F.regexp_extract_all(group(m, _WORDED, 1), F.lit(r"\d{1,2}"), 0)
        return F.transform(days, lambda d: F.when(year.isNotNull(), _day(year, month, d)).otherwise(_next(month, d, today)))

    def read(t: Column) -> Column:
        found = lambda p: F.regexp_extract_all(t, F.lit(p), 0)
        every = F.concat(
            F.flatten(F.transform(found(_WORDED), worded)), F.transform(found(_SLASHED), lambda m: _day(group(m, _SLASHED, 3), group(m, _SLASHED, 2), group(m, _SLASHED, 1))),
            F.transform(found(_WRITTEN), lambda m: _day(group(m, _WRITTEN, 1), group(m, _WRITTEN, 2), group(m, _WRITTEN, 3))),
        )
        hour, minute = F.regexp_extract(t, _CLOCK, 1), F.regexp_extract(t, _CLOCK, 2)
        clock = F.when(hour != "", F.concat(F.lpad(hour, 2, "0"), F.lit(":"), F.when(minute != "", minute).otherwise("00")))
        until = t.rlike(r"\bjusqu'au\b")

        def span(days: Column) -> Column:
            first, last = F.array_min(days), F.array_max(days)
            open_ = until & (first == last)
            start = F.when(open_, F.least(F.lit(today), last)).otherwise(first)
            return F.struct(start.alias("start"), F.when(last != start, last).alias("end"), clock.alias("time"))

        return let(F.array_compact(every), span)

    plain = F.replace(text.fold_ligatures(F.coalesce(c, F.lit(""))), F.lit("’"), F.lit("'"))
    return let(F.regexp_replace(plain, _LENGTH, " "), read)
