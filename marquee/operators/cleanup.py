"""Cleanups of stored rows as a table of rules.

A rule says on which rows it acts, what it changes there, and the reason that it
leaves. Rules act in their order, each on what the ones before left; all of them
are one projection, whatever their number, as a row is carried through them as
one struct. Each row tells which rules acted on it. No rule deletes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text, times
from ..functions.text import let

Row = Column
FIELDS = {
    "source": "string", "title": "string", "description": "string", "start_date": "timestamp_ntz", "end_date": "timestamp_ntz", "time_known": "boolean", "status": "string", "price_status": "string", "price_min": "int", "price_max": "int", "is_free": "boolean",
    "reasons": "array<string>", "last_seen_at": "timestamp_ntz", "venue_id": "long", "venue_name": "string", "venue_address": "string", "city": "string", "zip_code": "string", "arrondissement": "string", "lat": "double", "lng": "double", "geocode_status": "string", "has_activity": "boolean",
}
# Limits of prices (cents), the middle of the city that failed lookups give, departments, towns far away, business words, and placeholders of venues.
HIGH_PRICE, ABSURD_PRICE, MIDDLE = 30_000, 100_000, (48.857, 2.352)
DEPARTMENTS = ("75", "92", "93", "94")
FAR_NAMES = r"marseille|lyon|lille|bordeaux|toulouse|nantes|nice|strasbourg|montpellier|rennes|reims|rouen|grenoble|dijon|angers|avignon|tours|orl[eé]ans|amiens|metz|nancy|caen|brest|limoges|bruxelles|gen[eè]ve|lausanne|montr[eé]al|londres|london|berlin|amsterdam"
FAR_CITIES = FAR_NAMES + r"|ixelles|ljubljana"
BUSINESS = r"career fair|job fair|salon de l'emploi|recrutement|networking|venture capital|investor|startup pitch|webinar|formation certifiante|masterclass business"
NO_VENUE = (
    r"^\s*(a venir|a definir|a confirmer|tba|tbc|tbd|lieu secret|secret location|adresse secrete)\s*$|(adresse|lieu)\s+(communiquee?s?|transmise?s?|envoyee?s?|precisee?s?|donnee?s?)\s+(a|apres|lors|aux|par|sur)\b"
    r"|(communiquee?s?|transmise?s?|envoyee?s?|precisee?s?)\s+(a|apres|lors de)\s+l.?\s*inscription"
)
NO_ADDRESS = r"^\s*(a venir|a definir|tba|tbc)\s*$"
CALLED_OFF = r"annul[ée]e?s?|cancell?ed"
WHAT_IS_CALLED_OFF = r"concerts?|spectacles?|shows?|dates?|repr[ée]sentations?|[ée]v[ée]nements?|soir[ée]es?|matchs?"
PRICE_IN_TEXT = r"[0-9]+([.,][0-9]{1,2})?\s*(€|eur)"


@dataclass(frozen=True)
class Rule:
    """name; the rows it acts on; new values by column; the reason it adds; spares: not on rows that members saved, went to or reviewed."""

    name: str
    when: Callable[[Row], Column]
    then: dict[str, Callable[[Row], Column]] = field(default_factory=dict)
    reason: str | None = None
    spares: bool = False


def _is(*states: str) -> Callable[[Row], Column]:
    return lambda r: r["status"].isin(*states)


def _has(r: Row, reason: str) -> Column:
    return F.array_contains(r["reasons"], reason)


def _value(x) -> Callable[[Row], Column]:
    return lambda r: F.lit(x)


_UNPRICED = {"price_status": _value("unknown"), "price_min": _value(0), "price_max": _value(0), "is_free": _value(False)}
_REJECTED = {"status": _value("rejected")}
_DRAFT = {"status": _value("draft")}
_OPEN = _is("active", "draft")


def _from_zip(r: Row) -> Column:
    return text.arrondissement(r["zip_code"])


def _zip(r: Row) -> Column:
    """Five digits in a text, with a space after the second or not; one zero too many; else nothing."""
    joined = F.regexp_replace(r["zip_code"], r"(\d{2})\s(\d{3})", "$1$2")
    five = F.regexp_extract(joined, r"(?:^|\D)(\d{5})(?:\D|$)", 1)
    return F.when(five != "", five).when(r["zip_code"].rlike(r"^750(0\d{2}|1[01]\d)$"), F.concat(F.lit("75"), F.substr(r["zip_code"], F.lit(4))))


def _in_departments(r: Row) -> Column:
    return F.coalesce(F.substring(r["zip_code"], 1, 2).isin(*DEPARTMENTS), F.lit(False))


def _clock(r: Row) -> Column:
    return F.date_format(times.to_paris(r["start_date"]), "HH:mm:ss")


def _out_of_zone(r: Row) -> Column:
    other = r["zip_code"].rlike(r"^\d{5}$") & ~_in_departments(r)
    away = r["lat"].isNotNull() & ~geo.in_box(r["lat"], r["lng"]) & ~_in_departments(r)
    said = r["venue_name"].rlike(rf"(?iu),\s*({FAR_NAMES})\s*$") | r["city"].rlike(rf"(?iu)^\s*({FAR_CITIES})\s*$")
    return reduce(Column.__or__, (F.coalesce(x, F.lit(False)) for x in (other, away, said)))


def _called_off(r: Row) -> Column:
    marks = (rf"^\s*({CALLED_OFF})\s*!?\s*[-–—:|•·/]", rf"^\s*({CALLED_OFF})\s+\S", rf"[-–—:|•·/,]\s*({CALLED_OFF})\s*!?\s*$", rf"[(\[]\s*({CALLED_OFF})\s*!?\s*[)\]]", r"\sannul[ée]e?s?\s*:", rf"\b({WHAT_IS_CALLED_OFF})\s+((est|sont)\s+)?annul[ée]e?s?(?![\p{{L}}\d])")
    return reduce(Column.__or__, (r["title"].rlike(f"(?iu){m}") for m in marks))


def _no_venue(r: Row) -> Column:
    return F.coalesce(text.fold(r["venue_name"]).rlike(NO_VENUE), F.lit(False)) | F.coalesce(text.fold(r["venue_address"]).rlike(NO_ADDRESS), F.lit(False))


def rules(now: datetime) -> list[Rule]:
    """What was put in order over time, in that order."""
    n = times.stamp(now)
    hours = lambda k: F.expr(f"interval '{k}' hour")
    midnight = lambda r: (F.date_format(r["start_date"], "HH:mm:ss") == "00:00:00") | (_clock(r) == "00:00:00")
    swapped = {"price_min": lambda r: r["price_max"], "price_max": lambda r: r["price_min"]}
    priced = {"price_status": lambda r: F.when(r["is_free"], "free").when((r["price_max"] > 0) | (r["price_min"] > 0), "paid").otherwise("unknown")}
    overnight = lambda r: (r["end_date"] < r["start_date"]) & (r["end_date"] + hours(24) > r["start_date"])
    as_paris = {"start_date": lambda r: times.from_paris(r["start_date"]), "end_date": lambda r: times.from_paris(r["end_date"])}
    over = lambda r: F.coalesce(r["end_date"], r["start_date"] + hours(3)) < n - hours(6)
    return [
        Rule("price_status", lambda r: (r["price_status"] == "unknown") & (F.coalesce(r["is_free"], F.lit(False)) | (r["price_max"] > 0) | (r["price_min"] > 0)), priced), Rule("price_order", lambda r: r["price_min"] > r["price_max"], swapped),
        Rule("overnight", overnight, {"end_date": lambda r: r["end_date"] + hours(24)}), Rule("end_before_start", lambda r: r["end_date"] < r["start_date"], {"end_date": _value(None)}), Rule("date_only", lambda r: r["time_known"] & midnight(r), {"time_known": _value(False)}),
        Rule("arrondissement", lambda r: r["arrondissement"].isNull() & r["zip_code"].rlike(r"^75(0(0[1-9]|1[0-9]|20)|116)$"), {"arrondissement": _from_zip}),
        Rule("middle_of_the_city", lambda r: (F.round(r["lat"], 3) == MIDDLE[0]) & (F.round(r["lng"], 3) == MIDDLE[1]), {"lat": _value(None), "lng": _value(None), "geocode_status": _value("pending")}),
        Rule("geocoded", lambda r: r["lat"].isNotNull() & r["lng"].isNotNull() & (r["geocode_status"] == "pending"), {"geocode_status": _value("ok")}),
        Rule("zone_of_open_data", lambda r: (r["source"] == "paris_opendata") & r["last_seen_at"].isNull() & ~_has(r, "tz_fixed"), as_paris, "tz_fixed"), Rule("expired", lambda r: _is("active")(r) & over(r), {"status": _value("expired")}),
        Rule("editorial", lambda r: (r["source"] == "lebonbon") & r["venue_id"].isNull() & _is("active", "draft", "expired")(r), _REJECTED, "editorial_not_event"),
        Rule("out_of_region", lambda r: r["venue_id"].isNotNull() & _OPEN(r) & r["lat"].isNotNull() & ~geo.in_box(r["lat"], r["lng"], geo.REGION), _REJECTED, "out_of_zone"),
        Rule("business", lambda r: _OPEN(r) & (r["source"] == "eventbrite") & r["title"].rlike(f"(?iu)({BUSINESS})"), _REJECTED, "off_topic_business"), Rule("not_free", lambda r: (r["source"] == "infoconcert") & r["is_free"] & r["description"].rlike(PRICE_IN_TEXT), _UNPRICED, "free_flag_corrected"),
        Rule("high_price", lambda r: _is("active")(r) & (r["price_max"] > HIGH_PRICE), _DRAFT, "price_outlier"), Rule("too_long", lambda r: _is("active")(r) & (r["end_date"] > r["start_date"] + hours(24 * 400)), _DRAFT, "duration_outlier"),
        Rule("zip_code", lambda r: r["zip_code"].isNotNull() & ~r["zip_code"].rlike(r"^\d{5}$"), {"zip_code": _zip}), Rule("arrondissement_again", lambda r: r["arrondissement"].isNull() & r["zip_code"].rlike(r"^75(0(0[1-9]|1[0-9]|20)|116)$"), {"arrondissement": _from_zip}),
        Rule("placeholder_venue", lambda r: r["venue_id"].isNotNull() & _OPEN(r) & ~_has(r, "placeholder_venue") & _no_venue(r), _REJECTED, "placeholder_venue", spares=True),
        Rule("out_of_zone", lambda r: r["venue_id"].isNotNull() & _OPEN(r) & ~_has(r, "out_of_zone") & _out_of_zone(r), _REJECTED, "out_of_zone", spares=True), Rule("called_off", lambda r: _OPEN(r) & ~_has(r, "title_cancelled") & _called_off(r), {"status": _value("cancelled")}, "title_cancelled", spares=True),
        Rule("absurd_price", lambda r: (r["price_max"] > ABSURD_PRICE) & (r["price_status"] != "unknown") & _OPEN(r), _UNPRICED, "price_reset"),
        Rule("no_time_given", lambda r: r["time_known"] & _OPEN(r) & _clock(r).isin("00:00:00", "23:59:00"), {"time_known": _value(False), "reasons": lambda r: F.array_union(r["reasons"], F.array(F.lit("time_unknown")))}),
    ]


def cleaned(rows: DataFrame, table: list[Rule]) -> DataFrame:
    """rows with the columns of FIELDS (those that are missing are null, ``reasons`` empty) as the rules leave them, and ``cleaned_by``, the names of the rules that acted, in order.

    A rule whose condition is unknown on a row does not act there.
    """
    have = {f.lower() for f in rows.columns}
    given = {f: F.col(f"`{f}`") if f in have else F.lit(None) for f in FIELDS}
    given["reasons"] = F.coalesce(given["reasons"].cast("array<string>"), F.array().cast("array<string>"))
    kind = "struct<" + ", ".join(f"{f}: {k}" for f, k in FIELDS.items()) + ", cleaned_by: array<string>>"
    start = F.struct(*(given[f].cast(k).alias(f) for f, k in FIELDS.items()), F.array().cast("array<string>").alias("cleaned_by")).cast(kind)

    def step(rule: Rule) -> Callable[[Row], Row]:
        def run(r: Row) -> Row:
            acts = F.coalesce(rule.when(r), F.lit(False))
            if rule.spares:
                acts = acts & ~F.coalesce(r["has_activity"], F.lit(False))
            new = {f: rule.then[f](r).cast(FIELDS[f]) if f in rule.then else r[f] for f in FIELDS}
            if rule.reason:
                new["reasons"] = F.array_append(r["reasons"], rule.reason)
            return F.when(acts, F.struct(*(c.alias(f) for f, c in new.items()), F.array_append(r["cleaned_by"], rule.name).alias("cleaned_by")).cast(kind)).otherwise(r)

        return run

    out = reduce(let, map(step, table), start)
    own = [c for c in rows.columns if c.lower() not in FIELDS and c.lower() != "cleaned_by"]
    return rows.withColumn("_cleaned", out).select(*(F.col(f"`{c}`") for c in own), "_cleaned.*")


def counts(done: DataFrame) -> DataFrame:
    """(rule, n) of the rules that acted."""
    return done.select(F.explode("cleaned_by").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
