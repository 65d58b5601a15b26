"""Listings: a query specification becomes one predicate, a ranking and a page."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text, times

# Patterns over folded title, description and keywords; categories that match too; patterns that exclude.
INTENTS: dict[str, tuple[str, tuple[str, ...], str | None]] = {
    "en-amoureux": ("jazz|piano|recital|lyrique|opera|quatuor|chanson|tango|nocturne|degustation|croisiere|bal |cabaret|romanti|poesie", ("danse", "theatre"), "enfant|jeune public|bebe|famille"),
    "entre-amis": ("soiree|dj|concert|festival|humour|stand-?up|impro|quiz|karaoke|blind test|bal |guinguette|apero|jam", ("concerts", "festivals", "spectacles"), "bebe|tout-petits|conference"),
    "en-famille": ("enfant|famille|familial|jeune public|kids|des [0-9]+ ans|a partir de [0-9]+ ans|conte|marionnette|gouter|tout-petits|bebe", (), None),
    "insolite": ("insolite|immersi|secret|etonnant|atypique|curieux|curiosit|nocturne|souterrain|catacombe|escape|realite virtuelle|inedit|mystere", (), None),
    "plein-air": ("plein air|plein-air|jardin|parc |square|exterieur|balade|promenade|rooftop|guinguette|en terrasse|berges|canal|bois de", ("visites",), None),
    "festif": ("soiree|dj|clubbing|electro|fete|party|bal |guinguette|dancefloor|techno|house|disco|carnaval", (), "enfant|jeune public"),
    "culture-pointue": ("conference|rencontre|debat|lecture|philosoph|histoire de l|masterclass|colloque|projection-debat|seminaire|contemporain", ("conferences",), None),
    "chill": ("exposition|jazz|acoustique|lecture|jardin|musee|piano|meditation|calme|douceur", ("expos",), "dj|clubbing|techno"),
}
# Topics, as intents.
TOPICS = {"humour": ("stand.?up|humour|humoriste|comedy|comique|one.?man|one.?woman|seul.?en.?scene|impro|sketch", (), "enfant|jeune public")}
# Categories.
CATEGORIES = "concerts expos theatre spectacles danse cinema festivals conferences ateliers visites soirees sport".split()
OUTINGS = ("concerts", "expos", "theatre", "spectacles", "danse", "festivals")
CLASSES = ("ateliers", "conferences", "visites")
FILMS = "cinema"


@dataclass(frozen=True)
class EventQuery:
    """What a listing asks for; an unset field asks for nothing."""

    when: str | None = None
    categories: tuple[str, ...] = ()
    exclude_categories: tuple[str, ...] = ()
    exclude_title: str | None = None
    arrondissements: tuple[str, ...] = ()
    free: bool = False
    max_price: float | None = None  # euros
    runs_ending_within_days: int | None = None
    one_off_only: bool = False
    with_image: bool = False
    venue_slug: str | None = None
    signature_only: bool = False
    ids: tuple | None = None
    exclude_ids: tuple = ()
    intents: tuple[str, ...] = ()
    topics: tuple[str, ...] = ()
    q: str | None = None
    near: tuple[float, float, float] | None = None  # lat, lng, km
    sort: str | None = None
    limit: int = 24
    offset: int = 0
    group_films: bool | None = None


# The named collections are stored queries.
NAMED = {
    "tonight": EventQuery(when="tonight"), "weekend": EventQuery(when="weekend"), "free": EventQuery(when="week", free=True),
    "top": EventQuery(when="week", with_image=True, sort="popular", limit=8), "surprise": EventQuery(sort="random", limit=1),
    "newsletter": EventQuery(when="week", with_image=True, one_off_only=True), "last-chance": EventQuery(runs_ending_within_days=14, sort="ending"),
    "outdoors": EventQuery(when="week", intents=("plein-air",)), "laughs": EventQuery(when="week", topics=("humour",)),
}


def with_dims(outings: DataFrame, venues: DataFrame, categories: DataFrame) -> DataFrame:
    """The read join: dimensions to the left-joined facts. Spark broadcasts a dimension only under its size threshold."""
    return outings.join(venues, "venue_id", "left").join(categories, "category_id", "left")


def live(now: datetime) -> Column:
    c = F.col
    return (c("status") == "active") & c("canonical_id").isNull() & (times.effective_end(c("start_date"), c("end_date")) >= times.stamp(now))


def search_text() -> Column:
    return text.fold(F.concat_ws(" ", F.col("title"), F.coalesce("short_desc", F.lit("")), F.coalesce("keywords", F.lit(""))))


def matches(pattern: str) -> Column:
    """A pattern in the event's text or its venue's name."""
    return search_text().rlike(pattern) | F.coalesce(text.fold(F.col("venue_name")).rlike(pattern), F.lit(False))


def rule(pattern: str, categories: tuple[str, ...] = (), exclude: str | None = None) -> Column:
    hit = matches(pattern)
    if categories:
        hit = hit | F.coalesce(F.col("category_slug").isin(*categories), F.lit(False))
    return hit & ~matches(exclude) if exclude else hit


def condition(query: EventQuery, now: datetime, signature: str | None = None) -> Column:
    """All of a query as one predicate over with_dims(); signature: pattern of folded names of venues of note."""
    c = F.col
    start, end, cat = c("start_date"), c("end_date"), c("category_slug")
    long_ = times.long_run(start, end)
    terms = [live(now)]
    w = times.window(query.when, now)
    if w:
        terms.append(times.in_window(start, end, w, now))
        if w.key == "tonight":
            weeks = end.isNotNull() & (end > start + F.expr("interval '60' day"))
            terms.append(~(weeks & (cat.isNull() | cat.isin(*CLASSES))))
    if query.categories:
        terms.append(cat.isin(*query.categories))
    if query.exclude_categories:
        terms.append(cat.isNull() | ~cat.isin(*query.exclude_categories))
    if query.exclude_title is not None:
        terms.append(F.lower("title") != query.exclude_title.lower())
    if query.arrondissements:
        terms.append(c("arrondissement").isin(*query.arrondissements))
    if query.free:
        terms.append(c("price_status") == "free")
    if query.max_price is not None and query.max_price >= 0:
        terms.append((c("price_status") == "free") | ((c("price_status") == "paid") & (c("price_min") <= int(query.max_price * 100 + 0.5))))
    if query.runs_ending_within_days:
        terms += [long_, end <= times.stamp(now + timedelta(days=query.runs_ending_within_days))]
    if query.one_off_only:
        terms.append(~long_)
    if query.with_image:
        terms.append(c("image_url").isNotNull())
    if query.venue_slug:
        terms.append(c("venue_slug") == query.venue_slug)
    if query.signature_only:
        terms.append(of_note(signature))
    if query.ids is not None:
        terms.append(c("id").isin(*query.ids) if query.ids else F.lit(False))
    if query.exclude_ids:
        terms.append(~c("id").isin(*query.exclude_ids))
    terms += [rule(*INTENTS[i]) for i in query.intents if i in INTENTS]
    terms += [rule(*TOPICS[t]) for t in query.topics if t in TOPICS]
    for t in text.search_tokens(query.q or ""):
        terms.append(matches(rf"\b{re.escape(t)}\b" if t in text.WHOLE_WORDS else re.escape(t)))
    if query.near:
        terms.append(geo.near(c("lat"), c("lng"), *query.near))
    return reduce(Column.__and__, terms)


def of_note(signature: str | None) -> Column:
    return F.coalesce(text.fold(F.col("venue_name")).rlike(signature), F.lit(False)) if signature else F.lit(False)


def relevance(now: datetime, signature: str | None = None) -> Column:
    """Ten terms: quality, place, venue, category, popularity, picture, known time and price, length, nearness in time."""
    c = F.col
    in_paris = c("arrondissement").isNotNull() | F.coalesce(c("zip_code").startswith("75"), F.lit(False))
    days = times.seconds_between(c("start_date"), times.stamp(now)) / 86_400
    terms = [
        c("quality_score").cast("double"), F.when(c("venue_name").isNull(), -4).when(in_paris, 0).otherwise(-10), F.when(of_note(signature), 6).otherwise(0),
        F.when(c("category_slug").isin(*OUTINGS), 4).when(c("category_slug").isNull(), -4).otherwise(0),
        F.least(c("save_count") * 3 + F.floor(c("view_count") / 25), F.lit(25)), F.when(c("image_url").isNull(), -25).otherwise(0), F.when(c("time_known"), 0).otherwise(-8),
        F.when(c("price_status") == "unknown", -4).otherwise(0), F.when(times.long_run(c("start_date"), c("end_date")), -6).otherwise(0),
        -F.least(F.greatest(days, F.lit(0.0)), F.lit(30.0)) * 0.8,
    ]
    return reduce(Column.__add__, terms)


def ordering(query: EventQuery, now: datetime, signature: str | None = None) -> list[Column]:
    c = F.col
    w = times.window(query.when, now)
    sort = query.sort or ("distance" if query.near else "relevance")
    by = {
        "soon": lambda: [F.when(c("start_date") < times.stamp(w.start if w else now), 1).otherwise(0), c("start_date").asc()],
        "popular": lambda: [(c("save_count") * 3 + c("view_count")).desc()],
        "ending": lambda: [times.effective_end(c("start_date"), c("end_date")).asc()],
        "distance": lambda: [geo.flat_km(c("lat"), c("lng"), *query.near[:2]).asc(), c("start_date").asc()] if query.near else [],
        "random": lambda: [F.md5(F.concat(c("id").cast("string"), F.lit(str(int(now.timestamp()) // 3600))).cast("binary"))],
    }.get(sort, lambda: [F.round(relevance(now, signature), 6).desc()])()
    return [*by, c("id").asc()]


def films(rows: DataFrame) -> DataFrame:
    """One row a film key of the screenings in rows: the next one stands for it, with counts, next times and an image."""
    at = F.struct("start_date", "id")
    seen = rows.where(F.col("category_slug") == FILMS).withColumn("film_key", text.slug(F.col("title")))
    return seen.groupBy("film_key").agg(
        F.min(at).getField("id").alias("film_best"), F.count(F.lit(1)).alias("film_n"), F.countDistinct("venue_id").alias("film_m"),
        F.slice(F.array_sort(F.collect_list("start_date")), 1, 4).alias("film_times"),
        F.min_by("image_url", F.when(F.col("image_url").isNotNull(), at)).alias("film_image"),
    )


def listing(rows: DataFrame, query: EventQuery, now: datetime, signature: str | None = None) -> DataFrame:
    """The page of a query, one row more than its limit if there is more. rows: with_dims()."""
    found = rows.where(condition(query, now, signature))
    grouped = query.group_films if query.group_films is not None else not query.categories and query.ids is None
    if grouped:
        best = films(found).select(F.col("film_best").alias("id"), "film_n", "film_m", "film_times", "film_image")
        found = found.join(best, "id", "left").where(~F.col("category_slug").eqNullSafe(FILMS) | F.col("film_n").isNotNull())
    page = found.orderBy(*ordering(query, now, signature))
    if query.offset > 0:
        page = page.offset(query.offset)
    return page.limit(min(max(query.limit, 1), 100) + 1)


def total(rows: DataFrame, query: EventQuery, now: datetime) -> DataFrame:
    """How many cards a query has, films counted once."""
    is_film = F.coalesce(F.col("category_slug") == FILMS, F.lit(False))
    return rows.where(condition(query, now)).agg((F.count_if(~is_film) + F.count_distinct(F.when(is_film, text.slug(F.col("title"))))).alias("total"))


def card(rows: DataFrame) -> DataFrame:
    """Rows of a listing as nested cards."""
    c = F.col
    town = F.when(c("arrondissement").isNull() & ~F.coalesce(c("zip_code").startswith("75"), F.lit(False)), c("city"))
    return rows.select(
        "id", "slug", "title", "short_desc", F.coalesce("image_url", *(["film_image"] if "film_image" in rows.columns else [])).alias("image_url"), "start_date", "end_date",
        F.coalesce("time_known", F.lit(True)).alias("time_known"), F.coalesce("price_min", F.lit(0)).alias("price_min"), F.coalesce("price_max", F.lit(0)).alias("price_max"),
        F.coalesce("price_status", F.lit("unknown")).alias("price_status"),
        F.when(c("category_slug").isNotNull(), F.struct(c("category_slug").alias("slug"), c("category_name").alias("name"))).alias("category"),
        F.when(c("venue_name").isNotNull(), F.struct(c("venue_name").alias("name"), c("venue_slug").alias("slug"), "arrondissement", town.alias("city"), "lat", "lng")).alias("venue"),
    )


def merged(user: EventQuery, fixed: EventQuery) -> EventQuery:
    """A named view: its fixed part wins over what the user asks for."""
    base = EventQuery()
    return replace(user, **{k: v for k, v in fixed.__dict__.items() if v != getattr(base, k)})


# How many values a parameter may name, and what numbers may be.
MOST_NAMED = {"cat": 4, "arr": 6, "mood": 3, "topic": 2, "xcat": 4}
SORTS = ("relevance", "soon", "popular", "distance", "ending")
NEAR_BOX = (48.5, 49.2, 1.9, 2.9)  # lat, lng
RADIUS_KM = (0.5, 2.5, 15.0)  # least, usual, most
MOST_EUROS, MOST_RUN_DAYS, MOST_TEXT, MOST_PAGE, MOST_OFFSET = 500.0, 400, 120, 48, 2000


def _arrondissement(x: str) -> str | None:
    """1 to 20, as a number, an ordinal or a postcode, as an ordinal."""
    m = re.fullmatch(r"(?:750|751)?0?(\d{1,2})(?:er|e|[eè]me)?", x.lower())
    n = int(m.group(1)) if m else 0
    return None if not 1 <= n <= 20 else "1er" if n == 1 else f"{n}e"


def from_params(params: dict[str, str]) -> EventQuery:
    """URL parameters as a query: unknown values are left out, numbers clamped; date, category and ambiance are older names of when, cat and mood."""

    def named(key: str, known, older: str | None = None, read=lambda x: x) -> tuple[str, ...]:
        given = [read(x.strip()) for k in (key, older) if k for x in params.get(k, "").split(",")]
        return tuple(dict.fromkeys(x for x in given if x and (known is None or x in known)))[: MOST_NAMED[key]]

    def number(key: str) -> float | None:
        return float(params[key]) if re.fullmatch(r"\s*-?\d+(\.\d+)?\s*", params.get(key, "")) else None

    lat, lng, most, runs_ = (number(k) for k in ("lat", "lng", "max", "runs"))
    south, north, west, east = NEAR_BOX
    inside = lat is not None and lng is not None and south < lat < north and west < lng < east
    return EventQuery(
        when=params.get("when") or params.get("date"), categories=named("cat", CATEGORIES, "category"), exclude_categories=named("xcat", CATEGORIES), arrondissements=named("arr", None, read=_arrondissement),
        free=params.get("free") in ("1", "true"), max_price=min(most, MOST_EUROS) if most and most > 0 else None, intents=named("mood", INTENTS, "ambiance"), topics=named("topic", TOPICS), q=params.get("q", "").strip()[:MOST_TEXT] or None,
        near=(lat, lng, min(max(number("radius") or RADIUS_KM[1], RADIUS_KM[0]), RADIUS_KM[2])) if inside else None, sort=params.get("sort") if params.get("sort") in SORTS else None,
        runs_ending_within_days=int(min(runs_, MOST_RUN_DAYS)) if runs_ and runs_ > 0 else None, limit=int(min(max(number("limit") or 24, 1), MOST_PAGE)), offset=int(min(max(number("offset") or 0, 0), MOST_OFFSET)),
    )


def to_params(q: EventQuery) -> dict[str, str]:
    """The parameters that from_params() reads as q."""
    lists = {"cat": q.categories, "arr": q.arrondissements, "mood": q.intents, "topic": q.topics, "xcat": q.exclude_categories}
    out = {"when": q.when, **{k: ",".join(v) for k, v in lists.items()}, "free": "1" if q.free else None, "max": f"{q.max_price:g}" if q.max_price is not None and not q.free else None, "q": q.q}
    if q.near:
        out |= {"lat": f"{q.near[0]:.4f}", "lng": f"{q.near[1]:.4f}", "radius": f"{q.near[2]:g}" if q.near[2] != RADIUS_KM[1] else None}
    out |= {"sort": q.sort if q.sort != "relevance" else None, "runs": str(q.runs_ending_within_days) if q.runs_ending_within_days else None}
    return {k: v for k, v in out.items() if v}
