"""Validation, quality score and status of records; categories from words."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text, times

# What each soft reason costs, the publishing threshold and the limits.
PENALTIES = {"no_image": 20, "short_description": 15, "time_unknown": 10, "price_unknown": 10, "venue_not_geocoded": 15, "no_category": 10, "no_venue": 15, "sold_out": 0, "institutional": 15}
PUBLISH = 50
MOST_CENTS = 50_000
DEPARTMENTS = ("75", "92", "93", "94")
AHEAD, SPAN, GRACE = timedelta(days=548), timedelta(days=400), timedelta(hours=6)
# Administrative subjects, folded.
INSTITUTIONAL = r"\b(mairie|forum (des )?seniors?|permanence|metiers de la ville|conversation (en |anglaise|espagnol)|cafe (linguistique|des langues)|reunion (publique|d'information)|job ?dating|recrutement|conseil (de quartier|municipal|d'arrondissement)|atelier numerique|aide aux devoirs|soutien scolaire|demarches|assemblee generale|webinaire|networking|salon de l'emploi)\b"

# Titles that say nothing, and names of venues that are none, folded.
JUNK = r"^(untitled|sans titre|test|tbd|tba|null|none|undefined|evenement|event|concert|spectacle|exposition|soiree|seance|[\W\d_]+)$"
PLACEHOLDER = (
    r"^\s*(a venir|a definir|a confirmer|a determiner|tba|tbc|tbd|n/?a|nc|non communique\w*|lieu (a venir|a definir|a confirmer|secret|communique\w*|precise\w*|surprise)|secret location"
    r"|adresse (secrete|communiquee\w*|transmise\w*|envoyee\w*|precisee\w*|donnee\w*)\b.*|lieu (communique|transmis|precise|envoye|donne)\w* (a|apres|lors|par|aux|sur)\b.*"
    r"|.*\b(communique|transmis|envoye|precise)e?s? (a|apres|lors de) l'?\s*inscription\b.*|en ligne|online|visioconference)\s*$"
)
# Towns and countries that are certainly out of the zone, folded.
FAR_PLACES = (
    "marseille", "lyon", "lille", "bordeaux", "toulouse", "nantes", "nice", "strasbourg", "montpellier", "rennes", "reims", "rouen", "le havre", "grenoble", "dijon", "angers", "nimes", "avignon", "tours", "orleans", "amiens", "metz", "nancy", "caen", "brest",
    "limoges", "clermont-ferrand", "perpignan", "besancon", "annecy", "la rochelle", "aix-en-provence", "cannes", "toulon", "poitiers", "pau", "bayonne", "biarritz", "deauville", "chartres", "beauvais", "compiegne", "chantilly", "fontainebleau", "versailles",
    "belgique", "bruxelles", "suisse", "geneve", "lausanne", "luxembourg", "canada", "quebec", "montreal", "allemagne", "berlin", "londres", "london", "espagne", "italie", "slovenie", "pays-bas", "amsterdam", "royaume-uni", "etats-unis", "new york",
)


def placeholder_venue(name: Column) -> Column:
    """Whether a venue's name is none: 'Adresse communiquée à l'inscription', 'Lieu secret', 'à venir'."""
    return F.coalesce(F.replace(text.fold(name), F.lit("’"), F.lit("'")).rlike(PLACEHOLDER), F.lit(False))


def far_place(name: Column, address: Column, city: Column) -> Column:
    """Whether the town, or what follows the last comma of the address or name, is certainly out of the zone; streets called like a town are not."""
    tail = lambda c: F.regexp_replace(F.trim(F.element_at(F.split(text.fold(c), ","), -1)), r"^\d{4,5}\s+", "")
    hits = [F.trim(F.replace(text.fold(city), F.lit("cedex"), F.lit(""))), tail(address), tail(name)]
    return F.coalesce(hits[0].isin(*FAR_PLACES), F.lit(False)) | F.coalesce(hits[1].isin(*FAR_PLACES), F.lit(False)) | F.coalesce(hits[2].isin(*FAR_PLACES), F.lit(False))


def _span(t: timedelta) -> Column:
    return F.expr(f"interval '{int(t.total_seconds())}' second")


def hard_reasons(now: datetime) -> Column:
    """array<string> of what forbids a record (over title, dates, prices, place, flags)."""
    c, n = F.col, times.stamp(now)
    start, end = c("start_date"), c("end_date")
    title = F.trim(F.coalesce("title", F.lit("")))
    checks = [
        (title == "", "no_title"), ((title != "") & ((F.length(title) < 3) | text.fold(title).rlike(JUNK)), "junk_title"), (start.isNull(), "no_start_date"),
        (F.coalesce(end, start + F.expr("interval '3' hour")) < n - _span(GRACE), "ended"), (start > n + _span(AHEAD), "too_far_ahead"), (end < start, "end_before_start"),
        ((end >= start) & (end > start + _span(SPAN)), "span_too_long"), ((c("price_max") > MOST_CENTS) | (c("price_min") > MOST_CENTS), "price_outlier"),
        ((c("price_min") < 0) | ((c("price_max") != 0) & (c("price_min") > c("price_max"))), "price_inconsistent"), (c("is_free") & ((c("price_min") > 0) | (c("price_max") > 0)), "free_with_price"),
        ((c("lat").isNotNull() & c("lng").isNotNull() & ~geo.in_box(c("lat"), c("lng"))) | ~F.substring("zip_code", 1, 2).isin(*DEPARTMENTS), "out_of_zone"), (c("is_online"), "online"), (c("is_cancelled"), "cancelled"),
        (placeholder_venue(c("venue_name")), "placeholder_venue"),
    ]
    return F.array_compact(F.array(*(F.when(ok, name) for ok, name in checks)))


def soft_reasons() -> Column:
    c = F.col
    checks = [
        (c("image_url").isNull(), "no_image"), (F.length(F.coalesce("description", F.lit(""))) < 80, "short_description"), (~c("time_known"), "time_unknown"), (c("price_status") == "unknown", "price_unknown"),
        (c("venue_name").isNull(), "no_venue"), (c("venue_name").isNotNull() & (c("lat").isNull() | c("lng").isNull()), "venue_not_geocoded"), (c("category_slug").isNull(), "no_category"),
        (text.fold(c("title")).rlike(INSTITUTIONAL), "institutional"), (c("is_sold_out"), "sold_out"),
    ]
    return F.array_compact(F.array(*(F.when(ok, name) for ok, name in checks)))


def score(soft: Column) -> Column:
    cost = F.create_map(*(F.lit(x) for kv in PENALTIES.items() for x in kv))
    return F.greatest(F.lit(0), F.lit(100) - F.aggregate(soft, F.lit(0), lambda a, r: a + F.coalesce(cost[r], F.lit(5))))


def status(hard: Column, points: Column) -> Column:
    """Cancelled; expired if the only objection is that it ended; rejected; else active from the threshold."""
    return F.when(F.array_contains(hard, "cancelled"), "cancelled").when((F.size(hard) == 1) & F.array_contains(hard, "ended"), "expired").when(F.size(hard) > 0, "rejected").when(points >= PUBLISH, "active").otherwise("draft")


def validated(rows: DataFrame, now: datetime) -> DataFrame:
    out = rows.withColumn("hard", hard_reasons(now)).withColumn("soft", soft_reasons())
    out = out.withColumn("score", score(F.col("soft")))
    return out.withColumn("status", status(F.col("hard"), F.col("score")))


def promoted(rows: DataFrame) -> DataFrame:
    """Rows whose venue has been located since: fifteen points back, published from the threshold if nothing forbids it."""
    found = F.array_contains("soft", "venue_not_geocoded") & F.col("lat").isNotNull()
    points = F.when(found, F.least(F.col("score") + 15, F.lit(100))).otherwise(F.col("score"))
    published = found & (F.col("status") == "draft") & (points >= PUBLISH) & (F.size("hard") == 0)
    # all at once: each looks at the score as it was
    return rows.withColumns({"score": points, "status": F.when(published, "active").otherwise(F.col("status")), "soft": F.when(found, F.array_remove("soft", "venue_not_geocoded")).otherwise(F.col("soft"))})


def category(words: Column, vocabulary: dict[str, str], priority: list[str]) -> Column:
    """The category whose pattern occurs most in folded text; the priority decides ties; null if none occurs."""
    best = F.array(*(F.struct(F.regexp_count(words, F.lit(vocabulary[k])).alias("n"), F.lit(-i).alias("p"), F.lit(k).alias("k")) for i, k in enumerate(priority)))
    top = F.array_max(best)
    return F.when(top["n"] > 0, top["k"])
