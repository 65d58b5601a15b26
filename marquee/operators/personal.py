"""Personal picks: what is known of a member, the plan that follows from it, candidates and reasons."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import listing as L
from . import members, relational

# What each archetype tends to like, the best first.
AFFINITIES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "explorateur-nocturne": (("concerts", "festivals", "expos"), ("festif", "insolite")), "esthete-confidentiel": (("expos", "theatre", "danse"), ("culture-pointue", "insolite")),
    "epicurien-social": (("spectacles", "concerts", "festivals"), ("entre-amis",)), "flaneur-curieux": (("expos", "visites", "festivals"), ("plein-air", "chill")),
    "fetard-culturel": (("concerts", "festivals", "spectacles"), ("festif", "entre-amis")), "intellectuel-engage": (("conferences", "theatre", "cinema"), ("culture-pointue",)),
    "romantique-parisien": (("concerts", "danse", "cinema"), ("en-amoureux", "chill")), "aventurier-creatif": (("ateliers", "expos", "danse"), ("insolite",)),
}
# Taste scores that speak for an intent: (score, at least, threshold, intent, weight); 50 where nothing is known.
SCORED = (("energy", True, 65, "festif", 1.5), ("energy", False, 35, "chill", 1.5), ("social", True, 70, "entre-amis", 1.0), ("exploration", True, 65, "insolite", 1.5), ("depth", True, 65, "culture-pointue", 1.5))
# Sentences of a summary by score: (score, from 70, to 30).
SENTENCES = (
    ("exploration", "Toujours en quête de nouveautés et de découvertes inattendues.", "Préfère les valeurs sûres et les lieux familiers."), ("energy", "Aime l’ambiance festive et les soirées à haute énergie.", "Recherche le calme et les moments contemplatifs."),
    ("social", "Adore sortir en bande.", "Apprécie les sorties en solo ou à deux."), ("budget", "Prêt·e à investir pour une belle expérience.", "Privilégie les bons plans et le gratuit."),
    ("mainstream", "Aime les grands rendez-vous incontournables.", "Attiré·e par la scène indépendante et les lieux confidentiels."), ("depth", "Cherche des sorties qui font réfléchir.", "Privilégie le divertissement et la bonne humeur."),
)
CHEAP_EUROS = 20
LISTS = (40, 20, 20, 40)  # rows of the four candidate lists


def signals(interactions: DataFrame) -> DataFrame:
    """Per user: liked and disliked (map of category to count) and exclude_ids, of interactions(user_id, kind, id, category, rating).

    Saves, attendances, swipes to the right and ratings from 4 are likes; swipes to the left and ratings to 2 the contrary;
    whatever was saved, attended or swiped is not proposed again.
    """
    kind, rating = F.col("kind"), F.col("rating")
    likes = kind.isin("save", "attend", "swipe_right") | (kind == "review") & (rating >= 4)
    dislikes = (kind == "swipe_left") | (kind == "review") & (rating <= 2)
    known = interactions.withColumns({"_up": F.coalesce(likes, F.lit(False)), "_down": F.coalesce(dislikes, F.lit(False))})
    counts = known.groupBy("user_id", "category").agg(F.count_if("_up").alias("up"), F.count_if("_down").alias("down"))
    entry = lambda n: F.when(F.col("category").isNotNull() & (F.col(n) > 0), F.struct("category", n))
    both = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(entry("up"))).alias("liked"), F.map_from_entries(F.collect_list(entry("down"))).alias("disliked"))
    seen = known.groupBy("user_id").agg(F.array_sort(F.collect_set(F.when(kind != "review", F.col("id")))).alias("exclude_ids"))
    return both.join(seen, "user_id")


def merged_signals(a: str = "base", b: str = "extra") -> Column:
    """One struct of two of (categories, intents, liked, disliked, archetype, pref_free, exclude_ids): explicit choices of the first win, counts add up, ids unite."""
    x, y = F.col(a), F.col(b)
    some = lambda k: F.when(F.size(F.coalesce(x[k], F.array())) > 0, x[k]).otherwise(y[k]).alias(k)
    none = F.create_map().cast("map<string,bigint>")
    add = lambda k: F.map_zip_with(F.coalesce(x[k], none), F.coalesce(y[k], none), lambda _, p, q: F.coalesce(p, F.lit(0)) + F.coalesce(q, F.lit(0))).alias(k)
    first = lambda k: F.coalesce(x[k], y[k]).alias(k)
    ids = F.array_union(F.coalesce(x["exclude_ids"], F.array()), F.coalesce(y["exclude_ids"], F.array())).alias("exclude_ids")
    return F.struct(some("categories"), some("intents"), add("liked"), add("disliked"), first("archetype"), first("pref_free"), ids)


def _affinity(slug: str, which: int, top: float) -> Column:
    """What the archetype adds to a slug."""
    out = F.lit(0.0)
    for name, lists in AFFINITIES.items():
        if slug in lists[which]:
            out = F.when(F.col("archetype") == name, top - 0.5 * lists[which].index(slug)).otherwise(out)
    return out


def _best(weights: dict[str, Column], least: float, k: int) -> Column:
    rows = F.array(*(F.struct((-w).alias("w"), F.lit(slug).alias("slug")) for slug, w in weights.items()))
    return F.transform(F.slice(F.array_sort(F.filter(rows, lambda r: r["w"] <= -least)), 1, k), lambda r: r["slug"])


def plan(known: DataFrame) -> DataFrame:
    """known with plan_categories (at most 3), plan_intents (2), budget and personalized.

    known(categories, intents, arrondissements: arrays; liked, disliked: maps; pref_free; archetype; scores: map of score to value).
    """
    c = F.col
    held = lambda a, slug: F.coalesce(F.array_contains(a, slug), F.lit(False))
    count = lambda m, slug: F.least(F.coalesce(F.try_element_at(c(m), F.lit(slug)), F.lit(0)).cast("double"), F.lit(5.0))
    categories = {s: F.when(held("categories", s), 3.0).otherwise(0.0) + count("liked", s) + _affinity(s, 0, 2.5) - 0.7 * count("disliked", s) for s in L.CATEGORIES}
    score = lambda k: F.coalesce(F.try_element_at(c("scores"), F.lit(k)), F.lit(50))
    spoken = {s: [F.when(score(k) >= x if up else score(k) <= x, w).otherwise(0.0) for k, up, x, slug, w in SCORED if slug == s] for s in L.INTENTS}
    intents = {s: reduce(Column.__add__, spoken[s], F.when(held("intents", s), 3.0).otherwise(0.0) + _affinity(s, 1, 2.0)) for s in L.INTENTS}
    out = known.withColumns({
        "plan_categories": _best(categories, 1.0, 3), "plan_intents": _best(intents, 1.5, 2),
        "budget": F.when(F.coalesce("pref_free", F.lit(False)), "free").when(score("budget") <= 30, "cheap").otherwise("any"),
    })
    return out.withColumn("personalized", (F.size("plan_categories") > 0) | (F.size("plan_intents") > 0) | (c("budget") != "any") | (F.size(F.coalesce("arrondissements", F.array())) > 0))


def reason(fits_intent: Column) -> Column:
    """Why a pick is shown, over a card's columns and the plan's; the first that holds."""
    c = F.col
    free = c("price_status") == "free"
    labels = F.create_map(*(F.lit(x) for s in L.CATEGORIES for x in (s, s)))
    mine = c("personalized")
    place = c("arrondissement").isNotNull() & F.coalesce(F.array_contains("arrondissements", c("arrondissement")), F.lit(False))
    return (
        F.when(mine & fits_intent & (F.size("plan_intents") > 0), F.concat(F.lit("Ambiance "), c("plan_intents")[0], F.lit(", ton style")))
        .when(mine & F.coalesce(F.array_contains("plan_categories", c("category_slug")), F.lit(False)), F.concat(F.lit("Parce que tu aimes "), F.try_element_at(labels, c("category_slug"))))
        .when(mine & place, F.concat(F.lit("Dans ton coin ("), c("arrondissement"), F.lit(")"))).when(mine & free & (c("budget") != "any"), "Gratuit, comme tu préfères")
        .when(c("save_count") >= 3, F.concat(F.lit("Gardé par "), c("save_count").cast("string"), F.lit(" membres"))).when(free, "Gratuit cette semaine")
        .when(mine, "Pour sortir de tes habitudes").otherwise("Une valeur sûre de la semaine")
    )


def candidates(rows: DataFrame, categories: tuple[str, ...], intents: tuple[str, ...], arrondissements: tuple[str, ...], budget: str, seen: DataFrame | None, now: datetime, when: str = "week") -> DataFrame:
    """(id, score): the four lists of one plan (its categories and budget, its first intent, its places, anything) fused and lifted by the plan.

    rows: listing.with_dims(); seen(id) is left out of the lists, which are not filled up for it. A plan's lists are bounded listings, so nothing here grows with the catalogue but the four scans.
    """
    base = L.EventQuery(when=when, with_image=True, group_films=False)
    most = {"free": 0.0, "cheap": float(CHEAP_EUROS)}.get(budget)
    asked = [
        replace(base, categories=categories, max_price=most, limit=LISTS[0]) if categories or budget != "any" else None, replace(base, intents=intents[:1], max_price=most, limit=LISTS[1]) if intents else None,
        replace(base, arrondissements=arrondissements, limit=LISTS[2]) if arrondissements else None, replace(base, limit=LISTS[3]),
    ]
    lists = []
    for i, q in enumerate(q for q in asked if q):
        order = Window.orderBy(*L.ordering(q, now))  # over a bounded page
        page = L.listing(rows, q, now).withColumn("r", F.row_number().over(order) - 1).where(F.col("r") < q.limit)
        page = page if seen is None else page.join(seen.select("id"), "id", "left_anti")
        lists.append(page.select("id", "r", F.lit(i).alias("l"), "category_slug", "arrondissement", "price_status", "image_url"))
    every = reduce(DataFrame.unionByName, lists)
    fused = relational.fused(every, "id", "r", "l").select("id", "score")
    cards = every.dropDuplicates(["id"]).select("id", "category_slug", "arrondissement", "price_status", "image_url")
    lift = F.lit(0.0)
    for i, s in enumerate(categories):
        lift = lift + F.when(F.col("category_slug") == s, 0.6 - 0.15 * i).otherwise(0.0)
    if arrondissements:
        lift = lift + F.when(F.col("arrondissement").isin(*arrondissements), 0.3).otherwise(0.0)
    if budget != "any":
        lift = lift + F.when(F.col("price_status") == "free", 0.2).otherwise(0.0)
    lift = lift - F.when(F.col("image_url").isNull(), 0.5).otherwise(0.0)
    return fused.join(cards, "id").select("id", (F.col("score") + lift).alias("score"))


def picks(rows: DataFrame, scored: DataFrame, k: int = 5) -> DataFrame:
    """(pos, id): k of candidates() so that neighbours differ."""
    ranked = scored.join(rows.select("id", "venue_id", "category_slug"), "id").select(F.lit(0).alias("g"), "id", (-F.round("score", 9)).alias("rank"), F.col("venue_id").cast("string").alias("venue"), F.col("category_slug").alias("category"))
    return members.diversified(ranked, "g", k).select("pos", "id")


def taste_summary() -> Column:
    """The sentences that the scores (columns) of a member earn."""
    parts = [F.when(F.col(k) >= 70, high).when(F.col(k) <= 30, low) for k, high, low in SENTENCES]
    return F.concat_ws(" ", F.concat(F.lit("Profil « "), F.col("archetype"), F.lit(" ».")), *parts)


def merged_answers(old: Column, new: Column) -> Column:
    """A map of answers with newer ones in the place of older ones."""
    return F.map_zip_with(old, new, lambda _, a, b: F.coalesce(b, a))


# How a request is widened, one step after the other: (note, field to empty or change).
STEPS = (
    ("sans le mot-clé exact", "q"), ("avec un rayon plus large", "near"), ("dans les arrondissements voisins", "arrondissements"), ("sans le filtre d’ambiance", "intents"), ("sur toute la semaine", "when"), ("toutes catégories", "categories"),
)
WIDE_KM = 6.0


def widened(query: L.EventQuery, field: str) -> L.EventQuery | None:
    """The query with one condition less, or None if it has none of the kind."""
    held = getattr(query, field)
    if not held or field == "when" and held in ("week", "month"):
        return None
    value = {"q": None, "near": (*held[:2], WIDE_KM) if field == "near" else None, "when": "week"}.get(field, ())
    return replace(query, **{field: value})


def recommended(rows: DataFrame, query: L.EventQuery, now: datetime, limit: int = 6) -> tuple[DataFrame, L.EventQuery, list[str]]:
    """A page for a request, widened step by step until min(3, limit) rows are there: the page, the query that gave it, and the notes."""
    now_query, notes = replace(query, limit=limit * 3, sort="distance" if query.near else "relevance"), []
    page = L.listing(rows, now_query, now)
    for note, field in STEPS:
        if page.limit(min(3, limit)).count() >= min(3, limit):
            break
        wider = widened(now_query, field)
        if wider is not None:
            now_query = wider
            notes.append(note)
            page = L.listing(rows, now_query, now)
    return page, now_query, notes
