"""Editorial selection, detectors of what is no outing, staged venue lookup, cleanup rules and shard plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, times, titles
from .listing import OUTINGS
from .quality import INSTITUTIONAL, PUBLISH

LEAST_QUALITY = 70
# Sources whose outings have tickets or a venue's own programme, those of towns, and words of civic sessions.
TICKETED = r"^(ticketmaster|offi|theatreonline|billetreduc|dice|bandsintown|sortiraparis|cinematheque|forumdesimages|parisjazzclub|newmorning|venue_.+)$"
MUNICIPAL = ("paris_opendata", "openagenda")
CIVIC = r"\b(memoire|commemor\w*|pandemie|covid|esat|ladapt|handicap|inauguration|ouverture du|vous accueille|accueil des|bienvenue a paris|permanence|collecte|don du sang|depistage|sante publique|conseil de quartier|visite de chantier)\b"
# Groups of tags; a word of a group brings them all.
TAG_GROUPS = {
    "jazz": ("jazz", "swing", "bebop", "bossa", "manouche"), "rock": ("rock", "indie", "garage", "grunge"), "electro": ("electro", "techno", "house", "trance", "ambient"), "metal": ("metal", "hardcore", "metalcore", "doom"),
    "classique": ("classique", "orchestre", "symphonie", "quatuor", "opéra", "récital"), "stand-up": ("stand-up", "stand up", "one man show", "sketch"), "impro": ("impro", "improvisation"), "plein-air": ("plein air", "jardin", "parc", "terrasse"),
    "famille": ("famille", "enfant", "jeune public"), "nocturne": ("nocturne", "soirée", "nuit"), "gratuit": ("gratuit", "entrée libre", "bon plan"),
}
MOST_TAGS = 30
# Of a post: how many outings, how few at least, long runs, and how many of a day by window.
CAROUSEL, CAROUSEL_LEAST, LONG_RUNS, PER_DAY = 8, 5, 2, {"week": 2, "weekend": 3}


def institutional(title: Column) -> Column:
    return text.fold(title).rlike(INSTITUTIONAL)


def online(title: Column) -> Column:
    return text.fold(title).rlike(r"\b(en ligne|webinaire|visio|zoom)\b")


def junk(title: Column) -> Column:
    """No letter at all."""
    return title.rlike(r"^\P{L}*$")


def eligible(rows: DataFrame, exclusions: DataFrame, w: times.Window, area: str = r"^(75|92|93|94)[0-9]{3}$") -> DataFrame:
    """Rows that a post may show: published, in the area, good enough, in the window, and on none of the three exclusion lists."""
    c = F.col
    long_ = times.long_run(c("start_date"), c("end_date"))
    here = c("arrondissement").isNotNull() | F.coalesce(c("zip_code").rlike(area), F.lit(False))
    when = F.when(long_, c("end_date") >= times.stamp(w.start)).otherwise(c("time_known") & c("start_date").between(times.stamp(w.start), times.stamp(w.end)))
    out = rows.where((c("status") == "active") & ~c("category_slug").eqNullSafe("cinema") & c("venue_name").isNotNull() & here & (c("quality_score") >= LEAST_QUALITY) & ~institutional(c("title")) & when)
    for kind, key in (("event", "id"), ("source", "source"), ("venue", "venue_id")):
        gone = exclusions.where(c("kind") == kind).select(c("value").alias("_v"))
        out = out.join(gone, c(key).cast("string") == c("_v"), "left_anti")
    return out


def score(signature: str) -> Column:
    c = F.col
    points = [
        c("quality_score"), F.when(F.coalesce(text.fold(c("venue_name")).rlike(signature), F.lit(False)), 25).otherwise(0), F.when(c("image_url").isNotNull(), 10).otherwise(0), F.least(c("save_count") * 2, F.lit(20)),
        F.when(c("category_slug").isin(*OUTINGS), 15).when(c("category_slug").isin("soirees", "festivals", "visites"), 5).otherwise(0), F.when(c("price_status") == "unknown", -5).otherwise(0),
        F.when(c("arrondissement").isNull(), -5).otherwise(0), F.when(times.long_run(c("start_date"), c("end_date")), -8).otherwise(0), F.when(c("price_status") == "paid", 4).otherwise(0),
        F.when(c("source").rlike(TICKETED), 12).when(c("source").isin(*MUNICIPAL), -6).otherwise(0), F.when(text.fold(c("title")).rlike(CIVIC), -30).otherwise(0),
    ]
    return reduce(Column.__add__, points)


def candidate_order(of_note: Column) -> list[Column]:
    """Venues of note first, then quality, pictures, popularity, the soonest."""
    c = F.col
    return [F.coalesce(of_note, F.lit(False)).desc(), c("quality_score").desc(), c("image_url").isNotNull().desc(), c("save_count").desc(), c("start_date").asc(), c("id").asc()]


def contenders(rows: DataFrame, k: int) -> DataFrame:
    """The rows that a greedy choice of k can come to, whatever their number, as top-k by groups.

    A choice takes k rows at most and passes over a row only for its venue, title, category, day or length. So of rows that
    agree in all five it reaches the first alone; of those that agree in all but the title k, as fewer titles are taken by
    then; likewise all but the venue; and of a category, day and length 2 k * k + 1, as fewer are passed over for either.
    """
    order = [F.col("score").desc(), "start_date", "id"]
    out = rows.withColumn("_v", F.coalesce(F.col("venue_id").cast("string"), F.concat(F.lit("id "), F.col("id").cast("string"))))
    for by, most in ((["_v", "title"], 1), (["_v"], k), (["title"], k), ([], 2 * k * k + 1)):
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "category", "day", "long").orderBy(*order))).where(F.col("_n") <= most)
    return out.drop("_n")


def picked(rows: DataFrame, k: int, per_category: int, per_day: int | None, long_runs: int) -> DataFrame:
    """(pos, id): k of the best by score, no venue or title twice, few of a category, day or long run; the limits on categories and days fall if there are not enough.

    The choice is sequential. Its rows come in order of score to one task, which stops reading when it has its k; nothing is held but what was chosen.
    """
    c = F.col
    some = rows.select("id", "venue_id", text.slug(c("title")).alias("title"), F.coalesce("category_slug", F.lit("autre")).alias("category"), times.paris_day(c("start_date")).cast("string").alias("day"), times.long_run(c("start_date"), c("end_date")).alias("long"), "score", "start_date")
    ranked = contenders(some, k).orderBy(c("score").desc(), "start_date", "id")

    out: list[dict] = []
    for strict in (True, False):
        if len(out) >= k:
            break
        used = {"venue": {r["venue"] for r in out}, "title": {r["title"] for r in out}}
        for row in ranked.toLocalIterator():  # ends as soon as k rows are chosen
            r = row.asDict() | {"venue": row["venue_id"] if row["venue_id"] is not None else ("id", row["id"])}
            if r["venue"] in used["venue"] or r["title"] in used["title"] or r["long"] and sum(x["long"] for x in out) >= long_runs:
                continue
            full = sum(x["category"] == r["category"] for x in out) >= per_category or per_day is not None and not r["long"] and sum(not x["long"] and x["day"] == r["day"] for x in out) >= per_day
            if strict and full:
                continue
            out.append(r)
            used["venue"].add(r["venue"])
            used["title"].add(r["title"])
            if len(out) >= k:
                break
    return rows.sparkSession.createDataFrame([(i, r["id"]) for i, r in enumerate(out)], "pos int, id long")


def selected(pool: DataFrame, signature: str, window: str) -> DataFrame:
    """(pos, id): the outings of one post from eligible rows: scored, picked, none if there are too few, and in the order of time for a week or a weekend, long runs last."""
    scored = pool.withColumn("score", score(signature))
    chosen = picked(scored, CAROUSEL, 2, PER_DAY.get(window), LONG_RUNS if window in PER_DAY else 0)
    if chosen.count() < CAROUSEL_LEAST:
        return chosen.limit(0)
    if window not in PER_DAY:
        return chosen
    rows = chosen.join(pool.select("id", "start_date", "end_date"), "id")
    order = Window.orderBy(times.long_run(F.col("start_date"), F.col("end_date")), "start_date", "id")  # over at most CAROUSEL rows
    return rows.select((F.row_number().over(order) - 1).alias("pos"), "id")


def legacy_tags(words: Column) -> Column:
    """Tags of lower-cased text: of each group that a word of it names, all words and the group's name; at most MOST_TAGS, in order."""
    hit = lambda terms: reduce(Column.__or__, (words.contains(x) for x in terms))
    groups = [F.when(hit(terms), F.array(F.lit(name), *map(F.lit, terms))).otherwise(F.array().cast("array<string>")) for name, terms in TAG_GROUPS.items()]
    return F.slice(F.array_sort(F.array_distinct(F.concat(*groups))), 1, MOST_TAGS)


def label_category(label: Column, whole: dict[str, str], words: dict[str, str]) -> Column:
    """A label's category: the whole label's, else that of its first known word."""
    a = F.create_map(*(F.lit(x) for kv in whole.items() for x in kv))
    b = F.create_map(*(F.lit(x) for kv in words.items() for x in kv))
    known = F.filter(F.transform(F.split(label, " "), lambda w: F.try_element_at(b, w)), lambda k: k.isNotNull())
    return F.coalesce(F.try_element_at(a, label), F.get(known, F.lit(0)))


def reclassified(rows: DataFrame, detected: Column) -> DataFrame:
    """Rows of which the category changes, changed: one without a category takes what its words say, another what its title imposes.

    rows(title, category_slug, quality_score, status, soft): if the missing category was held against a row, ten points come back, and a draft is published from the threshold.
    """
    new = F.when(F.col("category_slug").isNull(), detected).otherwise(titles.category_override(F.col("title"), F.col("category_slug")))
    marked = F.array_contains("soft", "no_category")
    points = F.when(marked, F.least(F.lit(100), F.col("quality_score") + 10)).otherwise(F.col("quality_score")).cast("int")
    published = (F.col("status") == "draft") & marked & (F.col("quality_score") + 10 >= PUBLISH)
    out = rows.withColumn("_new", new).where(F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("category_slug")))
    out = out.withColumns({"quality_score": points, "status": F.when(published, "active").otherwise(F.col("status")), "soft": F.array_remove("soft", "no_category"), "category_slug": F.col("_new")})
    return out.drop("_new")


def resolved_venues(new: DataFrame, known: DataFrame, stages: list[tuple[str, list[str]]]) -> DataFrame:
    """(id, venue, how): the least known id that agrees on the columns of the first stage where any does; ``new`` else."""
    out = new.withColumn("venue", F.lit(None).cast("long")).withColumn("how", F.lit(None).cast("string"))
    for name, on in stages:
        found = known.groupBy(*on).agg(F.min("id").alias("_found"))
        hit = F.col("venue").isNull() & F.col("_found").isNotNull()
        out = out.join(found, on, "left").withColumn("how", F.when(hit, name).otherwise(F.col("how"))).withColumn("venue", F.coalesce("venue", "_found")).drop("_found")
    return out.select("id", "venue", F.coalesce("how", F.lit("new")).alias("how"))


def cleaned(rows: DataFrame, rules: list[tuple[Column, dict[str, Column]]]) -> DataFrame:
    """Rules in order: where the condition holds on the rows as they are by then, columns take new values."""
    for when, values in rules:
        rows = rows.withColumns({k: F.when(when, v).otherwise(F.col(k)) for k, v in values.items()})
    return rows


def shard_plan(sizes: dict[str, int], shards: int) -> dict[str, int]:
    """The longest first, each to the shard with the least work."""
    load, out = [0] * shards, {}
    for k, n in sorted(sizes.items(), key=lambda x: (-(x[1] or 0), x[0])):
        i = load.index(min(load))
        load[i] += n or 0
        out[k] = i
    return out
