"""Members: experience, badges, challenges, taste, recommendations and alerts."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, times
from .scratch import table

# Rewards, levels and badges.
XP = {"saves": 5, "attendances": 30, "reviews": 15, "comments": 10, "first_review": 25, "swipes": 2, "quiz": 50}
LEVELS = (0, 100, 300, 700, 1500)
BADGES = {"first-save": ("saves", 1), "quiz-done": ("quiz", 1), "first-attend": ("attendances", 1), "five-outings": ("attendances", 5), "first-review": ("reviews", 1), "five-reviews": ("reviews", 5), "explorer-paris": ("arrondissements", 5), "curieux": ("categories", 5), "bon-plan": ("free_events", 5), "match-master": ("swipes", 50)}
DEEPER = 64  # times the depth of the lists of dates that a round of alerts reads
RUN, SHARE = 512, 1 << 20  # dates that a member meets at once, and pairs of dates and members of the same keys that a task makes, roughly
CHALLENGES = ("lieu-phare", "gratuit-arrondissement", "trois-categories", "deux-sorties")
# Categories of musical outings.
MUSIC = ("concerts", "festivals")
# Taste dimensions and the profile of each archetype, in this order.
DIMENSIONS = ("exploration", "energy", "social", "budget", "planning", "mainstream", "visual", "depth")
ARCHETYPES = {
    "explorateur-nocturne": (90, 85, 60, 40, 20, 30, 50, 50), "esthete-confidentiel": (85, 40, 40, 60, 60, 15, 70, 80), "epicurien-social": (50, 60, 85, 80, 60, 80, 50, 40), "flaneur-curieux": (75, 30, 50, 30, 30, 40, 60, 60),
    "fetard-culturel": (50, 90, 85, 50, 40, 75, 50, 30), "intellectuel-engage": (60, 20, 50, 40, 70, 20, 30, 95), "romantique-parisien": (50, 25, 25, 60, 50, 50, 75, 60), "aventurier-creatif": (90, 60, 50, 40, 25, 20, 85, 55),
}


def xp() -> Column:
    """Experience of a row of member statistics."""
    n = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("long")
    return (
        n("saves") * XP["saves"] + n("attendances") * XP["attendances"] + n("reviews") * XP["reviews"] + F.least(n("comments"), n("reviews")) * XP["comments"]
        + F.when(n("reviews") > 0, XP["first_review"]).otherwise(0) + n("swipes") * XP["swipes"] + F.when(n("quiz") > 0, XP["quiz"]).otherwise(0)
    )


def level(points: Column) -> Column:
    return sum((F.when(points >= x, 1).otherwise(0) for x in LEVELS[1:]), F.lit(1))


def badges() -> Column:
    return F.array_compact(F.array(*(F.when(F.col(c) >= goal, slug) for slug, (c, goal) in BADGES.items())))


def challenge_of(week_start: str) -> str:
    h = 0
    for ch in week_start:
        h = (h * 31 + ord(ch)) % (1 << 32)
    return CHALLENGES[h % len(CHALLENGES)]


def challenge_progress(interests: DataFrame, week_start: datetime, top_venues: DataFrame) -> DataFrame:
    """Per user: the week's four challenge values of interests(user_id, kind, at, venue, arrondissement, category, free)."""
    during = interests.where(F.col("at") >= times.stamp(week_start))
    before = interests.where(F.col("at") < times.stamp(week_start))
    fresh = lambda c: during.where(F.col(c).isNotNull()).join(before.select("user_id", c), ["user_id", c], "left_anti")
    venues = fresh("venue").join(top_venues.select("venue"), "venue", "left_semi").groupBy("user_id").agg(F.count_distinct("venue").alias("lieu_phare"))
    free = fresh("arrondissement").where("free").groupBy("user_id").agg(F.count_distinct("arrondissement").alias("gratuit"))
    rest = during.groupBy("user_id").agg(F.count_distinct("category").alias("categories"), F.count_if(F.col("kind") == "attend").alias("sorties"))
    users = interests.select("user_id").distinct()
    cap = lambda c, g: F.least(F.coalesce(c, F.lit(0)), F.lit(g)).cast("int").alias(c)
    return users.join(venues, "user_id", "left").join(free, "user_id", "left").join(rest, "user_id", "left").select("user_id", cap("lieu_phare", 1), cap("gratuit", 1), cap("categories", 3), cap("sorties", 2))


def taste(answers: DataFrame, weights: DataFrame) -> DataFrame:
    """user_id and eight scores: answers(user_id, question, answer a/b) over weights(question, dimension, weight); 50 where nothing is known."""
    high = F.when(F.col("weight") >= 0, F.col("answer") == "b").otherwise(F.col("answer") == "a")
    a = answers.where(F.col("answer").isin("a", "b")).join(weights, "question").groupBy("user_id").pivot("dimension", list(DIMENSIONS)).agg(F.floor(100 * F.sum(F.when(high, F.abs("weight")).otherwise(0)) / F.sum(F.abs("weight")) + 0.5).cast("int"))
    return answers.select("user_id").distinct().join(a, "user_id", "left").select("user_id", *(F.coalesce(d, F.lit(50)).alias(d) for d in DIMENSIONS))


def archetype() -> Column:
    """The nearest profile by squared distance; the first of equals."""
    far = lambda p: sum(((F.col(d) - x) * (F.col(d) - x) for d, x in zip(DIMENSIONS, p, strict=True)), F.lit(0))
    return F.array_min(F.array(*(F.struct(far(p).alias("d"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, p) in enumerate(ARCHETYPES.items()))))["k"]


def weighted_top(signals: DataFrame, owner: str, item: str, weight: str, least: float, k: int) -> DataFrame:
    """Per owner the k items of the greatest summed weight, from ``least`` on."""
    s = signals.groupBy(owner, item).agg(F.sum(weight).alias("weight")).where(F.col("weight") >= least)
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(owner).orderBy(F.col("weight").desc(), item))).where(F.col("rank") <= k)


def tops(rows: DataFrame, keys: dict[str, list[str]], k: int, item: str = "id") -> DataFrame:
    """(by, item, pos): the k first rows by each of several lists of columns, greatest first, then the least item; each list is a top-k of its own."""
    out = None
    for name, columns in keys.items():
        order = [*(F.col(c).desc() for c in columns), F.col(item).asc()]
        top = rows.orderBy(*order).limit(k)
        top = top.select(F.lit(name).alias("by"), item, F.row_number().over(Window.orderBy(*order)).alias("pos"))  # over k rows
        out = top if out is None else out.unionByName(top)
    return out


def diversified(ranked: DataFrame, owner: str, k: int) -> DataFrame:
    """Per owner: k rows of (rank, id, venue, category), re-ordered so that neighbours differ.

    Greedy: the first left whose venue is unused and category differs from the last; else whose venue was used once; else
    the first. Of a venue and category it can come to k rows at most, and of a category to k * k + 1, as no more can be
    passed over for their venue: top-k by group, so a task holds few rows of an owner, and none that counts is left out.
    """
    order = ["rank", "id"]
    some = ranked.withColumn("_v", F.coalesce(F.col("venue").cast("string"), F.concat(F.lit("id "), F.col("id").cast("string"))))
    some = some.withColumn("_n", F.row_number().over(Window.partitionBy(owner, "_v", "category").orderBy(*order))).where(F.col("_n") <= k)
    some = some.withColumn("_n", F.row_number().over(Window.partitionBy(owner, "category").orderBy(*order))).where(F.col("_n") <= k * k + 1).drop("_n", "_v")

    def pick(pdf):
        import pandas as pd

        pool, used, out, last = pdf.sort_values(["rank", "id"]).to_dict("records"), {}, [], None
        while pool and len(out) < k:
            times_used = [used.get(r["venue"] if r["venue"] is not None else ("id", r["id"]), 0) for r in pool]
            fresh = [i for i, r in enumerate(pool) if times_used[i] == 0 and (last is None or r["category"] != last)]
            second = [i for i in range(len(pool)) if times_used[i] < 2]
            r = pool.pop((fresh or second or [0])[0])
            key = r["venue"] if r["venue"] is not None else ("id", r["id"])
            used[key], last = used.get(key, 0) + 1, r["category"]
            out.append((r[owner], len(out), r["id"]))
        return pd.DataFrame(out, columns=[owner, "pos", "id"])

    kinds = dict(ranked.dtypes)
    return some.groupBy(owner).applyInPandas(pick, f"{owner} {kinds[owner]}, pos int, id {kinds['id']}")


def relaxed(rows: DataFrame, steps: list[Column], least: int) -> tuple[int, DataFrame]:
    """The first of ever weaker conditions that at least ``least`` rows meet, and its rows (the last one if none)."""
    for i, ok in enumerate(steps):
        if i == len(steps) - 1 or rows.where(ok).limit(least).count() >= least:
            return i, rows.where(ok)
    raise ValueError("no condition")


def _hours(h: int) -> Column:
    return F.expr(f"interval '{h}' hour")


def _followed(outings: DataFrame, artists: DataFrame, now: datetime) -> DataFrame:
    """(artist_key, id, kind, start_date, created_at) of what followers may hear of now; outings are cut to the window of their kind before they meet artists."""
    n = times.stamp(now)
    kinds = {"new_date": F.col("created_at") > n - _hours(7 * 24), "on_sale": F.col("on_sale_at").between(n - _hours(12), n + _hours(36))}
    each = F.array(*(F.when(ok, F.lit(k)) for k, ok in kinds.items()))
    some = outings.where(reduce(Column.__or__, kinds.values())).select("id", "start_date", "created_at", F.explode(F.array_compact(each)).alias("kind"))
    return some.join(artists.select("id", "artist_key"), "id").distinct()


def _heard_of() -> Column:
    """A new date counts from the day on which a member followed the artist."""
    return (F.col("kind") != "new_date") | F.coalesce(F.col("created_at") > F.col("followed_at"), F.lit(False))


def _reminders(outings: DataFrame, attendances: DataFrame, now: datetime) -> DataFrame:
    w = times.window("tomorrow", now)
    start = times.paris(times.night_day(now).fromordinal(times.night_day(now).toordinal() + 1), times.NIGHT_ENDS)
    tomorrow = outings.where(F.col("start_date").between(times.stamp(start), times.stamp(w.end))).select("id", "start_date")
    return attendances.join(tomorrow, "id").select("user_id", "id", F.lit("reminder").alias("kind"), "start_date")


def alert_items(follows: DataFrame, artists: DataFrame, outings: DataFrame, attendances: DataFrame, now: datetime) -> DataFrame:
    """(user_id, id, kind, start_date), each once: reminders, ticket openings and new dates that members may get now.

    follows(user_id, artist_key, followed_at), artists(id, artist_key), outings(id, start_date, created_at, on_sale_at),
    attendances(user_id, id). This is the whole list, a row for each follower of each date; see :func:`alerts` for the first of it.
    """
    mine = follows.join(_followed(outings, artists, now), "artist_key").where(_heard_of()).select("user_id", "id", "kind", "start_date")
    return mine.unionByName(_reminders(outings, attendances, now)).distinct()


def title_items(follows: DataFrame, outings: DataFrame, artists: DataFrame, now: datetime, categories: tuple[str, ...] = MUSIC) -> DataFrame:
    """(user_id, id, kind, start_date): new dates of musical outings without artists whose title holds a followed key as whole words.

    outings(id, title, category_slug, start_date, created_at, status, canonical_id). Every run of words of a title is
    joined to the keys, so no title meets all keys.
    """
    n = times.stamp(now)
    some = outings.where((F.col("status") == "active") & F.col("canonical_id").isNull() & (F.col("start_date") >= n) & (F.col("created_at") >= n - _hours(7 * 24)) & F.col("category_slug").isin(*categories))
    some = some.join(artists.select("id"), "id", "left_anti")
    words = F.split(text.words_of(F.col("title")), " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("_w")), lambda i: F.transform(F.sequence(i, F.size("_w")), lambda j: F.array_join(F.slice("_w", i, j - i + 1), " "))))
    keyed = some.withColumn("_w", words).select("id", "start_date", "created_at", F.explode(F.array_distinct(runs)).alias("artist_key"))
    # keys that somebody follows
    keyed = keyed.join(follows.select("artist_key").distinct(), "artist_key", "left_semi")
    # outings of the same keys are heard of by the same members, from their first follow of one of these on; so nothing is told apart after the join
    several = keyed.groupBy("id", "start_date").agg(F.array_sort(F.collect_set("artist_key")).alias("keys"), F.max("created_at").alias("created_at"))
    place = F.row_number().over(Window.partitionBy("keys").orderBy("created_at", "id", "start_date"))
    dates = table(several.withColumn("run", F.floor((place - 1) / RUN)), "title-dates")
    held = dates.select("keys").distinct().select("keys", F.explode("keys").alias("artist_key"))
    heard = table(follows.where("followed_at is not null").join(held, "artist_key").groupBy("user_id", "keys").agg(F.min("followed_at").alias("since")), "title-members")
    most = 4 * follows.sparkSession.sparkContext.defaultParallelism
    count = lambda df, n: df.groupBy("keys").agg(F.count(F.lit(1)).alias(n))
    shares = F.least(F.lit(most), F.ceil(F.col("n_dates") * F.col("n_members") / SHARE)).cast("int").alias("shares")
    shares = count(dates, "n_dates").join(count(heard, "n_members"), "keys").select("keys", shares)
    # a run of dates meets one member after the other, so results repeat at a short distance and files of them are small
    runs = dates.groupBy("keys", "run").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "start_date"))).alias("dates"), F.max("created_at").alias("last"))
    runs = runs.join(shares, "keys").select("keys", "dates", "last", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    heard = heard.join(shares, "keys").select("keys", F.pmod(F.xxhash64("user_id"), F.col("shares")).cast("int").alias("share"), "user_id", "since")
    runs, heard = (df.repartition(4 * most, "keys", "share") for df in (runs, heard))
    met = runs.join(heard.hint("merge"), ["keys", "share"]).where("last > since").select("user_id", "since", F.inline("dates"))
    return met.where("created_at > since").select("user_id", "id", F.lit("new_date").alias("kind"), "start_date")


def _urgency() -> Column:
    return F.when(F.col("kind") == "reminder", 0).when(F.col("kind") == "on_sale", 1).otherwise(2)


def _wanted(items: DataFrame, delivered: DataFrame, settings: DataFrame | None) -> DataFrame:
    """Items that were not delivered yet and whose kind the member did not refuse."""
    left = items.join(delivered.select("user_id", "id", "kind"), ["user_id", "id", "kind"], "left_anti")
    return left if settings is None else left.join(settings.where("not wanted").select("user_id", "kind").distinct(), ["user_id", "kind"], "left_anti")


def selected_items(items: DataFrame, delivered: DataFrame, settings: DataFrame | None = None, most: int = 20) -> DataFrame:
    """(user_id, kind, id, pos): what each member gets now of items (which may repeat) not delivered yet: the kinds they want (all, if settings(user_id, kind, wanted) say nothing), reminders first, then openings, then new dates, soonest first."""
    # equal items have equal places, so they need not be told apart before the first ``most`` are chosen, which each task does before the shuffle
    pos = F.dense_rank().over(Window.partitionBy("user_id").orderBy(_urgency(), "start_date", "id"))
    return _wanted(items, delivered, settings).withColumn("pos", pos).where(F.col("pos") <= most).select("user_id", "kind", "id", "pos").distinct()


def _first_followed(follows: DataFrame, dates: DataFrame, delivered: DataFrame, settings: DataFrame | None, most: int, depth: int) -> DataFrame:
    """(user_id, id, kind, start_date): the first ``most`` of each member's followed dates, without joining all dates of an artist to all followers.

    The dates of an artist and kind are put in order, and members meet the first ``depth`` of each. All that a member
    has not met lies behind the least of the next ones in their artists' lists. So a member is done who has ``most`` dates
    before that, or whose artists have no more; the others (of whose first dates some were delivered, refused or older than
    the follow) go on, with lists that are ``DEEPER`` times as deep, until no list is longer.
    """
    order = F.struct(_urgency().alias("u"), F.col("start_date").alias("s"), F.col("id").alias("i"))
    dates = table(dates.withColumn("at", order), "dates")
    longest = dates.groupBy("artist_key", "kind").count().agg(F.max("count")).first()[0] or 0
    by_list = Window.partitionBy("artist_key", "kind").orderBy("at")
    out: list[DataFrame] = []
    while True:
        heads = dates.withColumn("n", F.row_number().over(by_list)).where(F.col("n") <= depth + 1)  # a rank limit: each task sends so many of a list at most
        met = follows.join(heads.where(F.col("n") <= depth), "artist_key").where(_heard_of()).select("user_id", "id", "kind", "start_date", "at")
        pos = F.dense_rank().over(Window.partitionBy("user_id").orderBy("at"))
        first = _wanted(met, delivered, settings).withColumn("pos", pos).where(F.col("pos") <= most).distinct()
        if depth >= longest:
            out.append(first.select("user_id", "id", "kind", "start_date"))
            return reduce(DataFrame.unionByName, out)
        first = table(first, "first-dates")
        more = heads.where(F.col("n") == depth + 1).groupBy("artist_key").agg(F.min("at").alias("next"))
        behind = follows.join(more, "artist_key").groupBy("user_id").agg(F.min("next").alias("next"))
        have = first.groupBy("user_id").agg(F.count(F.lit(1)).alias("have"), F.max("at").alias("last"))
        open_ = behind.join(have, "user_id", "left").where((F.coalesce("have", F.lit(0)) < most) | (F.col("last") > F.col("next"))).select("user_id")
        open_ = table(open_, "open-members")
        out.append(first.join(open_, "user_id", "left_anti").select("user_id", "id", "kind", "start_date"))
        follows = follows.join(open_, "user_id", "left_semi")
        depth *= DEEPER


def alerts(follows: DataFrame, artists: DataFrame, outings: DataFrame, attendances: DataFrame, delivered: DataFrame, now: datetime, most: int = 20, settings: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(user_id, kind, id, pos) of alert_items() that each member gets now: the first ``most``, found by reading ``depth`` dates of each artist and going on only for members who lack some."""
    followed = _first_followed(follows, _followed(outings, artists, now), delivered, settings, most, depth or most)
    return selected_items(followed.unionByName(_reminders(outings, attendances, now)), delivered, settings, most)


def alert_batch(chosen: DataFrame, accounts: DataFrame, email_configured: bool = True, push_configured: bool = True, most: int = 200) -> DataFrame:
    """(user_id, email, push, urgent): the members of this run, those with a reminder or an opening first.

    accounts(user_id, email_enabled, push_enabled, has_email, n_push): a member without a usable channel is left out.
    """
    email = F.col("email_enabled") & F.col("has_email") & F.lit(email_configured)
    push = F.col("push_enabled") & (F.col("n_push") > 0) & F.lit(push_configured)
    plans = chosen.groupBy("user_id").agg(F.bool_or(F.col("kind") != "new_date").alias("urgent"))
    reach = accounts.select("user_id", email.alias("email"), push.alias("push")).where("email or push")
    return plans.join(reach, "user_id").orderBy(F.col("urgent").desc(), "user_id").limit(most).select("user_id", "email", "push", "urgent")


def deliveries(chosen: DataFrame, sent: DataFrame, delivered: DataFrame) -> DataFrame:
    """(user_id, id, kind, channels): the rows to append after a run; sent(user_id, channels) are the members whom a channel reached; recorded once, however often it runs."""
    new = chosen.select("user_id", "id", "kind").distinct().join(sent.where(F.size("channels") > 0), "user_id")
    return new.join(delivered.select("user_id", "id", "kind"), ["user_id", "id", "kind"], "left_anti").select("user_id", "id", "kind", "channels")


def last_dates(matches: DataFrame, now: datetime, days: int = 7, most: int = 12) -> DataFrame:
    """(user_id, id, pos): followed outings that start within some days, each once, soonest first. matches(user_id, id, start_date)."""
    n = times.stamp(now)
    soon = matches.where(F.col("start_date").between(n, n + _hours(24 * days))).select("user_id", "id", "start_date").distinct()
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("start_date", "id"))
    return soon.withColumn("pos", pos).where(F.col("pos") <= most).select("user_id", "id", "pos")


def pending(follows: DataFrame, matches: DataFrame) -> DataFrame:
    """(follow_id, id): matches(follow_id, id, created_at) added since a follow's last notice (or its start) and since it was last seen."""
    since = F.greatest(F.coalesce("last_notified_at", "followed_at"), "last_seen_at")
    return matches.join(follows.select("follow_id", since.alias("since")), "follow_id").where("created_at > since").select("follow_id", "id")
