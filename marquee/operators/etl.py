"""Dataflow steps between scrapes and the catalogue, as snapshot transforms."""

from __future__ import annotations

import time
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import artists, labels, text, times

SERIES_MIN = 4
# Sources with a row for each screening on purpose.
NO_SERIES = ("allocine", "cinematheque", "forumdesimages", "tmdb")
STALE_HOURS, TOUCH_HOURS, PURGE_DAYS = 2, 6, 60
# Words of events that take place online, folded.
ONLINE = r"\b(en ligne|online|webinar|webinaire|zoom|livestream|en distanciel|virtual event|visioconference)\b"


def collapse_series(rows: DataFrame, least: int = SERIES_MIN) -> DataFrame:
    """Sessions of one title at one venue of one source become one row from ``least`` on.

    rows(id, source, source_id, title, start_date, end_date, time_known, venue_name, is_cancelled).
    The first session stands for them, to the last end; its time is known if all
    are and agree. Cancelled sessions of a collapsed series go too. Adds n_sessions.
    """
    usable = F.col("start_date").isNotNull() & ~F.col("source").isin(*NO_SERIES) & ~F.coalesce(F.contains("source_id", F.lit("-series-")), F.lit(False))
    k1, k2 = text.plain_title(F.col("title")), F.lower(F.trim("venue_name"))
    titles = rows.select("title").distinct().withColumn("_k1", k1)  # the key of a title is computed once, however often it recurs
    r = rows.join(titles, "title", "left").withColumn("_k2", k2).withColumn("_k1", F.when(usable & (F.col("_k1") != "") & (F.col("_k2") != ""), F.col("_k1")))
    on = ~F.col("is_cancelled")
    start = F.col("start_date")
    local = times.to_paris(start)
    minute = F.when(on, F.hour(local) * 60 + F.minute(local))
    by = ["source", "_k1", "_k2"]
    g = r.where("_k1 is not null").groupBy(*by).agg(
        F.count_if(on).alias("n_sessions"), F.min(F.when(on, start)).alias("_start"), F.max(F.when(on, F.coalesce("end_date", "start_date"))).alias("_last"),
        (F.bool_and(F.when(on, F.col("time_known"))) & (F.min(minute) == F.max(minute))).alias("_known"),
    ).where(F.col("n_sessions") >= least)
    j = r.join(g, by, "left")
    first = j.where(on & (start == F.col("_start"))).groupBy(*by).agg(F.min("id").alias("_first"))
    j = j.join(first, by, "left").where("_start is null or id = _first")
    held = F.col("_first").isNotNull()
    return j.withColumn("end_date", F.when(held & (F.col("_last") > F.col("start_date")), F.col("_last")).otherwise(F.col("end_date"))).withColumn("time_known", F.when(held, F.col("_known")).otherwise(F.col("time_known"))).withColumn(
        "source_id", F.when(held, F.concat("source", F.lit("-series-"), text.stable_id(F.col("_k1"), F.col("_k2")))).otherwise(F.col("source_id"))
    ).select(*rows.columns, "n_sessions")


def hidden_sessions(rows: DataFrame) -> DataFrame:
    """Ids of sessions behind a live series row of the same source, title and venue, within its dates."""
    k = rows.withColumn("_t", text.plain_title(F.col("title"))).withColumn("_v", F.lower("venue_name"))
    mark = F.contains("source_id", F.lit("-series-"))
    series = k.where(mark).groupBy("source", "_t", "_v").agg(F.min("start_date").alias("_lo"), F.max(F.coalesce("end_date", "start_date")).alias("_hi"))
    return k.where(~mark).join(series, ["source", "_t", "_v"]).where("start_date between _lo and _hi").select("id")


def artists_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(event_id, artist_key, name, action): what replacing the artists of new's events changes, and nothing else."""
    touched = new.select("event_id").distinct()
    o = old.join(touched, "event_id", "left_semi").select("event_id", "artist_key", F.col("name").alias("_old"))
    n = new.select("event_id", "artist_key", F.col("name").alias("_new")).dropDuplicates(["event_id", "artist_key"])
    both = o.join(n, ["event_id", "artist_key"], "full")
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("_old") != F.col("_new"), "update")
    return both.select("event_id", "artist_key", F.coalesce("_new", "_old").alias("name"), action.alias("action")).where("action is not null")


def run_status(found: Column, stored: Column, errors: Column) -> Column:
    return F.when((found == 0) | (stored == 0), "failed").when(errors > 0, "partial").otherwise("success")


def source_health(now_counts: DataFrame, last_success: DataFrame) -> DataFrame:
    """Sources that found nothing, or over 60 % less than the last success of 20 or more."""
    j = last_success.join(now_counts, "source", "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long")))
    bad = F.when(F.col("found") == 0, "nothing").when((F.col("last_found") >= 20) & (F.col("found") < 0.4 * F.col("last_found")), "drop")
    return j.select("source", "found", "last_found", bad.alias("problem")).where("problem is not null")


def expired(rows: DataFrame, now: datetime) -> DataFrame:
    over = times.effective_end(F.col("start_date"), F.col("end_date"), 3) < times.stamp(now) - F.expr("interval '6' hour")
    return rows.withColumn("status", F.when(F.col("status").isin("active", "draft") & over, "expired").otherwise(F.col("status")))


def purged(rows: DataFrame, now: datetime, *activity: DataFrame) -> DataFrame:
    """Ids that ended over sixty days ago and that no activity (event_id) mentions."""
    out = rows.where(F.coalesce("end_date", "start_date") < times.stamp(now) - F.expr(f"interval '{PURGE_DAYS}' day")).select("id")
    for a in activity:
        out = out.join(a.select(F.col("event_id").alias("id")), "id", "left_anti")
    return out


def backfilled_artists(rows: DataFrame, have: DataFrame, now: datetime) -> DataFrame:
    """(id, artist_key, name, origin) for live musical outings that have(id) no artists yet: what their titles say."""
    todo = rows.where((F.col("status") == "active") & F.col("canonical_id").isNull() & F.col("category_slug").isin(*artists.MUSICAL) & (times.effective_end(F.col("start_date"), F.col("end_date")) >= times.stamp(now)))
    todo = todo.join(have.select("id"), "id", "left_anti")
    none = F.lit(None).cast("array<string>")
    return todo.select("id", F.explode(artists.of_outing(F.col("title"), F.col("category_slug"), none, F.col("venue_name"))).alias("a")).select("id", F.col("a.key").alias("artist_key"), "a.name", "a.origin")


def reserved_slugs(new: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, slug): the base slug if free, else with six, else eight digits of a hash; the first by id wins a base."""
    w = Window.partitionBy("base").orderBy("id")
    used = taken.select(F.col("slug").alias("base"), F.lit(True).alias("_used")).distinct()
    r = new.withColumn("_rn", F.row_number().over(w)).join(used, "base", "left")
    h = F.sha1(F.col("id").cast("string").cast("binary"))
    six = F.concat_ws("-", "base", F.substring(h, 1, 6))
    clash = taken.select(F.col("slug").alias("_six"), F.lit(True).alias("_taken6")).distinct()
    r = r.withColumn("_six", six).join(clash, "_six", "left")
    slug = F.when((F.col("_rn") == 1) & F.col("_used").isNull(), F.col("base")).when(F.col("_taken6").isNull(), F.col("_six")).otherwise(F.concat_ws("-", "base", F.substring(h, 1, 8)))
    return r.select("id", slug.alias("slug"))


def publish(df: DataFrame, path: str, name: str, least_share: float = 0.3, live: int = 0, by: str | None = None, counted: str | None = None) -> DataFrame:
    """Writes a rebuilt index beside the old one, in folders of the column ``by``; refuses to shrink it below a share of its live rows (or of distinct ``counted``, if rows are not what counts)."""
    if live:
        n = df.select(counted).distinct().count() if counted else df.count()
        if n < least_share * live:
            raise ValueError(f"{n} rows would replace {live}")
    at = f"{path}/{name}/v={time.time_ns()}"
    (df.write.partitionBy(by) if by else df.write).parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._written_at = at
    return out


def swapped(df: DataFrame, path: str, name: str, least_share: float = 0.3, small: int = 200, by: str | None = None, counted: str | None = None) -> DataFrame:
    """publish(), guarded by the size of what readers see now, and then the switch of what they see: a one-row table ``current`` names the folder."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/current")
    known = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)
    seen = current(spark, path, name) if known else None
    live = 0 if seen is None else seen.select(counted).distinct().count() if counted else seen.count()
    new = publish(df, path, name, least_share, live if live > small else 0, by, counted)
    spark.createDataFrame([(new._written_at,)], "at string").coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}/current")
    return new


def current(spark, path: str, name: str) -> DataFrame:
    """What readers of an index see."""
    return spark.read.parquet(spark.read.parquet(f"{path}/{name}/current").first()["at"])


# ---------------------------------------------------------------- pages and unions of sources


def keyset(rows: DataFrame, key: str, after=None, size: int | None = None) -> DataFrame:
    """The page of rows after a key, in its order; all of them if no size is given."""
    page = rows if after is None else rows.where(F.col(key) > F.lit(after))
    return page if size is None else page.orderBy(key).limit(size)


def merged_pages(pages: list[DataFrame], key: str, page: str) -> DataFrame:
    """Landed pages, which may overlap, as rows with each key once: the one of the first page that has it."""
    every = pages[0]
    for p in pages[1:]:
        every = every.unionByName(p)
    own = [x for x in every.columns if x not in (key, page)]
    best = every.groupBy(key).agg(F.min(F.struct(page, *own)).alias("_b"))
    return best.select(key, *(F.col(f"_b.{x}").alias(x) for x in own))


def one_each(sources: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """The union of sources with each key once, the least in the order of the named columns; aggregated before it is shuffled."""
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s)
    own = [x for x in every.columns if x != key]
    best = every.groupBy(key).agg(F.min(F.struct(*order, *(x for x in own if x not in order))).alias("_b"))
    return best.select(key, *(F.col(f"_b.{x}").alias(x) for x in own))


def sampled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in an order that a seed makes: a sample that the same seed repeats."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


# ---------------------------------------------------------------- plans of writes


def insertable(new: DataFrame, taken: DataFrame, slug: str, order: str) -> DataFrame:
    """New rows whose slug nobody has; of several with one slug the first by an order."""
    first = F.row_number().over(Window.partitionBy(slug).orderBy(order))
    return new.withColumn("_rn", first).where("_rn = 1").drop("_rn").join(taken.select(slug).distinct(), slug, "left_anti")


def changed(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of new whose values are distinct from old's, nulls compared."""
    was = old.select(*keys, F.struct(*values).alias("_was"))
    return new.join(was, keys).where(~F.struct(*values).eqNullSafe(F.col("_was"))).drop("_was")


def planned(new: DataFrame, known: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """new with plan: insert, update where values change, else keep."""
    was = known.select(*keys, F.struct(*values).alias("_was"))
    plan = F.when(F.col("_was").isNull(), "insert").when(F.struct(*values).eqNullSafe(F.col("_was")), "keep").otherwise("update")
    return new.join(was, keys, "left").select(*keys, plan.alias("plan"))


def bounded_update(rows: DataFrame, when: Column, values: dict[str, Column], most: int, key: str = "id") -> DataFrame:
    """Rows with new values in at most ``most`` of those that a condition fits, the least keys first."""
    some = rows.where(when).orderBy(key).limit(most).select(F.col(key).alias("_hit"))
    out = rows.join(some, F.col(key) == F.col("_hit"), "left")
    return out.withColumns({k: F.when(F.col("_hit").isNotNull(), v).otherwise(F.col(k)) for k, v in values.items()}).drop("_hit")


def isolated(rows: DataFrame, faults: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with a reason): one bad row costs itself, not its batch. The first fault that holds is the reason."""
    reason = None
    for name, bad in faults.items():
        reason = F.when(bad, name) if reason is None else reason.when(bad, name)
    judged = rows.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def closed_runs(started: DataFrame, finished: DataFrame, now: datetime) -> DataFrame:
    """The log of runs: started(run, started) with finished(run, finished, status); one that began over two hours ago and never ended has failed."""
    log = started.join(finished, "run", "left")
    stale = F.col("started") < times.stamp(now) - F.expr(f"interval '{STALE_HOURS}' hour")
    return log.withColumn("status", F.coalesce("status", F.when(stale, "failed").otherwise("running")))


def search_documents(rows: DataFrame) -> DataFrame:
    """All live rows as documents of a search index, without nulls in what is searched."""
    plain = lambda k: F.coalesce(k, F.lit("")).alias(k)
    return rows.select("id", "slug", "title", plain("short_desc"), plain("keywords"), plain("venue_name"), "category_slug", "start_date", "end_date", "price_min", "price_status", F.when(F.col("lat").isNotNull(), F.struct("lat", "lng")).alias("_geo"))


def made_events(raw: DataFrame) -> DataFrame:
    """Raw events of any source as records: text tidied, dates as UTC instants, prices in cents, a postcode, whether it is online, and an id.

    raw(source, source_id, title, start, end, price, venue_name, venue_zip, ...); other columns stay. Without an id of its
    own a record has sixteen digits of its source, title, start and venue.
    """
    tidy = lambda k: F.trim(F.regexp_replace(F.coalesce(k, F.lit("")), r"\s+", " "))
    out = raw.withColumns({"title": tidy("title"), "venue_name": F.nullif(tidy("venue_name"), F.lit("")), "_s": labels.instant(F.col("start")), "_e": labels.instant(F.col("end"), is_end=True)})
    amount = F.expr("try_cast(replace(price, ',', '.') as decimal(12,4))")
    cents = F.bround(amount * 100, 0).cast("int")
    out = out.withColumns({
        "start_date": F.col("_s.at"), "time_known": F.col("_s.time_known"), "end_date": F.col("_e.at"), "price_min": F.coalesce(cents, F.lit(0)), "price_status": F.when(cents.isNull(), "unknown").when(cents == 0, "free").otherwise("paid"),
        "venue_zip": text.zip_code(F.col("venue_zip")), "is_online": F.coalesce(text.fold(F.col("venue_name")).rlike(ONLINE), F.lit(False)),
    })
    own = F.nullif(F.col("source_id"), F.lit(""))
    return out.withColumn("source_id", F.coalesce(own, text.stable_id(F.col("source"), F.col("title"), F.col("start_date"), F.col("venue_name")))).drop("_s", "_e", "start", "end", "price")
