"""Pages made of several listings."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, times
from . import listing as L
from . import members

# The blocks of the home page: (name, query, cards it shows, whether neighbours are to differ).
HOME = (
    ("discover", L.EventQuery(when="tonight", limit=12), 4, True),
    ("tonight", L.EventQuery(when="tonight", with_image=True, one_off_only=True, exclude_categories=("cinema",), limit=24), 3, True),
    ("expos", L.EventQuery(categories=("expos",), when="month", runs_ending_within_days=400, with_image=True, limit=16), 16, False),
    ("last-chance", L.EventQuery(runs_ending_within_days=7, with_image=True, sort="ending", limit=10), 10, False),
    ("free", L.EventQuery(free=True, when="week", with_image=True, one_off_only=True, limit=12), 8, True),
    ("big", L.EventQuery(when="tonight", signature_only=True, with_image=True, one_off_only=True, exclude_categories=("cinema",), limit=24), 8, True),
)
DAY = L.EventQuery(one_off_only=True, limit=10)
DAY_CARDS, BIG_LEAST = 6, 4


def weekend(now: datetime) -> list[str]:
    """The days left of this week's Friday to Sunday, as dates."""
    today = times.night_day(now)
    friday = today + timedelta(days=4 - today.weekday())
    return [(friday + timedelta(days=i)).isoformat() for i in range(3) if friday + timedelta(days=i) >= today]


def _page(rows: DataFrame, name: str, query: L.EventQuery, now: datetime, signature: str | None) -> DataFrame:
    """(block, rank, id, venue, category) of a bounded listing."""
    page = L.listing(rows, query, now, signature)
    rank = F.row_number().over(Window.orderBy(*L.ordering(query, now, signature)))
    return page.withColumn("rank", rank).where(F.col("rank") <= query.limit).select(F.lit(name).alias("block"), "rank", "id", F.col("venue_id").cast("string").alias("venue"), F.col("category_slug").alias("category"))


def home(rows: DataFrame, now: datetime, signature: str | None = None) -> DataFrame:
    """(block, pos, id) of the home page: its blocks are bounded listings; what an earlier one shows is left out of ``tonight`` and ``free``.

    The big venues are the week's where tonight has fewer than four.
    """
    queries = {name: query for name, query, _, _ in HOME} | {f"day-{d}": L.replace(DAY, when=d) for d in weekend(now)}
    cards = {name: k for name, _, k, _ in HOME} | {f"day-{d}": DAY_CARDS for d in weekend(now)}
    mixed = [name for name, _, _, differ in HOME if differ] + [f"day-{d}" for d in weekend(now)]
    pages = {name: _page(rows, name, query, now, signature) for name, query in queries.items()}

    def shown(name: str) -> DataFrame:
        page = pages[name]
        if name not in mixed:
            return page.where(F.col("rank") <= cards[name]).select("block", F.col("rank").alias("pos"), "id")
        return members.diversified(page, "block", cards[name])

    out = {"discover": shown("discover")}
    big = shown("big")
    if big.count() < BIG_LEAST:
        pages["big"] = _page(rows, "big", L.replace(queries["big"], when="week"), now, signature)
        big = shown("big")
    pages["tonight"] = pages["tonight"].join(out["discover"].select("id"), "id", "left_anti")
    out["tonight"] = shown("tonight")
    pages["free"] = pages["free"].join(out["discover"].select("id").union(out["tonight"].select("id")), "id", "left_anti")
    out |= {name: shown(name) for name in queries if name not in ("discover", "tonight", "big")} | {"big": big}
    return reduce(DataFrame.unionByName, (x.select("block", F.col("pos").cast("int").alias("pos"), "id") for x in out.values()))


def event(rows: DataFrame, chosen: DataFrame, artists: DataFrame, now: datetime, most: int = 6) -> DataFrame:
    """(page, block, pos, id) for any number of pages: outings of the same category, at the same venue, of the same work, with the same artists, soonest or best first.

    chosen(page, id): the outing of each page; artists(id, artist_key). Each block is a join on its key and a top-k by page.
    """
    live = rows.where(L.live(now)).withColumn("work", text.slug(F.col("title")))
    me = chosen.join(live, "id").select("page", F.col("id").alias("own"), "category_slug", "venue_id", "work")
    others = live.select("id", "category_slug", "venue_id", "work", "quality_score", "start_date")
    best, soon = [F.col("quality_score").desc(), "id"], ["start_date", "id"]

    def block(name: str, key: str, order: list) -> DataFrame:
        top = others.where(F.col(key).isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_k") <= most + 1)  # one more: the page's own
        met = me.select("page", "own", key).join(top.select("id", key, "quality_score", "start_date"), key).where("id <> own")
        pos = F.row_number().over(Window.partitionBy("page").orderBy(*order))
        return met.withColumn("pos", pos).where(F.col("pos") <= most).select("page", F.lit(name).alias("block"), "pos", "id")

    mine = me.join(artists, F.col("own") == F.col("id")).select("page", "own", "artist_key").distinct()
    shared = live.select("id", "start_date").join(artists.select("id", "artist_key").distinct(), "id")
    top = shared.withColumn("_k", F.row_number().over(Window.partitionBy("artist_key").orderBy(*soon))).where(F.col("_k") <= most + 1)
    met = mine.join(top, "artist_key").where("id <> own").groupBy("page", "id").agg(F.min("start_date").alias("start_date"))
    by_artist = met.withColumn("pos", F.row_number().over(Window.partitionBy("page").orderBy(*soon))).where(F.col("pos") <= most).select("page", F.lit("artists").alias("block"), "pos", "id")
    return block("similar", "category_slug", best).unionByName(block("venue", "venue_id", soon)).unionByName(block("work", "work", soon)).unionByName(by_artist)
