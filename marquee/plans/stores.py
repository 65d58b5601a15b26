"""Queries: pages of sites read from HTML, texts at any depth, and what is kept between runs: weekly drops and search indexes."""

from __future__ import annotations

import contextlib
import uuid
from datetime import date

from pyspark.sql import functions as F

from ..functions import text
from ..operators import drops, etl, search_index
from ..operators.scratch import shared_dir
from ..sources import listing_pages, tourism, venues
from . import bindings as B
from .registry import query

c = F.col
t = B.read


def _folder(s) -> str:
    return f"{shared_dir(s).rstrip('/')}/stores-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- texts

_TEXTS = {
    0: ('"Titre #"', "Titre #"), 1: ('{"fr": ["Fête #", "Bal"], "en": ["Feast #"]}', "Fête #|Bal|Feast #"), 2: ('[{"@value": "Feast", "@language": "en"}, {"@value": ["Fête #", {"@value": "x"}], "@language": "fr"}]', "Fête #|x|Feast"), 3: ('{"@id": "urn:#"}', ""),
    4: ('[[["deep #"]], true, null, 7, {"@none": "neutral"}, {"de": {"@value": "tief"}}]', "deep #|7|neutral|tief"), 5: ('{"@fr-FR": [[" Bal "]], "other": "left out", "@en": {"fr": "dedans #"}}', "dedans #|Bal"),
}


@query("jsn_01_texts", f"select o_orderkey k, replace(({B._list([want for _, want in _TEXTS.values()])})[o_orderkey % 6 + 1], '#', o_orderkey::varchar) texts from orders")
def jsn_01(s, d):
    json = F.replace(F.element_at(F.array(*(F.lit(v) for v, _ in _TEXTS.values())), (c("o_orderkey") % 6 + 1).cast("int")), F.lit("#"), c("o_orderkey").cast("string"))
    return t(s, d, "orders").select(c("o_orderkey").alias("k"), F.array_join(tourism.texts(F.parse_json(json)), "|").alias("texts"))


# ---------------------------------------------------------------- pages

SELECTORS = [
    (0, "record", "[itemtype=https://schema.org/Event]", 0), (0, "title", ".event-title a", 0), (0, "url", ".event-title a@href", 0), (0, "start", "[itemprop=startDate]@content", 0), (0, "venue", "[itemprop=location] [itemprop=name]", 0),
    (0, "zip", "[itemprop=location] [itemprop=postalCode]", 0), (0, "status", "[itemprop=eventStatus]@href", 0), (1, "record", "article.ev", 0), (1, "title", "h2", 0), (1, "title", "a.t", 1), (1, "url", "a.t@href", 0), (1, "when", ".when", 0), (1, "price", ".price", 0),
    (2, "title", "a", 0), (2, "url", "a@href", 0), (2, "when", "em", 0),
]
_SELECTORS = "site int, field string, path string, rank int"
_BASE = "https://s.example/list/p?page=1"
_MENU = '<!DOCTYPE html><body><nav><ul><li><a href="/a">Un</a><li><a href="/b">Deux</a><li><a href="/c">Trois</a><li><a href="/d">Quatre</a></ul></nav><script>var x = "<article class=ev>";</script>'
_MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")


def _cards(s, d):
    """Orders as cards of their customers' listing pages, in three layouts."""
    k, day = c("o_orderkey"), c("o_orderdate")
    n, month = k.cast("string"), F.element_at(F.array(*map(F.lit, _MONTHS)), F.month(day))
    join = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    micro = join('<div class="card" itemscope itemtype="https://schema.org/Event"><meta itemprop="startDate" content=""><h3 class="event-title"><a href="/e/', n, '?x=1">Fête &amp; Bal ', n, '</a></h3><meta itemprop="startDate" content="', F.date_format(day, "yyyy-MM-dd'T'20:00:00"), '"><span itemprop="location"><b itemprop="name">Salle ', (k % 40).cast("string"), '</b> <i itemprop="postalCode">750', (k % 10 + 10).cast("string"), " Paris</i></span>", F.when(k % 7 == 0, '<link itemprop="eventStatus" href="https://schema.org/EventCancelled">').otherwise(""), "</div>")
    words = join('<article class="ev big"><h2></h2><p><a class=t href="https://tickets.example/', n, '">Fête &amp; Bal ', n, "</a><p class=when>Le ", F.dayofmonth(day).cast("string"), " ", month, " ", F.year(day).cast("string"), " à 20h30<p class=price>Tarif : ", (k % 50).cast("string"), " €</article>")
    bare = join('<li><a href="k-', n, '.html">Fête &amp; Bal ', n, "</a> — une soirée pour tous<br><em>", F.date_format(day, "dd/MM/yyyy"), "</em>")
    return t(s, d, "orders").select(k.alias("k"), c("o_custkey").alias("key"), (c("o_custkey") % 3).cast("int").alias("site"), F.when(c("o_custkey") % 3 == 0, micro).when(c("o_custkey") % 3 == 1, words).otherwise(bare).alias("card"), "o_orderdate")


def _pages(cards):
    by = cards.groupBy("key", "site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "card"))), lambda x: x["card"]), "\n").alias("cards"))
    return by.select("key", "site", F.concat(F.lit(_MENU), F.when(c("site") == 2, "<ul class=list>").otherwise("<main>"), c("cards"), F.lit("</ul></main></body>")).alias("value"))


_UTC = lambda day, hours: f"({day} + {hours} - interval 1 hour * (case when {B.summer_sql(day)} then 2 else 1 end))"


@query("src_14_cards", f"""with o as (select o_orderkey k, o_custkey as "key", o_custkey % 3 site, o_orderdate::date::timestamp x, count(*) over (partition by o_custkey) n, row_number() over (partition by o_custkey order by o_orderkey) - 1 pos from orders)
  select "key", pos::int pos, case site when 0 then 'https://s.example/e/' || k || '?x=1' when 1 then 'https://tickets.example/' || k else 'https://s.example/list/k-' || k || '.html' end url, 'Fête & Bal ' || k title,
    case site when 0 then {_UTC('x', 'interval 20 hour')} when 1 then {_UTC('x', 'interval 1230 minute')} else {_UTC('x', 'interval 12 hour')} end start_date, site <> 2 time_known, case when site = 1 then (k % 50)::int * 100 else 0 end price_min,
    case when site <> 1 then 'unknown' when k % 50 = 0 then 'free' else 'paid' end price_status, case when site = 0 then 'Salle ' || (k % 40) end venue_name, case when site = 0 then '750' || (k % 10 + 10) end venue_zip, site = 0 and k % 7 = 0 is_cancelled
  from o where site <> 2 or n >= 3""")
def src_14_cards(s, d):
    found = listing_pages.read(_pages(_cards(s, d)), s.createDataFrame(SELECTORS, _SELECTORS))
    out = listing_pages.events(found, F.lit(_BASE), date(1998, 6, 15))
    return out.select("key", "pos", "url", "title", "start_date", "time_known", "price_min", "price_status", "venue_name", "venue_zip", "is_cancelled")


@query("src_14_completed_pages", f"""with o as (select o_orderkey k, o_orderdate::date::timestamp x from orders where o_custkey % 3 = 0)
  select 'https://s.example/e/' || k || '?x=1' url, case when k % 3 <> 0 and k % 4 <> 0 then {_UTC('x', 'interval 21 hour')} else {_UTC('x', 'interval 20 hour')} end start_date, case when k % 3 = 0 then 0 else (k % 30)::int * 100 + 50 end price_min, case when k % 3 = 0 then 0 else (k % 30)::int * 100 + 1050 end price_max,
    case when k % 3 = 0 then 'unknown' else 'paid' end price_status, 'Salle ' || (k % 40) venue_name from o""")
def src_14_completed(s, d):
    cards = _cards(s, d).where("site = 0")
    selectors = s.createDataFrame(SELECTORS, _SELECTORS)
    listed = listing_pages.events(listing_pages.read(_pages(cards), selectors), F.lit(_BASE), date(1998, 6, 15))
    k, n = c("k"), c("k").cast("string")
    low, high = (F.concat((k % 30 + x).cast("string"), F.lit(".50")) for x in (0, 10))
    start = F.when(k % 4 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'21:00:00"))
    page = F.concat(F.lit(_MENU + "<h1>Fête &amp; Bal "), n, F.lit('</h1><meta itemprop="startDate" content="'), start, F.lit('"><div itemprop="offers"><meta itemprop="lowPrice" content="'), low, F.lit('"><meta itemprop="highPrice" content="'), high, F.lit('"></div><time>'), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" 20h</time>"))
    url = F.concat(F.lit("https://s.example/e/"), n, F.lit("?x=1"))
    detail = [(9, "title", "h1", 0), (9, "start", "[itemprop=startDate]@content", 0), (9, "when", "time", 0), (9, "low", "[itemprop=lowPrice]@content", 0), (9, "high", "[itemprop=highPrice]@content", 0)]
    opened = cards.where("k % 3 <> 0").select(F.lit(9).alias("site"), url.alias("key"), page.alias("value"))
    details = listing_pages.events(listing_pages.read(opened, s.createDataFrame(detail, _SELECTORS), whole=True), F.lit(_BASE), date(1998, 6, 15))
    own = ["url", "start_date", "time_known", "price_min", "price_max", "price_status", "venue_name"]
    out = venues.completed(listed.select(*own), details.withColumn("url", c("key")).select(*own[:-1]))
    return out.select("url", "start_date", F.coalesce("price_min", F.lit(0)).alias("price_min"), F.coalesce("price_max", F.lit(0)).alias("price_max"), "price_status", "venue_name")


# ---------------------------------------------------------------- weekly drops


@query("rec_13_stored_drop", f"""{B.BASE}, p as (select o_custkey user_id, o_orderkey id, row_number() over (partition by o_custkey order by case when o_custkey % 2 = 0 then o_orderkey else -o_orderkey end) p from orders),
  g as (select p.user_id, p.id, p.p, coalesce(eff, start_date) >= {B.NOW_SQL} live from p join r using (id) where p.p <= 5), l as (select user_id, id, row_number() over (partition by user_id order by p) - 1 pos from g where live)
  select u.user_id, l.pos::int pos, l.id, n_ended from (select user_id, count(*) filter (not live) n_ended from g group by 1) u left join l using (user_id)""")
def rec_13_stored(s, d):
    o = t(s, d, "orders").select(c("o_custkey").alias("user_id"), c("o_orderkey").alias("id"))
    at, week = _folder(s), date(1998, 6, 15)
    drops.give(o.where("user_id % 2 = 0").withColumn("pos", c("id")), at, week)
    given = drops.give(o.withColumn("pos", -c("id")), at, week)  # those who have a drop keep it
    return drops.shown(given, B.outings(s, d), B.NOW)


# ---------------------------------------------------------------- search indexes


@query("flt_18_from_postings", f"{B.BASE} select id from r where (contains(txt, 'theatre') or coalesce(contains(vtxt, 'theatre'), false)) and (contains(txt, 'soiree') or coalesce(contains(vtxt, 'soiree'), false))")
def flt_18_postings(s, d):
    rows, at = B.rows(s, d), _folder(s)
    words, place = text.fold(F.concat_ws(" ", "title", F.coalesce("short_desc", F.lit("")), F.coalesce("keywords", F.lit("")))), text.fold(c("venue_name"))
    search_index.rebuild(rows, words, at, "texts")
    search_index.rebuild(B.venues(s, d).withColumnRenamed("venue_id", "id"), place, at, "venue-names")
    return search_index.matching(rows, [("texts", "id", words), ("venue-names", "venue_id", place)], text.search_tokens("théatre soirée"), at).select("id")


@query("snk_03_swapped_index", "select distinct o_orderkey id, unnest(list_transform(range(1, len(o_orderpriority) - 1), lambda i: substr(lower(o_orderpriority), i, 3))) gram from orders where o_orderkey % 5 < 2")
def snk_03(s, d):
    o, at = t(s, d, "orders").select(c("o_orderkey").alias("id"), text.fold(c("o_orderpriority")).alias("x")), _folder(s)
    search_index.rebuild(o, c("x"), at, "orders")
    search_index.rebuild(o.where("id % 5 < 2"), c("x"), at, "orders")
    with contextlib.suppress(ValueError):  # would leave under 30 %
        search_index.rebuild(o.where("id % 20 = 0"), c("x"), at, "orders")
    return search_index.current(s, at, "orders").select("id", "gram")
