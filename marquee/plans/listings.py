"""Queries: predicates, the read join, listings, sorts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text, times
from ..operators import listing as L
from . import bindings as B
from .registry import query

Q = L.EventQuery
SIGNATURE = "grand c.*9$"
_NOW = B.NOW_SQL


def _match(p: str) -> str:
    return f"(regexp_matches(txt, '{p}') or coalesce(regexp_matches(vtxt, '{p}'), false))"


def _rule(p: str, cats: tuple[str, ...], ex: str | None) -> str:
    hit = _match(p) + (f" or coalesce(category_slug in ({', '.join(repr(c) for c in cats)}), false)" if cats else "")
    return f"({hit})" + (f" and not {_match(ex)}" if ex else "")


def _win(lo: str, hi: str, ongoing: bool, now: bool) -> str:
    return f"start_date <= timestamp '{hi}' and eff >= timestamp '{lo}' and (start_date >= timestamp '{lo}'" + " or long_run" * ongoing + " or not long_run" * now + ")"


_NEAR = (48.88, 2.33, 3.0)
_KM = "111.32 * sqrt(power(lat - 48.88, 2) + power((lng - 2.33) * cos(radians(48.88)), 2))"
# name: (query, SQL over the live rows)
PREDICATES = {
    "flt_01_live": (Q(), "true"),
    "flt_02_window_tonight": (Q(when="tonight"), _win("1998-06-15 16:00:00", "1998-06-16 02:00:00", False, True) + " and not (coalesce(end_date > start_date + interval 60 day, false) and (category_slug is null or category_slug in ('ateliers', 'conferences', 'visites')))"),
    "flt_02_window_weekend": (Q(when="weekend"), _win("1998-06-19 16:00:00", "1998-06-22 02:00:00", True, False)),
    "flt_02_window_next3h": (Q(when="next3h"), _win("1998-06-15 16:00:00", "1998-06-15 19:00:00", False, True)),
    "flt_02_window_date": (Q(when="1998-07-01"), _win("1998-07-01 04:00:00", "1998-07-02 02:00:00", True, False)),
    "flt_03_category_in": (Q(categories=("concerts", "expos")), "category_slug in ('concerts', 'expos')"),
    "flt_03_category_not_in": (Q(exclude_categories=("cinema", "sport")), "category_slug is null or category_slug not in ('cinema', 'sport')"),
    "flt_04_exclude_title": (Q(exclude_title="THÉÂTRE 71 3"), "lower(title) <> 'théâtre 71 3'"),
    "flt_05_tonight_no_classes": (Q(when="tonight", categories=L.CLASSES), _win("1998-06-15 16:00:00", "1998-06-16 02:00:00", False, True) + " and category_slug in ('ateliers', 'conferences', 'visites') and not coalesce(end_date > start_date + interval 60 day, false)"),
    "flt_06_arrondissement": (Q(arrondissements=("1er", "11e")), "arrondissement in ('1er', '11e')"),
    "flt_07_free": (Q(free=True), "price_status = 'free'"),
    "flt_08_max_price": (Q(max_price=20.5), "price_status = 'free' or (price_status = 'paid' and price_min <= 2050)"),
    "flt_09_runs_ending": (Q(runs_ending_within_days=7), f"long_run and end_date <= {_NOW} + interval 7 day"),
    "flt_10_one_off": (Q(one_off_only=True), "not long_run"),
    "flt_11_with_image": (Q(with_image=True), "image_url is not null"),
    "flt_12_venue_slug": (Q(venue_slug="v-25"), "venue_slug = 'v-25'"),
    "flt_13_signature": (Q(signature_only=True), f"coalesce(regexp_matches(vtxt, '{SIGNATURE}'), false)"),
    "flt_14_ids": (Q(ids=tuple(range(0, 900, 7)), exclude_ids=(14, 21)), "id % 7 = 0 and id < 900 and id not in (14, 21)"),
    "flt_14_ids_empty": (Q(ids=()), "false"),
    "flt_16_topic_humour": (Q(topics=("humour",)), _rule(*L.TOPICS["humour"])),
    "flt_17_tokens_word": (Q(q="Metal à Paris"), _match(r"\bmetal\b")),
    "flt_18_tokens_text_or_venue": (Q(q="théatre soirée"), _match("theatre") + " and " + _match("soiree")),
    "flt_19_geo_radius": (Q(near=_NEAR), f"lat is not null and {_KM} <= 3"),
} | {f"flt_15_intent_{i.replace('-', '_')}": (Q(intents=(i,)), _rule(*r)) for i, r in L.INTENTS.items()}


def _predicate(name: str, q: L.EventQuery, sql: str) -> None:
    @query(name, f"{B.BASE} select id, start_date from live where {sql}")
    def run(spark, sf_dir):
        return B.rows(spark, sf_dir).where(L.condition(q, B.NOW, SIGNATURE)).select("id", "start_date")


for _name, (_q, _sql) in PREDICATES.items():
    _predicate(_name, _q, _sql)

_REL = f"""(quality_score::double + case when venue_name is null then -4 when arrondissement is not null or coalesce(zip_code like '75%', false) then 0 else -10 end
  + case when coalesce(regexp_matches(vtxt, '{SIGNATURE}'), false) then 6 else 0 end
  + case when category_slug in ('concerts', 'expos', 'theatre', 'spectacles', 'danse', 'festivals') then 4 when category_slug is null then -4 else 0 end
  + least(save_count * 3 + view_count // 25, 25) + case when image_url is null then -25 else 0 end + case when time_known then 0 else -8 end
  + case when price_status = 'unknown' then -4 else 0 end + case when long_run then -6 else 0 end
  - least(greatest(epoch_us(start_date) / 1e6 - epoch_us({_NOW}) / 1e6, 0) / 86400, 30) * 0.8)"""
SORTS = {
    "srt_01_relevance": (Q(), f"round({_REL}, 6) desc, id"),
    "srt_02_soon": (Q(sort="soon"), f"case when start_date < {_NOW} then 1 else 0 end, start_date, id"),
    "srt_03_popular": (Q(sort="popular"), "save_count * 3 + view_count desc, id"),
    "srt_04_ending": (Q(sort="ending"), "eff, id"),
    "srt_05_distance": (Q(near=_NEAR), f"{_KM}, start_date, id"),
    "srt_06_random": (Q(sort="random"), f"md5(id::varchar || '{int(B.NOW.timestamp()) // 3600}'), id"),
    "srt_11_page_two": (Q(sort="soon", limit=10, offset=20), f"case when start_date < {_NOW} then 1 else 0 end, start_date, id"),
}


def _sorted(name: str, q: L.EventQuery, order: str) -> None:
    q = L.replace(q, group_films=False)
    where = f"lat is not null and {_KM} <= 3" if q.near else "true"

    @query(name, f"{B.BASE} select id, title, start_date from live where {where} order by {order} limit {q.limit + 1} offset {q.offset}")
    def run(spark, sf_dir):
        return L.listing(B.rows(spark, sf_dir), q, B.NOW, SIGNATURE).select("id", "title", "start_date")


for _name, (_q, _sql) in SORTS.items():
    _sorted(_name, _q, _sql)

_KEY = f"trim(regexp_replace({B.FOLD_SQL.format('title')}, '[^a-z0-9]+', '-', 'g'), '-')"


@query("min_slice", f"""{B.BASE} select id, title, category_slug, venue_name, price_min, round({_REL}, 6) score from live
  where {_win('1998-06-15 16:00:00', '1998-06-23 02:00:00', True, True).replace('1998-06-23', '1998-06-22')} and category_slug in ('concerts', 'theatre', 'expos')
  and (price_status = 'free' or (price_status = 'paid' and price_min <= 6000)) order by score desc, id limit 25""")
def min_slice(spark, sf_dir):
    q = Q(when="week", categories=("concerts", "theatre", "expos"), max_price=60)
    page = L.listing(B.rows(spark, sf_dir), q, B.NOW, SIGNATURE)
    return page.select("id", "title", "category_slug", "venue_name", "price_min", F.round(L.relevance(B.NOW, SIGNATURE), 6).alias("score"))


@query("agg_01_film_grouping", f"""{B.BASE} select {_KEY} film_key, arg_min(id, (start_date, id)) film_best, count(*) film_n, count(distinct venue_id) film_m,
  array_to_string(list_transform(list_sort(list(start_date))[1:4], lambda x: strftime(x, '%Y-%m-%d')), ',') film_times, arg_min(image_url, (start_date, id)) filter (image_url is not null) film_image
  from live where category_slug = 'cinema' group by 1""")
def film_grouping(spark, sf_dir):
    out = L.films(B.rows(spark, sf_dir).where(L.condition(Q(), B.NOW)))
    return out.withColumn("film_times", F.array_join(F.transform("film_times", lambda t: F.date_format(t, "yyyy-MM-dd")), ","))


@query("agg_02_total", f"""{B.BASE} select count(*) filter (category_slug is distinct from 'cinema') + count(distinct case when category_slug = 'cinema' then {_KEY} end) total from live""")
def total(spark, sf_dir):
    return L.total(B.rows(spark, sf_dir), Q(), B.NOW)


@query("jon_04_films_joined", f"""{B.BASE}, f as (select arg_min(id, (start_date, id)) best, count(*) n from live where category_slug = 'cinema' group by {_KEY})
  select id, title, n film_n from live left join f on best = id where category_slug is distinct from 'cinema' or best is not null order by start_date, id limit 101""")
def films_joined(spark, sf_dir):
    found = B.rows(spark, sf_dir).where(L.condition(Q(), B.NOW))
    best = L.films(found).select(F.col("film_best").alias("id"), "film_n")
    return found.join(best, "id", "left").where(~F.col("category_slug").eqNullSafe("cinema") | F.col("film_n").isNotNull()).orderBy("start_date", "id").limit(101).select("id", "title", "film_n")


@query("jon_01_read_join", f"{B.BASE} select id, venue_name, arrondissement, category_slug from r")
def read_join(spark, sf_dir):
    return B.rows(spark, sf_dir).select("id", "venue_name", "arrondissement", "category_slug")


@query("prj_01_card_columns", f"""{B.BASE} select id, slug, title, short_desc, image_url, start_date, end_date, time_known, price_min, price_max, price_status, save_count, quality_score,
  category_slug, venue_name, venue_slug, arrondissement, city, zip_code, lat, lng from live""")
def card_columns(spark, sf_dir):
    return B.rows(spark, sf_dir).where(L.live(B.NOW)).select("id", "slug", "title", "short_desc", "image_url", "start_date", "end_date", "time_known", "price_min", "price_max", "price_status", "save_count", "quality_score", "category_slug", "venue_name", "venue_slug", "arrondissement", "city", "zip_code", "lat", "lng")


@query("prj_02_card", f"""{B.BASE} select id, title, category_slug category, venue_name venue, case when arrondissement is null and not coalesce(zip_code like '75%', false) then case when venue_name is not null then city end end town, round({_KM}, 1) distance_km from live""")
def cards(spark, sf_dir):
    found = B.rows(spark, sf_dir).where(L.live(B.NOW))
    out = L.card(found).join(found.select("id", F.round(geo.flat_km(F.col("lat"), F.col("lng"), 48.88, 2.33), 1).alias("distance_km")), "id")
    return out.select("id", "title", F.col("category.slug").alias("category"), F.col("venue.name").alias("venue"), F.col("venue.city").alias("town"), "distance_km")


@query("prj_03_flags", f"{B.BASE} select id, eff < {_NOW} ended, start_date <= {_NOW} started, start_date <= {_NOW} and eff >= {_NOW} open from r")
def flags(spark, sf_dir):
    now, s, e = times.stamp(B.NOW), F.col("start_date"), F.col("end_date")
    return B.outings(spark, sf_dir).select("id", (times.effective_end(s, e) < now).alias("ended"), (s <= now).alias("started"), times.ongoing(s, e, now).alias("open"))


@query("flt_20_cleanup_regex", f"{B.BASE} select id, title from r where regexp_matches(title, '(?i)électro|MÉTALLOS')")
def cleanup(spark, sf_dir):
    return B.outings(spark, sf_dir).where(F.col("title").rlike("(?iu)électro|MÉTALLOS")).select("id", "title")


@query("flt_26_prefix", f"{B.BASE} select venue_id, venue_name from venues where vtxt_(venue_name) like 'theatre c%' or vtxt_(venue_name) like '% customer#0000001%'".replace("vtxt_(venue_name)", B.FOLD_SQL.format("venue_name")))
def prefix(spark, sf_dir):
    folded = text.fold(F.col("venue_name"))
    return B.venues(spark, sf_dir).where(folded.startswith("theatre c") | folded.contains(" customer#0000001")).select("venue_id", "venue_name")


@query("flt_27_work_key", f"{B.BASE} select id, title from live where {_KEY} = 'l-invitation-3'")
def work_key(spark, sf_dir):
    return B.rows(spark, sf_dir).where(L.live(B.NOW) & (text.slug(F.col("title")) == "l-invitation-3")).select("id", "title")


@query("flt_28_recency_or", f"{B.BASE} select id from r where (start_date > {_NOW} - interval 7 day and start_date <= {_NOW}) or (end_date between {_NOW} - interval 12 hour and {_NOW} + interval 36 hour)")
def recency(spark, sf_dir):
    n, s, e = times.stamp(B.NOW), F.col("start_date"), F.col("end_date")
    h = lambda x: F.expr(f"interval '{x}' hour")
    return B.outings(spark, sf_dir).where(((s > n - h(168)) & (s <= n)) | e.between(n - h(12), n + h(36))).select("id")


@query("srt_07_prefix_first", f"select p_partkey, p_name from part order by case when p_name like 'red%' then 0 else 1 end, length(p_name), p_name, p_partkey limit 40")
def prefix_first(spark, sf_dir):
    return B.read(spark, sf_dir, "part").orderBy(F.col("p_name").startswith("red").desc(), F.length("p_name"), "p_name", "p_partkey").limit(40).select("p_partkey", "p_name")


@query("srt_10_nulls_first", f"{B.BASE} select id, end_date from r order by end_date nulls first, quality_score > 50 desc, id limit 50")
def nulls_first(spark, sf_dir):
    return B.outings(spark, sf_dir).orderBy(F.col("end_date").asc_nulls_first(), (F.col("quality_score") > 50).desc(), "id").limit(50).select("id", "end_date")


_WINDOWS = {
    "tonight": _win("1998-06-15 16:00:00", "1998-06-16 02:00:00", False, True) + " and not coalesce(end_date > start_date + interval 60 day and (category_slug is null or category_slug in ('ateliers', 'conferences', 'visites')), false)",
    "weekend": _win("1998-06-19 16:00:00", "1998-06-22 02:00:00", True, False), "week": _win("1998-06-15 16:00:00", "1998-06-22 02:00:00", True, True),
}
_ORDERS = {None: f"round({_REL}, 6) desc", "popular": "save_count * 3 + view_count desc", "ending": "eff", "random": f"md5(id || '{int(B.NOW.timestamp()) // 3600}')"}


def _named_sql(q: L.EventQuery) -> str:
    terms = [_WINDOWS[q.when] if q.when else "true", "price_status = 'free'" if q.free else "true", "image_url is not null" if q.with_image else "true", "not long_run" if q.one_off_only else "true"]
    if q.runs_ending_within_days:
        terms.append(f"long_run and end_date <= {_NOW} + interval {q.runs_ending_within_days} day")
    terms += [_rule(*L.INTENTS[i]) for i in q.intents] + [_rule(*L.TOPICS[i]) for i in q.topics]
    return f"""{B.BASE}, f as (select *, row_number() over (partition by category_slug = 'cinema', {_KEY} order by start_date, id) rn from live where {' and '.join(f'({x})' for x in terms)})
      select id, title, start_date, venue_name venue from f where category_slug is distinct from 'cinema' or rn = 1 order by {_ORDERS[q.sort]}, id limit {q.limit + 1}"""


for _name, _q in L.NAMED.items():

    def _named(name: str, q: L.EventQuery) -> None:
        @query(f"named_{name.replace('-', '_')}", _named_sql(q))
        def run(spark, sf_dir):
            return L.card(L.listing(B.rows(spark, sf_dir), q, B.NOW, SIGNATURE)).select("id", "title", "start_date", F.col("venue.name").alias("venue"))

    _named(_name, _q)
