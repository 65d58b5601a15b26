"""Queries: alerts by step, signals, plans, picks and relaxation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listing as L
from ..operators import members, personal
from . import bindings as B
from .registry import query

c = F.col
t = B.read
N = B.NOW_SQL

# ---------------------------------------------------------------- alerts

# Keys that members follow here.
KEYS = ["jazz", "soiree jazz", "visite du jardin", "metal", "recital de piano 3", "impro", "monet", "electro dj"]
_KEYS_SQL = B._list(KEYS)


def _follows(s, d):
    o = t(s, d, "orders").where("o_orderkey % 9 = 0")
    key = F.element_at(F.array(*map(F.lit, KEYS)), (c("o_orderkey") % len(KEYS) + 1).cast("int"))
    return o.select(c("o_custkey").alias("user_id"), key.alias("artist_key"), c("o_orderdate").alias("at")).groupBy("user_id", "artist_key").agg(F.min("at").alias("followed_at"))


_WORDS = "trim(regexp_replace(" + B.FOLD_SQL.format("title") + ", '[^a-z0-9]+', ' ', 'g'))"


@query("alr_04_title_fallback", f"""{B.BASE}, f as (select o_custkey user_id, ({_KEYS_SQL})[o_orderkey % {len(KEYS)} + 1] k, min(o_orderdate) followed_at from orders where o_orderkey % 9 = 0 group by 1, 2),
  e as (select id, start_date, start_date - interval 20 day created_at, ' ' || {_WORDS} || ' ' w from r where status = 'active' and canonical_id is null and start_date >= {N} and start_date - interval 20 day >= {N} - interval 168 hour and category_slug in ('concerts', 'festivals') and id % 4 <> 0)
  select distinct user_id, id, 'new_date' kind, start_date from e join f on contains(w, ' ' || k || ' ') and created_at > followed_at""")
def alr_04(s, d):
    rows = B.rows(s, d).withColumn("created_at", c("start_date") - F.expr("interval '20' day"))
    return members.title_items(_follows(s, d), rows, rows.where("id % 4 = 0").select("id"), B.NOW)


def _chosen(s, d):
    """Items made from the events: a user's events of three types, with settings and deliveries."""
    e = t(s, d, "events")
    kind = F.when(c("event_type") == "view", "new_date").when(c("event_type") == "click", "on_sale").when(c("event_type") == "purchase", "reminder")
    items = e.select("user_id", (c("event_id") % 400).alias("id"), kind.alias("kind"), (c("event_id") % 400 * 3 % 90).alias("start_date")).where("kind is not null").distinct()
    delivered = e.where("event_id % 5 = 0").select("user_id", (c("event_id") % 400).alias("id"), kind.alias("kind")).where("kind is not null")
    settings = e.select("user_id").distinct().where("user_id % 4 = 0").select("user_id", F.lit("new_date").alias("kind"), F.lit(False).alias("wanted"))
    return members.selected_items(items, delivered, settings), delivered


_CHOSEN = """with k as (select *, case event_type when 'view' then 'new_date' when 'click' then 'on_sale' when 'purchase' then 'reminder' end kind from events), i as (select distinct user_id, event_id % 400 id, kind, event_id % 400 * 3 % 90 start_date from k where kind is not null),
  dl as (select distinct user_id, event_id % 400 id, kind from k where kind is not null and event_id % 5 = 0),
  ch as (select user_id, kind, id, row_number() over (partition by user_id order by case kind when 'reminder' then 0 when 'on_sale' then 1 else 2 end, start_date, id) pos from i where (user_id, id, kind) not in (select user_id, id, kind from dl) and not (kind = 'new_date' and user_id % 4 = 0) qualify pos <= 20)"""


@query("alr_07_preferences", f"{_CHOSEN} select user_id, kind, id, pos from ch")
def alr_07(s, d):
    return _chosen(s, d)[0]


def _accounts(s, d):
    u = t(s, d, "events").select("user_id").distinct()
    return u.select("user_id", (c("user_id") % 3 != 0).alias("email_enabled"), (c("user_id") % 2 == 0).alias("push_enabled"), (c("user_id") % 7 != 0).alias("has_email"), (c("user_id") % 4).alias("n_push"))


@query("alr_08_batch", f"{_CHOSEN}, u as (select user_id, bool_or(kind <> 'new_date') urgent, user_id % 3 <> 0 and user_id % 7 <> 0 email, user_id % 2 = 0 and user_id % 4 > 0 push from ch group by 1) select user_id, email, push, urgent from u where email or push order by urgent desc, user_id limit 200")
def alr_08(s, d):
    return members.alert_batch(_chosen(s, d)[0], _accounts(s, d))


@query("alr_09_deliveries", f"{_CHOSEN} select distinct user_id, id, kind, 'email' channels from ch where user_id % 3 <> 0")
def alr_09(s, d):
    chosen, delivered = _chosen(s, d)
    sent = _accounts(s, d).select("user_id", F.when(c("email_enabled"), F.array(F.lit("email"))).otherwise(F.array().cast("array<string>")).alias("channels"))
    return members.deliveries(chosen, sent, delivered).withColumn("channels", F.array_join("channels", ","))


@query("rec_12_last_dates", "with m as (select distinct user_id, event_id % 500 id, timestamp '2024-01-10' + to_hours(event_id % 500) starts from events) select user_id, id, row_number() over (partition by user_id order by starts, id) pos from m where starts between timestamp '2024-01-15' and timestamp '2024-01-22' qualify pos <= 12")
def rec_12(s, d):
    from datetime import UTC, datetime

    at = F.lit("2024-01-10").cast("timestamp_ntz") + F.expr("make_dt_interval(0, int(event_id % 500))")
    return members.last_dates(t(s, d, "events").select("user_id", (c("event_id") % 500).alias("id"), at.alias("start_date")), datetime(2024, 1, 15, tzinfo=UTC))


@query("rec_12_pending", "select user_id follow_id, event_id id from events where ts > greatest(case when user_id % 3 = 0 then timestamp '2024-01-12' else timestamp '2024-01-05' end, case when user_id % 2 = 0 then timestamp '2024-01-20' end)")
def rec_12_pending(s, d):
    e = t(s, d, "events")
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    follows = e.select(c("user_id").alias("follow_id")).distinct().select("follow_id", F.when(c("follow_id") % 3 == 0, day("2024-01-12")).alias("last_notified_at"), day("2024-01-05").alias("followed_at"), F.when(c("follow_id") % 2 == 0, day("2024-01-20")).alias("last_seen_at"))
    return members.pending(follows, e.select(c("user_id").alias("follow_id"), c("event_id").alias("id"), c("ts").alias("created_at")))


# ---------------------------------------------------------------- signals and plans

_CATS = L.CATEGORIES


def _interactions(s, d):
    e = t(s, d, "events")
    kind = F.when(c("event_type") == "view", "save").when(c("event_type") == "click", F.when(c("event_id") % 3 == 0, "swipe_left").otherwise("swipe_right")).when(c("event_type") == "purchase", "attend").otherwise("review")
    category = F.when(c("event_id") % 11 != 0, F.element_at(F.array(*map(F.lit, _CATS)), (c("event_id") % len(_CATS) + 1).cast("int")))
    return e.select("user_id", kind.alias("kind"), c("event_id").alias("id"), category.alias("category"), (F.floor(c("value")) % 6).alias("rating"))


_INTER = f"""with i as (select user_id, event_id id, case event_type when 'view' then 'save' when 'click' then case when event_id % 3 = 0 then 'swipe_left' else 'swipe_right' end when 'purchase' then 'attend' else 'review' end kind,
    case when event_id % 11 <> 0 then ({B._list(_CATS)})[event_id % {len(_CATS)} + 1] end cat, floor(value) % 6 rating from events),
  f as (select *, kind in ('save', 'attend', 'swipe_right') or (kind = 'review' and rating >= 4) up, kind = 'swipe_left' or (kind = 'review' and rating <= 2) down from i)"""
_MAP = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",")


@query("rec_06_signals", f"""{_INTER}, n as (select user_id, cat, count(*) filter (up) u, count(*) filter (down) d from f group by 1, 2)
  select user_id, coalesce(string_agg(cat || ':' || u, ',' order by cat) filter (cat is not null and u > 0), '') liked, coalesce(string_agg(cat || ':' || d, ',' order by cat) filter (cat is not null and d > 0), '') disliked,
    (select count(distinct id) from f where f.user_id = n.user_id and kind <> 'review') n_excluded from n group by 1""")
def rec_06(s, d):
    x = personal.signals(_interactions(s, d))
    return x.select("user_id", _MAP("liked").alias("liked"), _MAP("disliked").alias("disliked"), F.size("exclude_ids").cast("long").alias("n_excluded"))


def _known(s, d):
    names = F.array(*map(F.lit, members.ARCHETYPES))
    u = c("user_id")
    scores = F.create_map(*(x for i, k in enumerate(members.DIMENSIONS) for x in (F.lit(k), u * (7 + 6 * i) % 101)))
    return personal.signals(_interactions(s, d)).select(
        "user_id", F.when(u % 3 == 0, F.array(F.lit("expos"), F.lit("nowhere"))).alias("categories"), F.when(u % 4 == 0, F.array(F.lit("chill"))).alias("intents"), F.when(u % 5 == 0, F.array(F.lit("11e"))).alias("arrondissements"),
        "liked", "disliked", (u % 6 == 0).alias("pref_free"), F.when(u % 7 != 0, F.element_at(names, (u % len(members.ARCHETYPES) + 1).cast("int"))).alias("archetype"), scores.alias("scores"),
    )


def _plan_sql() -> str:
    score = {k: f"(user_id * {7 + 6 * i} % 101)" for i, k in enumerate(members.DIMENSIONS)}
    names = list(members.ARCHETYPES)
    arch = f"case when user_id % 7 <> 0 then ({B._list(names)})[user_id % {len(names)} + 1] end"
    aff = ", ".join(f"('{a}', '{s}', {w}, {top - 0.5 * i})" for a, lists in personal.AFFINITIES.items() for w, top in ((0, 2.5), (1, 2.0)) for i, s in enumerate(lists[w]))
    intent = " union all ".join(f"select user_id, '{s}', {w} from u where {score[k]} {'>=' if up else '<='} {x}" for k, up, x, s, w in personal.SCORED)
    return f"""{_INTER}, u as (select distinct user_id from events), a as (select user_id, {arch} archetype from u), aff as (select * from (values {aff}) v(archetype, slug, which, w)),
  n as (select user_id, cat, least(count(*) filter (up), 5) u, least(count(*) filter (down), 5) d from f where cat is not null group by 1, 2),
  cw as (select user_id, 'expos' slug, 3.0 w from u where user_id % 3 = 0 union all select user_id, cat, u - 0.7 * d from n union all select user_id, slug, w from a join aff using (archetype) where which = 0),
  iw as (select user_id, 'chill' slug, 3.0 w from u where user_id % 4 = 0 union all select user_id, slug, w from a join aff using (archetype) where which = 1 union all {intent}),
  cs as (select user_id, slug, sum(w) w from cw group by 1, 2 having sum(w) >= 1), isum as (select user_id, slug, sum(w) w from iw group by 1, 2 having sum(w) >= 1.5),
  ct as (select user_id, string_agg(slug, ',' order by w desc, slug) x from (select *, row_number() over (partition by user_id order by w desc, slug) r from cs) where r <= 3 group by 1),
  it as (select user_id, string_agg(slug, ',' order by w desc, slug) x from (select *, row_number() over (partition by user_id order by w desc, slug) r from isum) where r <= 2 group by 1),
  p as (select u.user_id, coalesce(ct.x, '') categories, coalesce(it.x, '') intents, case when u.user_id % 6 = 0 then 'free' when {score['budget'].replace('user_id', 'u.user_id')} <= 30 then 'cheap' else 'any' end budget from u left join ct on ct.user_id = u.user_id left join it on it.user_id = u.user_id)"""


@query("rec_02_personal_plan", f"{_plan_sql()} select *, categories <> '' or intents <> '' or budget <> 'any' or user_id % 5 = 0 personalized from p")
def rec_02_plan(s, d):
    p = personal.plan(_known(s, d))
    return p.select("user_id", F.array_join("plan_categories", ",").alias("categories"), F.array_join("plan_intents", ",").alias("intents"), "budget", "personalized")


@query("rec_04_reasons", f"""{_plan_sql()}, {B.OUTINGS_SQL}, {B.DIMS_SQL}, o as (select o.*, v.arrondissement, g.category_slug from outings o left join venues v using (venue_id) left join categories g on g.category_id = o.category_id)
  select p.user_id, o.id, case when intents <> '' and o.id % 5 = 0 then 'Ambiance ' || string_split(intents, ',')[1] || ', ton style' when coalesce(list_contains(string_split(categories, ','), o.category_slug), false) then 'Parce que tu aimes ' || o.category_slug
    when p.user_id % 5 = 0 and coalesce(o.arrondissement = '11e', false) then 'Dans ton coin (11e)' when o.price_status = 'free' and budget <> 'any' then 'Gratuit, comme tu préfères' when save_count >= 3 then 'Gardé par ' || save_count || ' membres' when o.price_status = 'free' then 'Gratuit cette semaine'
    when categories <> '' or intents <> '' or budget <> 'any' or p.user_id % 5 = 0 then 'Pour sortir de tes habitudes' else 'Une valeur sûre de la semaine' end reason from p join o on o.venue_id = p.user_id""")
def rec_04(s, d):
    plan = personal.plan(_known(s, d))
    cards = B.rows(s, d).withColumn("user_id", c("venue_id"))
    return cards.join(plan, "user_id").select("user_id", "id", personal.reason(c("id") % 5 == 0).alias("reason"))


_REL = f"""round((quality_score::double + case when (arrondissement is not null or coalesce(zip_code like '75%', false)) then 0 when venue_name is null then -4 else -10 end + case when category_slug in ('concerts', 'expos', 'theatre', 'spectacles', 'danse', 'festivals') then 4 when category_slug is null then -4 else 0 end
    + least(save_count * 3 + floor(view_count / 25), 25) + case when image_url is null then -25 else 0 end + case when time_known then 0 else -8 end + case when price_status = 'unknown' then -4 else 0 end + case when long_run then -6 else 0 end) - least(greatest(date_diff('second', {N}, start_date) / 86400.0, 0.0), 30.0) * 0.8, 6)"""


def _list_sql(where: str, limit: int, l: int) -> str:
    return f"select id, row_number() over (order by rel desc, id) - 1 r, {l} l, category_slug, arrondissement, price_status, image_url from wk where {where} qualify r < {limit}"


@query("rec_05_candidates", f"""{B.BASE}, wk as (select *, {_REL} rel from live where image_url is not null and start_date <= timestamp '1998-06-22 02:00:00'),
  li as ({_list_sql("category_slug in ('concerts', 'expos') and (price_status = 'free' or (price_status = 'paid' and price_min <= 2000))", 40, 0)} union all {_list_sql("arrondissement in ('11e')", 20, 1)} union all {_list_sql('true', 40, 2)}),
  s as (select id, sum(greatest(0.0::double, (40 - r) / 40.0::double) / (l + 1) + 0.25::double) score, any_value(category_slug) c, any_value(arrondissement) a, any_value(price_status) p from li where id % 50 <> 0 group by 1)
  select id, round(score + case c when 'concerts' then 0.6 when 'expos' then 0.45 else 0 end + case when a = '11e' then 0.3 else 0 end + case when p = 'free' then 0.2 else 0 end, 6) score from s""")
def rec_05(s, d):
    rows = B.rows(s, d)
    seen = rows.where(c("id") % 50 == 0).select("id")  # what one member has marked
    found = personal.candidates(rows, ("concerts", "expos"), (), ("11e",), "cheap", seen, B.NOW)
    return found.select("id", F.round("score", 6).alias("score"))


@query("rec_05_picks")
def rec_05_picks(s, d):
    rows = B.rows(s, d)
    return personal.picks(rows, personal.candidates(rows, ("concerts", "expos"), ("chill",), (), "any", None, B.NOW))


@query("rec_10_steps", f"""{B.BASE}, wk as (select *, {_REL} rel from live where start_date <= timestamp '1998-06-22 02:00:00'),
  st as (select 1 st, * from wk where category_slug = 'danse' and arrondissement = '3e' union all select 2, * from wk where category_slug = 'danse' union all select 3, * from wk), n as (select st, count(*) n from st group by 1)
  select id from st where st = (select min(st) from n where n >= 3 or st = 3) order by rel desc, id limit 19""")
def rec_10_steps(s, d):
    asked = L.EventQuery(q="zzz", arrondissements=("3e",), categories=("danse",), when="week", group_films=False)
    return personal.recommended(B.rows(s, d), asked, B.NOW)[0].select("id")


@query("tst_03_summary", "with x as (select user_id, " + ", ".join(f"(user_id * {7 + 6 * i}) % 101 {k}" for i, k in enumerate(members.DIMENSIONS)) + ", (" + B._list(list(members.ARCHETYPES)) + f")[user_id % {len(members.ARCHETYPES)} + 1] a from (select distinct user_id from events)) select user_id, concat_ws(' ', 'Profil « ' || a || ' ».', " + ", ".join(f"case when {k} >= 70 then '{hi}' when {k} <= 30 then '{lo}' end" for k, hi, lo in personal.SENTENCES) + ") summary from x")
def tst_03(s, d):
    u = t(s, d, "events").select("user_id").distinct()
    names = F.array(*map(F.lit, members.ARCHETYPES))
    x = u.select("user_id", *((c("user_id") * (7 + 6 * i) % 101).alias(k) for i, k in enumerate(members.DIMENSIONS)), F.element_at(names, (c("user_id") % len(members.ARCHETYPES) + 1).cast("int")).alias("archetype"))
    return x.select("user_id", personal.taste_summary().alias("summary"))


@query("arr_03_merged_answers", """with e as (select user_id, event_id % 12 q, arg_max(event_type, (ts, event_id)) filter (event_id % 2 = 0) old, arg_max(event_type, (ts, event_id)) filter (event_id % 2 = 1) new from events group by 1, 2)
  select user_id, string_agg(q || ':' || coalesce(new, old), ',' order by q::varchar) answers from e group by 1""")
def arr_03(s, d):
    at = F.struct("ts", "event_id")
    e = t(s, d, "events").groupBy("user_id", (c("event_id") % 12).alias("q")).agg(F.max_by("event_type", F.when(c("event_id") % 2 == 0, at)).alias("old"), F.max_by("event_type", F.when(c("event_id") % 2 == 1, at)).alias("new"))
    made = lambda k: F.map_from_entries(F.collect_list(F.when(c(k).isNotNull(), F.struct("q", k))))
    m = e.groupBy("user_id").agg(made("old").alias("old"), made("new").alias("new"))
    entries = F.transform(F.map_entries(personal.merged_answers(c("old"), c("new"))), lambda x: F.struct(x["key"].cast("string").alias("k"), x["value"].alias("v")))
    return m.select("user_id", F.array_join(F.transform(F.array_sort(entries), lambda x: F.concat_ws(":", x["k"], x["v"])), ",").alias("answers"))


_BASE_SIGNALS = "case when user_id % 3 = 0 then 'expos' when user_id % 2 = 0 then 'danse' else '' end"


@query("rec_01_merged_signals", f"""{_INTER}, n as (select user_id, cat, count(*) filter (up and id % 2 = 0) a, count(*) filter (up and id % 2 = 1) b from f where cat is not null group by 1, 2)
  select user_id, {_BASE_SIGNALS} categories, coalesce(string_agg(cat || ':' || (a + b), ',' order by cat) filter (a + b > 0), '') liked, (select count(distinct id) from f where f.user_id = n.user_id and kind <> 'review') n_excluded from n group by 1""")
def rec_01_merged(s, d):
    x = _interactions(s, d)
    none = F.array().cast("array<string>")
    u = c("user_id")

    def side(rows, categories, name):
        g = personal.signals(rows)
        return g.select("user_id", F.struct(categories.alias("categories"), none.alias("intents"), "liked", "disliked", F.lit(None).cast("string").alias("archetype"), F.lit(None).cast("boolean").alias("pref_free"), "exclude_ids").alias(name))

    a = side(x.where("id % 2 = 0"), F.when(u % 3 == 0, F.array(F.lit("expos"))).otherwise(none), "base")
    b = side(x.where("id % 2 = 1"), F.when(u % 2 == 0, F.array(F.lit("danse"))).otherwise(none), "extra")
    users = x.select("user_id").distinct()
    both = users.join(a, "user_id", "left").join(b, "user_id", "left")
    m = both.select("user_id", personal.merged_signals().alias("m"))
    return m.select("user_id", F.array_join("m.categories", ",").alias("categories"), _MAP("m.liked").alias("liked"), F.size("m.exclude_ids").cast("long").alias("n_excluded"))
