"""Queries: editorial selection, detectors, signals, resolution by stages, cleanups and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, times
from ..operators import cleanup, editorial, listing
from . import bindings as B
from .registry import query

c = F.col
t = B.read
FOLD = B.FOLD_SQL


@query("flt_21_array_membership", "select user_id, bool_or(event_type = 'signup') has, not bool_or(event_type = 'error') lacks from events group by 1")
def flt_21(s, d):
    k = t(s, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    return k.select("user_id", F.array_contains("k", "signup").alias("has"), (~F.array_contains("k", "error")).alias("lacks"))


@query("flt_22_visible", "select o_orderkey from orders where o_orderstatus not in ('F', 'P')")
def flt_22(s, d):
    return t(s, d, "orders").where(~c("o_orderstatus").isin("F", "P")).select("o_orderkey")


@query("flt_23_articles", "select doc_id, source from documents where lang = 'fr' and source in ('src0', 'src1') order by doc_id desc limit 20 offset 5")
def flt_23(s, d):
    return t(s, d, "documents").where((c("lang") == "fr") & c("source").isin("src0", "src1")).orderBy(c("doc_id").desc()).offset(5).limit(20).select("doc_id", "source")


@query("flt_24_due_posts", "select event_id from events where ts <= timestamp '2024-01-10' and (event_type = 'signup' or (event_type = 'error' and event_id % 5 < 3))")
def flt_24(s, d):
    return t(s, d, "events").where((c("ts") <= F.lit("2024-01-10").cast("timestamp_ntz")) & ((c("event_type") == "signup") | ((c("event_type") == "error") & (c("event_id") % 5 < 3)))).select("event_id")


_ELIGIBLE = f"""status = 'active' and coalesce(category_slug <> 'cinema', true) and venue_name is not null and (arrondissement is not null or coalesce(regexp_matches(zip_code, '^(75|92|93|94)[0-9]{{3}}$'), false)) and quality_score >= 70 and title not like 'Forum senior%'
  and venue_id % 23 <> 0 and source <> 'src3' and id % 41 <> 0 and case when long_run then end_date >= {B.NOW_SQL} else time_known and start_date between {B.NOW_SQL} and {B.NOW_SQL} + interval 30 day end"""


def _exclusions(s, d):
    v = B.venues(s, d).where("venue_id % 23 = 0").select(F.lit("venue").alias("kind"), c("venue_id").cast("string").alias("value"))
    e = B.outings(s, d).where("id % 41 = 0").select(F.lit("event").alias("kind"), c("id").cast("string").alias("value"))
    return v.unionByName(e).unionByName(s.createDataFrame([("source", "src3")], "kind string, value string"))


@query("flt_25_editorial_eligible", f"{B.BASE} select id from r where {_ELIGIBLE}")
def flt_25(s, d):
    w = times.window("month", B.NOW)
    w = times.Window("month", B.NOW, B.NOW.fromtimestamp(B.NOW.timestamp() + 30 * 86_400, B.NOW.tzinfo), w.ongoing)
    return editorial.eligible(B.rows(s, d), _exclusions(s, d), w).select("id")


_SOURCES = ["offi", "paris_opendata", "openagenda", "venue_alpha", "other"]


@query("scr_04_editorial_score", f"""{B.BASE}, x as (select *, ({B._list(_SOURCES)})[id % 5 + 1] src, case when id % 13 = 5 then 'Permanence santé' when id % 13 = 7 then 'Commémoration du 8 mai' else title end ttl from r)
  select id, quality_score + case when coalesce(vtxt like 'le grand%', false) then 25 else 0 end + case when image_url is not null then 10 else 0 end + least(save_count * 2, 20)
  + case when category_slug in ('concerts', 'expos', 'theatre', 'spectacles', 'danse', 'festivals') then 15 when category_slug in ('soirees', 'festivals', 'visites') then 5 else 0 end - case when price_status = 'unknown' then 5 else 0 end - case when arrondissement is null then 5 else 0 end
  - case when long_run then 8 else 0 end + case when price_status = 'paid' then 4 else 0 end + case when src = 'offi' or src like 'venue_%' then 12 when src in ('paris_opendata', 'openagenda') then -6 else 0 end
  - case when ttl like 'Permanence%' or ttl like 'Commémoration%' then 30 else 0 end score from x""")
def scr_04(s, d):
    k = c("id")
    rows = B.rows(s, d).withColumns({"source": F.element_at(F.array(*map(F.lit, _SOURCES)), (k % 5 + 1).cast("int")), "title": F.when(k % 13 == 5, "Permanence santé").when(k % 13 == 7, "Commémoration du 8 mai").otherwise(c("title"))})
    return rows.select("id", editorial.score("^le grand").alias("score"))


@query("rec_08_pick_diverse")
def rec_08(s, d):
    rows = B.rows(s, d).where(listing.live(B.NOW)).withColumn("score", editorial.score("^le grand"))
    return editorial.picked(rows, 8, per_category=2, per_day=2, long_runs=2)


@query("txt_02_fold_ligatures", f"select doc_id, replace(replace({FOLD.format('text')}, 'œ', 'oe'), 'æ', 'ae') folded from documents")
def txt_02(s, d):
    return t(s, d, "documents").select("doc_id", text.fold_ligatures(c("text")).alias("folded"))


@query("txt_05_artist_key", f"select p_partkey, case when length(k) between 2 and 80 then k end k from (select p_partkey, trim(regexp_replace({FOLD.format('p_name')}, '[^a-z0-9]+', ' ', 'g')) k from part)")
def txt_05(s, d):
    return t(s, d, "part").select("p_partkey", text.artist_key(c("p_name")).alias("k"))


@query("txt_13_dated_slug", f"select o_orderkey, left(trim(regexp_replace({FOLD.format('o_orderpriority')}, '[^a-z0-9]+', '-', 'g'), '-'), 90) || '-' || strftime({B.paris_sql('o_orderdate')}, '%Y-%m-%d') slug from orders")
def txt_13(s, d):
    return t(s, d, "orders").select("o_orderkey", F.concat_ws("-", F.left(text.slug(c("o_orderpriority")), F.lit(90)), times.paris_day(c("o_orderdate")).cast("string")).alias("slug"))


@query("txt_23_like_pattern", "select p_partkey from part where p_name like 'r\\_d%' escape '\\' or p_name like '%\\%%' escape '\\' or p_name like 'red%'")
def txt_23(s, d):
    p = lambda q: c("p_name").like(text.like_escaped(q) + "%")
    return t(s, d, "part").where(p("r_d") | c("p_name").contains("%") | p("red")).select("p_partkey")


@query("txt_24_title_has_artist", f"{B.BASE} select o.id, k.k from outings o, (values ('jazz'), ('piano'), ('grand'), ('djs')) k(k) where (' ' || trim(regexp_replace(replace({FOLD.format('title')}, '&', ' et '), '[^a-z0-9]+', ' ', 'g')) || ' ') like '% ' || k.k || ' %'")
def txt_24(s, d):
    o = B.outings(s, d).select("id", text.words_of(c("title")).alias("w"))
    return o.select("id", F.explode(F.array(*map(F.lit, ["jazz", "piano", "grand", "djs"]))).alias("k"), "w").where(text.has_artist(c("w"), c("k"))).select("id", "k")


@query("txt_27_detectors", f"{B.BASE} select id, regexp_matches({FOLD.format('title')}, '\\b(en ligne|webinaire|visio|zoom)\\b') online, title like 'Forum senior%' institutional, regexp_matches(title, '^[^[:alpha:]]*$') junk from outings")
def txt_27(s, d):
    return B.outings(s, d).select("id", editorial.online(c("title")).alias("online"), editorial.institutional(c("title")).alias("institutional"), editorial.junk(c("title")).alias("junk"))


def _at_sql(days: str, hour: int) -> str:
    day = f"(d + to_days(({days})::int))"
    return f"({day} + interval {hour} hour - case when {B.summer_sql(day)} then interval 2 hour else interval 1 hour end)"


@query("dte_04_windows", f"""with o as (select o_orderkey id, o_orderdate + to_minutes((o_orderkey % 96 * 15)::int) n from orders), x as (select *, ({B.paris_sql('n')} - interval 4 hour)::date::timestamp d from o), f as (select *, 5 - isodow(d) fr from x)
  select id, greatest(n, {_at_sql('0', 17)}) tonight_from, {_at_sql('1', 4)} tonight_to, {_at_sql('1', 6)} tomorrow_from, {_at_sql('2', 4)} tomorrow_to, greatest(n, {_at_sql('fr', 18)}) weekend_from, {_at_sql('fr + 3', 4)} weekend_to, {_at_sql('7', 4)} week_to, {_at_sql('30', 4)} month_to, n + interval 2 hour now_to from f""")
def dte_04(s, d):
    o = t(s, d, "orders").select(c("o_orderkey").alias("id"), (c("o_orderdate") + F.expr("make_dt_interval(0, 0, int(o_orderkey % 96 * 15))")).alias("n"))
    w = {k: times.window_columns(k, c("n")) for k in ("tonight", "tomorrow", "weekend", "week", "month", "now")}
    return o.select("id", *(x.alias(f"{k}_{e}") for k in ("tonight", "tomorrow", "weekend") for e, x in zip(("from", "to"), w[k], strict=True)), *(w[k][1].alias(f"{k}_to") for k in ("week", "month", "now")))


@query("dte_10_reinterpreted", f"select event_id, ts - case when {B.summer_sql('ts')} then interval 2 hour else interval 1 hour end fixed from events")
def dte_10(s, d):
    return t(s, d, "events").select("event_id", times.from_paris(c("ts")).alias("fixed"))


@query("num_05_rounding", "select vec_id, round(embedding[1]::double, 1) a, round(embedding[2]::double / 0.002) * 0.002 b from embeddings")
def num_05(s, d):
    e = lambda k: F.element_at("embedding", k).cast("double")
    return t(s, d, "embeddings").select("vec_id", F.round(e(1), 1).alias("a"), (F.round(e(2) / 0.002) * 0.002).alias("b"))


@query("cls_01_label_map", "select p_partkey, coalesce(m.k, n.k) k from part left join (values ('red widget', 'expos'), ('blue bolt', 'sport')) m(l, k) on m.l = p_name left join (values ('ring', 'danse'), ('gear', 'cinema')) n(l, k) on n.l = string_split(p_name, ' ')[2]")
def cls_01(s, d):
    whole, part = {"red widget": "expos", "blue bolt": "sport"}, {"ring": "danse", "gear": "cinema"}
    return t(s, d, "part").select("p_partkey", editorial.label_category(c("p_name"), whole, part).alias("k"))


@query("cls_04_precedence", f"{B.BASE} select id, coalesce(case when title like 'Stand-up%' then 'spectacles' end, case source when 'src1' then 'concerts' end, case when title like 'Exposition%' then 'expos' end, category_slug) k from r")
def cls_04(s, d):
    return B.rows(s, d).select("id", F.coalesce(F.when(c("title").startswith("Stand-up"), "spectacles"), F.when(c("source") == "src1", "concerts"), F.when(c("title").startswith("Exposition"), "expos"), c("category_slug")).alias("k"))


@query("cls_05_single_day_expo", f"{B.BASE} select id, case when category_slug = 'expos' and coalesce(end_date, start_date) < start_date + interval 6 hour then 'visites' else category_slug end k from r")
def cls_05(s, d):
    short = F.coalesce("end_date", "start_date") < c("start_date") + F.expr("interval '6' hour")
    return B.rows(s, d).select("id", F.when((c("category_slug") == "expos") & short, "visites").otherwise(c("category_slug")).alias("k"))


@query("rec_01_merge_signals", """with x as (select user_id, event_type, count(*) filter (event_id % 2 = 0) a, count(*) filter (event_id % 2 = 1) b from events group by 1, 2)
  select user_id, string_agg(event_type || ':' || (a + b), ',' order by event_type) merged from x group by 1""")
def rec_01(s, d):
    n = t(s, d, "events").groupBy("user_id", "event_type").agg(F.count_if(c("event_id") % 2 == 0).alias("a"), F.count_if(c("event_id") % 2 == 1).alias("b"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "a"))).alias("a"), F.map_from_entries(F.collect_list(F.struct("event_type", "b"))).alias("b"))
    both = F.map_zip_with("a", "b", lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    return m.select("user_id", F.array_join(F.array_sort(F.transform(F.map_entries(both), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",").alias("merged"))


@query("rec_13_weekly_drop", "with w as (select user_id, date_trunc('week', ts)::date wk, min(event_id) first from events group by 1, 2) select user_id, wk, first from w where (user_id, wk) not in (select user_id, date_trunc('week', ts)::date from events where event_type = 'purchase')")
def rec_13(s, d):
    e = t(s, d, "events").withColumn("wk", F.date_trunc("week", c("ts").cast("timestamp")).cast("date"))
    done = e.where("event_type = 'purchase'").select("user_id", "wk").distinct()
    return e.groupBy("user_id", "wk").agg(F.min("event_id").alias("first")).join(done, ["user_id", "wk"], "left_anti")


@query("df_05_plan", "select coalesce(a.c_custkey, 0) k, case when b.c_custkey is null then 'insert' else 'update' end plan from customer a left join (select c_custkey from customer where c_custkey % 3 <> 0) b on a.c_custkey = b.c_custkey where a.c_acctbal > 0")
def df_05(s, d):
    x = t(s, d, "customer")
    known = x.where("c_custkey % 3 <> 0").select("c_custkey", F.lit(True).alias("known"))
    return x.where("c_acctbal > 0").join(known, "c_custkey", "left").select(c("c_custkey").alias("k"), F.when(c("known").isNull(), "insert").otherwise("update").alias("plan"))


@query("er_01_venue_resolver", """with v as (select s_suppkey id, 's' || (s_suppkey % 40) nm, s_nationkey zip, round(s_acctbal)::bigint addr from supplier), q as (select c_custkey id, 's' || (c_custkey % 60) nm, c_nationkey zip, round(c_acctbal)::bigint addr from customer),
  a as (select nm, min(id) id from v group by 1), b as (select zip, addr % 50 k, min(id) id from v group by 1, 2)
  select q.id, coalesce(a.id, b.id) venue, case when a.id is not null then 'name' when b.id is not null then 'address' else 'new' end how from q left join a on a.nm = q.nm left join b on b.zip = q.zip and b.k = q.addr % 50 and a.id is null""")
def er_01(s, d):
    v = t(s, d, "supplier").select(c("s_suppkey").alias("id"), F.concat(F.lit("s"), (c("s_suppkey") % 40).cast("string")).alias("name"), c("s_nationkey").alias("zip"), (F.round("s_acctbal").cast("long") % 50).alias("address"))
    q = t(s, d, "customer").select(c("c_custkey").alias("id"), F.concat(F.lit("s"), (c("c_custkey") % 60).cast("string")).alias("name"), c("c_nationkey").alias("zip"), (F.round("c_acctbal").cast("long") % 50).alias("address"))
    return editorial.resolved_venues(q, v, [("name", ["name"]), ("address", ["zip", "address"])])


_ER_17 = {
    "source": ("case id % 9 when 0 then 'paris_opendata' when 1 then 'lebonbon' when 2 then 'eventbrite' when 3 then 'infoconcert' else source end"), "title": "case id % 23 when 0 then 'ANNULÉ - ' || title when 1 then 'Job fair ' || title else title end",
    "description": "case when id % 5 = 0 then 'Entrée 12,50 €' else 'rien' end", "end_date": "case id % 17 when 0 then start_date - interval '3' hour when 1 then start_date - interval '40' hour when 2 then start_date + interval '500' day else end_date end",
    "status": "case when id % 13 = 0 then 'draft' else status end", "is_free": "price_status = 'free'", "price_status": "case when id % 8 = 0 then 'unknown' else price_status end", "price_min": "case when id % 19 = 0 then price_max else price_min end",
    "price_max": "case when id % 19 = 0 then price_min when id % 29 = 0 then 150000 when id % 29 = 1 then 40000 else price_max end", "last_seen_at": "case when id % 2 = 1 then start_date end", "venue_id": "case when id % 4 <> 3 then venue_id end",
    "venue_name": "case id % 37 when 0 then 'Lieu secret' when 1 then 'Salle X, Lyon' when 2 then 'Adresse communiquée après inscription' else venue_name end", "zip_code": "case id % 41 when 0 then '75 018' when 1 then '750009' when 2 then 'à venir' when 3 then '69001' else zip_code end",
    "lat": "case id % 43 when 0 then 48.857 when 1 then 45.0 else lat end", "lng": "case id % 43 when 0 then 2.352 when 1 then 2.3 else lng end", "geocode_status": "'pending'", "has_activity": "id % 3 = 0", "arrondissement": "case when id % 7 <> 0 then arrondissement end",
}
_OPEN_SQL, _IN_SQL = "status in ('active', 'draft')", "coalesce(left(zip_code, 2) in ('75', '92', '93', '94'), false)"
_ARR_SQL = ("arrondissement is null and regexp_matches(zip_code, '^75(0(0[1-9]|1[0-9]|20)|116)$')", {"arrondissement": "case when zip_code[4:5] = '01' then '1er' else ltrim(zip_code[4:5], '0') || 'e' end"}, None)
_UTC_SQL = lambda x: f"({x} - interval 1 hour * (case when {B.summer_sql(f'({x} - interval 3 hour)')} then 2 else 1 end))"
_FREE_OF_PRICE = {"price_status": "'unknown'", "price_min": "0", "price_max": "0", "is_free": "false"}
_CLOCK_SQL = f"strftime({B.paris_sql('start_date')}, '%H:%M:%S')"
_ER_17_RULES = {
    "price_status": ("price_status = 'unknown' and (is_free or price_max > 0 or price_min > 0)", {"price_status": "case when is_free then 'free' else 'paid' end"}, None), "price_order": ("price_min > price_max", {"price_min": "price_max", "price_max": "price_min"}, None),
    "overnight": ("end_date < start_date and end_date + interval 1 day > start_date", {"end_date": "end_date + interval 1 day"}, None), "end_before_start": ("end_date < start_date", {"end_date": "null"}, None),
    "date_only": (f"time_known and (strftime(start_date, '%H:%M:%S') = '00:00:00' or {_CLOCK_SQL} = '00:00:00')", {"time_known": "false"}, None), "arrondissement": _ARR_SQL,
    "middle_of_the_city": ("round(lat, 3) = 48.857 and round(lng, 3) = 2.352", {"lat": "null", "lng": "null", "geocode_status": "'pending'"}, None), "geocoded": ("lat is not null and lng is not null and geocode_status = 'pending'", {"geocode_status": "'ok'"}, None),
    "zone_of_open_data": ("source = 'paris_opendata' and last_seen_at is null", {"start_date": _UTC_SQL("start_date"), "end_date": _UTC_SQL("end_date")}, "tz_fixed"), "expired": (f"status = 'active' and coalesce(end_date, start_date + interval 3 hour) < {B.NOW_SQL} - interval 6 hour", {"status": "'expired'"}, None),
    "editorial": ("source = 'lebonbon' and venue_id is null and status in ('active', 'draft', 'expired')", {"status": "'rejected'"}, "editorial_not_event"), "out_of_region": (f"venue_id is not null and {_OPEN_SQL} and not (lat between 48.12 and 49.24 and lng between 1.44 and 3.56)", {"status": "'rejected'"}, "out_of_zone"),
    "business": (f"{_OPEN_SQL} and source = 'eventbrite' and title like 'Job fair%'", {"status": "'rejected'"}, "off_topic_business"), "not_free": ("source = 'infoconcert' and is_free and description like '%€'", _FREE_OF_PRICE, "free_flag_corrected"),
    "high_price": ("status = 'active' and price_max > 30000", {"status": "'draft'"}, "price_outlier"), "too_long": ("status = 'active' and end_date > start_date + interval 400 day", {"status": "'draft'"}, "duration_outlier"),
    "zip_code": ("not regexp_matches(zip_code, '^[0-9]{5}$')", {"zip_code": "case zip_code when '75 018' then '75018' when '750009' then '75009' end"}, None), "arrondissement_again": _ARR_SQL,
    "placeholder_venue": (f"not has_activity and venue_id is not null and {_OPEN_SQL} and (venue_name = 'Lieu secret' or venue_name like 'Adresse%')", {"status": "'rejected'"}, "placeholder_venue"),
    "out_of_zone": (f"not has_activity and venue_id is not null and {_OPEN_SQL} and not list_contains(reasons, 'out_of_zone') and (coalesce(not {_IN_SQL} and zip_code is not null, false) or coalesce(not (lat between 48.70 and 49.01 and lng between 2.14 and 2.64) and not {_IN_SQL}, false) or venue_name like '%, Lyon')", {"status": "'rejected'"}, "out_of_zone"),
    "called_off": (f"not has_activity and {_OPEN_SQL} and title like 'ANNULÉ%'", {"status": "'cancelled'"}, "title_cancelled"), "absurd_price": (f"price_max > 100000 and price_status <> 'unknown' and {_OPEN_SQL}", _FREE_OF_PRICE, "price_reset"),
    "no_time_given": (f"time_known and {_OPEN_SQL} and {_CLOCK_SQL} in ('00:00:00', '23:59:00')", {"time_known": "false"}, "time_unknown"),
}


def _er_17_sql() -> str:
    out = [f"q as (select * replace ({', '.join(f'{v} as {k}' for k, v in _ER_17.items() if k not in ('description', 'is_free', 'last_seen_at', 'geocode_status', 'has_activity'))}), {', '.join(f'{_ER_17[k]} {k}' for k in ('description', 'is_free', 'last_seen_at', 'geocode_status', 'has_activity'))}, []::varchar[] reasons, []::varchar[] done from r)"]
    last = "q"
    for i, (name, (cond, new, reason)) in enumerate(_ER_17_RULES.items()):
        put = new | {"done": f"list_append(done, '{name}')"} | ({"reasons": f"list_append(reasons, '{reason}')"} if reason else {})
        out.append(f"q{i} as materialized (select * replace ({', '.join(f'case when coalesce({cond}, false) then {v} else {k} end as {k}' for k, v in put.items())}) from {last})")
        last = f"q{i}"
    return f"{B.BASE}, {', '.join(out)}, fin as (select * from {last})"


def _er_17_rows(s, d):
    rows = B.rows(s, d)
    return cleanup.cleaned(rows.select("id", *(F.expr(v).alias(k) for k, v in _ER_17.items()), *(c(x) for x in ("start_date", "time_known"))), cleanup.rules(B.NOW))


@query("er_17_cleanups", f"{_er_17_sql()} select id, status, price_status, price_min, price_max, is_free, start_date, end_date, time_known, zip_code, arrondissement, lat, geocode_status, array_to_string(reasons, ',') reasons, array_to_string(done, ',') cleaned_by from fin")
def er_17(s, d):
    out = _er_17_rows(s, d)
    return out.select("id", "status", "price_status", "price_min", "price_max", "is_free", "start_date", "end_date", "time_known", "zip_code", "arrondissement", "lat", "geocode_status", F.array_join("reasons", ",").alias("reasons"), F.array_join("cleaned_by", ",").alias("cleaned_by"))


@query("er_17_counts", f"{_er_17_sql()} select unnest(done) as rule, count(*) n from fin group by 1")
def er_17_counts(s, d):
    return cleanup.counts(_er_17_rows(s, d))


@query("er_18_shard_plan")
def er_18(s, d):
    sizes = {r.source: r.n for r in t(s, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("n")).collect()}  # one row a source
    return s.createDataFrame(sorted(editorial.shard_plan(sizes, 4).items()), "source string, shard int")


@query("snk_01_insert_skip", "select c_custkey k from customer where c_custkey % 2 = 0 union select c_custkey from customer where c_custkey % 3 = 0")
def snk_01(s, d):
    x = t(s, d, "customer").select(c("c_custkey").alias("k"))
    old, new = x.where("k % 2 = 0"), x.where("k % 3 = 0")
    return old.unionByName(new.join(old, "k", "left_anti"))


@query("snk_02_changed_rows", "select c_custkey k from customer where (case when c_custkey % 7 = 0 then null else c_name end) is distinct from c_name or (c_acctbal + case when c_custkey % 5 = 0 then 1 else 0 end) is distinct from c_acctbal")
def snk_02(s, d):
    x = t(s, d, "customer")
    new = F.struct(F.when(c("c_custkey") % 7 != 0, c("c_name")), c("c_acctbal") + F.when(c("c_custkey") % 5 == 0, 1).otherwise(0))
    return x.where(~new.eqNullSafe(F.struct("c_name", "c_acctbal"))).select(c("c_custkey").alias("k"))


@query("pag_02_similar", f"{B.BASE}, me as (select * from live where category_slug is not null order by id limit 1) select l.id from live l, me where l.category_slug = me.category_slug and l.id <> me.id order by l.quality_score desc, l.id limit 6")
def pag_02(s, d):
    live = B.rows(s, d).where(listing.live(B.NOW) & c("category_slug").isNotNull())
    me = live.orderBy("id").limit(1).select("category_slug", c("id").alias("me"))
    return live.join(me, "category_slug").where("id <> me").orderBy(c("quality_score").desc(), "id").limit(6).select("id")


@query("rec_11_follow_feed", "with x as (select user_id, event_type, event_id, ts, row_number() over (partition by user_id, event_type order by ts, event_id) turn from events) select user_id, event_id, row_number() over (partition by user_id order by turn, event_type) pos from x qualify pos <= 30")
def rec_11(s, d):
    turn = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    x = t(s, d, "events").select("user_id", "event_type", "event_id", turn.alias("turn"))
    return x.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("turn", "event_type"))).where("pos <= 30").select("user_id", "event_id", "pos")
