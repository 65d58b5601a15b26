"""Queries: pages, selections, ingest steps and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import editorial, etl, geocoding, members, pages
from . import bindings as B
from .registry import query

c = F.col
t = B.read
N = B.NOW_SQL


@query("pag_01_home")
def pag_01(s, d):
    return pages.home(B.rows(s, d), B.NOW, "theatre")


_EVENT = f"""{B.BASE}, w as (select *, regexp_replace(regexp_replace({B.FOLD_SQL.format('title')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') work from live), me as (select id own, category_slug, venue_id, work from w),
  ar as (select distinct l_orderkey id, l_suppkey artist_key from lineitem)"""


@query("pag_02_event", f"""{_EVENT}, x as (select own, 'similar' block, l.id, (-quality_score)::double o from me join w l on l.category_slug = me.category_slug and l.id <> own union all select own, 'venue', l.id, epoch(start_date) from me join w l on l.venue_id = me.venue_id and l.id <> own
    union all select own, 'work', l.id, epoch(start_date) from me join w l on l.work = me.work and l.id <> own union all select distinct own, 'artists', w.id, epoch(w.start_date) from me join ar a on a.id = own join ar b on b.artist_key = a.artist_key and b.id <> own join w on w.id = b.id)
  select own page, block, row_number() over (partition by own, block order by o, id) pos, id from x qualify pos <= 6""")
def pag_02_event(s, d):
    rows = B.rows(s, d)
    chosen = rows.select(c("id").alias("page"), "id")
    return pages.event(rows, chosen, t(s, d, "lineitem").select(c("l_orderkey").alias("id"), c("l_suppkey").alias("artist_key")), B.NOW)


# ---------------------------------------------------------------- editorial


@query("srt_09_editorial_candidates", f"{B.BASE} select id from live where quality_score >= 40 and category_slug is distinct from 'cinema' order by coalesce(venue_id % 3 = 0, false) desc, quality_score desc, image_url is not null desc, save_count desc, start_date, id limit 200")
def srt_09(s, d):
    from ..operators import listing as L

    rows = B.rows(s, d).where(L.live(B.NOW) & (c("quality_score") >= 40) & ~c("category_slug").eqNullSafe("cinema"))
    return rows.orderBy(*editorial.candidate_order(c("venue_id") % 3 == 0)).limit(200).select("id")


@query("srt_13_random_sample", "select p_partkey from part order by md5('7:' || p_partkey), p_partkey limit 50")
def srt_13(s, d):
    return etl.sampled(t(s, d, "part"), "p_partkey", 50, 7).select("p_partkey")


@query("srt_14_bounded_update", f"{B.BASE}, x as (select id from outings where status = 'expired' and image_url is not null order by id limit 5000) select id, case when id in (select id from x) then null else image_url end image_url from outings")
def srt_14(s, d):
    return etl.bounded_update(B.outings(s, d), (c("status") == "expired") & c("image_url").isNotNull(), {"image_url": F.lit(None).cast("string")}, 5_000).select("id", "image_url")


@query("rec_09_selected")
def rec_09(s, d):
    from ..functions import times

    rows = B.rows(s, d)
    none = s.createDataFrame([], "kind string, value string")
    return editorial.selected(editorial.eligible(rows, none, times.window("week", B.NOW)), "theatre", "week")


_TOPS = {"saves": "count(*) filter (event_type = 'click') + 2 * count(*) filter (event_type = 'purchase')", "views": "count(*) filter (event_type = 'view')", "clicks": "count(*) filter (event_type = 'click')", "mean": "round(avg(value), 6)"}


@query("srt_08_tops", "with x as (select event_id % 300 id, " + ", ".join(f"{sql}::double {k}" for k, sql in _TOPS.items()) + ", count(*) n from events group by 1) " + " union all ".join(f"(select '{k}' as \"by\", id, row_number() over (order by {k} desc, {'n desc, ' if k == 'mean' else ''}id) pos from x qualify pos <= 8)" for k in _TOPS))
def srt_08_tops(s, d):
    k = lambda x: F.count_if(c("event_type") == x)
    x = t(s, d, "events").groupBy((c("event_id") % 300).alias("id")).agg((k("click") + 2 * k("purchase")).cast("double").alias("saves"), k("view").cast("double").alias("views"), k("click").cast("double").alias("clicks"), F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))
    return members.tops(x, {"saves": ["saves"], "views": ["views"], "clicks": ["clicks"], "mean": ["mean", "n"]}, 8)


# ---------------------------------------------------------------- ingest


@query("src_07_keyset_pages", "select o_orderkey id, o_totalprice v from orders")
def src_07(s, d):
    o = t(s, d, "orders").select(c("o_orderkey").alias("id"), c("o_totalprice").alias("v"))
    page = etl.keyset(o, "id")
    pages_ = [o.where("id % 3 <> 2").withColumn("page", F.lit(0)), o.where("id % 3 <> 0").withColumn("page", F.lit(1)), page.withColumn("page", F.lit(2))]
    return etl.merged_pages(pages_, "id", "page")


@query("src_09_agendas", "with x as (select o_orderkey % 5000 sid, o_custkey % 4 agenda, o_orderdate start_date from orders) select sid source_id, min(agenda) agenda, arg_min(start_date, (agenda, start_date)) start_date from x group by 1")
def src_09_agendas(s, d):
    x = t(s, d, "orders").select((c("o_orderkey") % 5000).alias("source_id"), (c("o_custkey") % 4).alias("agenda"), c("o_orderdate").alias("start_date"))
    return etl.one_each([x.where(c("agenda") == a) for a in range(4)], "source_id", ["agenda", "start_date"])


@query("snk_01_inserted", "with n as (select c_custkey k, 's' || (c_custkey % 400) slug from customer), r as (select *, row_number() over (partition by slug order by k) rn from n) select k, slug from r where rn = 1 and slug not in (select 's' || s_suppkey from supplier where s_suppkey < 5)")
def snk_01(s, d):
    n = t(s, d, "customer").select(c("c_custkey").alias("k"), F.concat(F.lit("s"), (c("c_custkey") % 400).cast("string")).alias("slug"))
    return etl.insertable(n, t(s, d, "supplier").where("s_suppkey < 5").select(F.concat(F.lit("s"), c("s_suppkey").cast("string")).alias("slug")), "slug", "k")


@query("snk_02_updates", "select c_custkey k from customer where c_custkey % 3 = 0 and ((case when c_custkey % 7 = 0 then null else c_name end) is distinct from c_name or (c_acctbal + case when c_custkey % 5 = 0 then 1 else 0 end) is distinct from c_acctbal)")
def snk_02(s, d):
    x = t(s, d, "customer").select(c("c_custkey").alias("k"), c("c_name").alias("name"), c("c_acctbal").alias("bal"))
    new = x.where("k % 3 = 0").select("k", F.when(c("k") % 7 != 0, c("name")).alias("name"), (c("bal") + F.when(c("k") % 5 == 0, 1).otherwise(0)).alias("bal"))
    return etl.changed(x, new, ["k"], ["name", "bal"]).select("k")


@query("snk_06_full_push", f"{B.BASE} select id, slug, title from live")
def snk_06(s, d):
    from ..operators import listing as L

    return etl.search_documents(B.rows(s, d).where(L.live(B.NOW))).select("id", "slug", "title")


@query("df_05_planned", """with n as (select c_custkey source_id, 'src' || (c_custkey % 3) source, c_acctbal v from customer where c_acctbal > 0), k as (select c_custkey source_id, 'src' || (c_custkey % 3) source, case when c_custkey % 4 = 0 then c_acctbal else 0 end v from customer where c_custkey % 3 <> 0)
  select n.source, n.source_id, case when k.source_id is null then 'insert' when k.v is distinct from n.v then 'update' else 'keep' end plan from n left join k using (source, source_id)""")
def df_05(s, d):
    x = t(s, d, "customer").select(c("c_custkey").alias("source_id"), F.concat(F.lit("src"), (c("c_custkey") % 3).cast("string")).alias("source"), c("c_acctbal").alias("v"))
    known = x.where("source_id % 3 <> 0").withColumn("v", F.when(c("source_id") % 4 == 0, c("v")).otherwise(F.lit(0).cast(x.schema["v"].dataType)))
    return etl.planned(x.where("v > 0"), known, ["source", "source_id"], ["v"])


@query("df_08_rejects", "select c_custkey id, case when c_custkey % 6 = 0 then 'bad_number' when c_custkey % 10 = 0 then 'no_title' end reason from customer where c_custkey % 6 = 0 or c_custkey % 10 = 0")
def df_08(s, d):
    k = c("c_custkey")
    rows = t(s, d, "customer").select(k.alias("id"), F.when(k % 10 != 0, c("c_name")).alias("title"), F.when(k % 6 == 0, "12,x").otherwise(F.concat(k.cast("string"), F.lit(".5"))).alias("amount"))
    return etl.isolated(rows, {"bad_number": F.expr("try_cast(amount as double)").isNull(), "no_title": c("title").isNull()})[1].select("id", "reason")


@query("snk_07_run_log", "with r as (select event_id run, ts started, case when event_id % 4 > 0 then ts + interval 30 minute end finished from events) select run, case when finished is not null then 'success' when started < timestamp '2024-01-20' - interval 2 hour then 'failed' else 'running' end status from r")
def snk_07(s, d):
    from datetime import UTC, datetime

    e = t(s, d, "events")
    log = e.select(c("event_id").alias("run"), c("ts").alias("started"))
    done = e.where("event_id % 4 > 0").select(c("event_id").alias("run"), (c("ts") + F.expr("interval '30' minute")).alias("finished"), F.lit("success").alias("status"))
    return etl.closed_runs(log, done, datetime(2024, 1, 20, tzinfo=UTC)).select("run", "status")


# ---------------------------------------------------------------- lookups

_FEATURES = """x as (select c_custkey k, unnest([0, 1, 2]) i from customer), f as (select k, i, ((k * 7 + i * 31) % 100) / 100.0 score, case when (k + i) % 5 = 0 then 'municipality' when (k + i) % 3 = 0 then 'street' else 'housenumber' end kind, 48.70::double + (k % 50) * 0.01::double lat, 2.1::double + (k % 60) * 0.01::double lng, case when k % 9 = 0 then '69001' else '750' || lpad((k % 20 + 1)::varchar, 2, '0') end zip from x)"""


@query("geo_05_chosen_feature", f"""with {_FEATURES} select k, arg_min(i, i) feature from f where score >= {geocoding.LEAST_SCORE} and kind in ({', '.join(f"'{x}'" for x in geocoding.KINDS)}) and lat between 48.70 and 49.01 and lng between 2.14 and 2.64 and left(zip, 2) in ('75', '92', '93', '94') group by 1""")
def geo_05(s, d):
    k, i = c("k"), c("rank")
    x = t(s, d, "customer").select(c("c_custkey").alias("k"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("rank"))
    f = x.select("k", "rank", ((k * 7 + i * 31) % 100 / 100.0).alias("score"), F.when((k + i) % 5 == 0, "municipality").when((k + i) % 3 == 0, "street").otherwise("housenumber").alias("kind"), (48.70 + (k % 50) * 0.01).alias("lat"), (2.1 + (k % 60) * 0.01).alias("lng"), F.when(k % 9 == 0, "69001").otherwise(F.concat(F.lit("750"), F.lpad((k % 20 + 1).cast("string"), 2, "0"))).alias("zip_code"))
    return geocoding.chosen(f.withColumns({"street": F.lit(None).cast("string"), "venue_name": F.lit(None).cast("string")}), "k").select("k", c("rank").alias("feature"))


@query("txt_20_legacy_tags", f"""{B.BASE}, x as (select id, lower(title || ' ' || coalesce(short_desc, '')) w from r), g as (select id, unnest([{', '.join(f"case when {' or '.join(f'contains(w, {chr(39)}{x}{chr(39)})' for x in terms)} then {B._list([k, *terms])} else [] end" for k, terms in editorial.TAG_GROUPS.items())}]) l from x)
  select id, array_to_string(list_sort(list_distinct(flatten(list(l))))[1:30], ',') tags from g group by 1""")
def txt_20(s, d):
    words = F.lower(F.concat_ws(" ", c("title"), F.coalesce("short_desc", F.lit(""))))
    return B.rows(s, d).select("id", F.array_join(editorial.legacy_tags(words), ",").alias("tags"))


@query("df_01_made_events", f"""select o_orderkey id, 'Concert ' || o_orderpriority title, o_orderdate + interval 18 hour start_date, true time_known, (o_orderkey % 90 * 100)::int price_min, case when o_orderkey % 90 = 0 then 'free' else 'paid' end price_status, '750' || lpad((o_orderkey % 20 + 1)::varchar, 2, '0') venue_zip, o_orderkey % 4 = 0 is_online,
  case when o_orderkey % 5 > 0 then 's' || o_orderkey end source_id from orders""")
def df_01(s, d):
    k = c("o_orderkey")
    raw = t(s, d, "orders").select(
        k.alias("id"), F.lit("src1").alias("source"), F.when(k % 5 > 0, F.concat(F.lit("s"), k.cast("string"))).alias("source_id"), F.concat(F.lit("  Concert  "), c("o_orderpriority")).alias("title"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T18:00:00Z")).alias("start"),
        F.lit(None).cast("string").alias("end"), (k % 90).cast("string").alias("price"), F.when(k % 4 == 0, "Webinaire Zoom").otherwise("Salle").alias("venue_name"), F.concat(F.lit("Paris 750"), F.lpad((k % 20 + 1).cast("string"), 2, "0")).alias("venue_zip"),
    )
    out = etl.made_events(raw)
    own = F.when((c("id") % 5 > 0) | (F.length("source_id") != 16), c("source_id"))  # ids made from the content have sixteen digits
    return out.select("id", "title", "start_date", "time_known", "price_min", "price_status", "venue_zip", "is_online", own.alias("source_id"))
