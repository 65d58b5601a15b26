"""Queries: joins, aggregates, set operations, windows and scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, text, times
from ..operators import relational as R
from . import bindings as B
from .registry import query

t = B.read
c = F.col
F0 = B.FOLD_SQL

# ---------------------------------------------------------------- joins


@query("jon_02_inner_category", f"{B.BASE} select category_slug, count(*) n from outings o join categories c using (category_id) group by 1")
def jon_02(s, d):
    return B.outings(s, d).join(B.categories(s, d), "category_id").groupBy("category_slug").agg(F.count(F.lit(1)).alias("n"))


@query("jon_03_geocoded", f"{B.BASE} select o.id, v.lat, v.lng from outings o join venues v using (venue_id) where v.lat is not null")
def jon_03(s, d):
    return B.outings(s, d).join(B.venues(s, d).where("lat is not null"), "venue_id").select("id", "lat", "lng")


@query("jon_05_alias_one_hop", "select a.c_custkey, coalesce(b.c_custkey, a.c_custkey) resolved, coalesce(b.c_name, a.c_name) c_name from customer a left join customer b on b.c_custkey = case when a.c_custkey % 5 = 0 then a.c_custkey + 1 end")
def jon_05(s, d):
    v = t(s, d, "customer").select("c_custkey", "c_name", F.when(c("c_custkey") % 5 == 0, c("c_custkey") + 1).alias("alias"))
    return R.resolved(v, "c_custkey", "alias", ["c_name"]).select("c_custkey", "resolved", "c_name")


@query("jon_06_venue_and_aliases", "select o_orderkey from orders where o_custkey = 26 or o_custkey in (select c_custkey from customer where c_custkey + 1 = 26 and c_custkey % 5 = 0)")
def jon_06(s, d):
    v = t(s, d, "customer").select(c("c_custkey").alias("o_custkey"), F.when(c("c_custkey") % 5 == 0, c("c_custkey") + 1).otherwise(c("c_custkey")).alias("canonical"))
    return t(s, d, "orders").join(v.where("canonical = 26 or o_custkey = 26"), "o_custkey", "left_semi").select("o_orderkey")


@query("jon_07_bridge", "select l_orderkey, l_linenumber, o_orderdate, c_name from lineitem join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey where l_suppkey = 7")
def jon_07(s, d):
    li = t(s, d, "lineitem").where("l_suppkey = 7").select("l_orderkey", "l_linenumber")
    return li.join(t(s, d, "orders"), c("l_orderkey") == c("o_orderkey")).join(t(s, d, "customer"), c("o_custkey") == c("c_custkey"), "left").select("l_orderkey", "l_linenumber", "o_orderdate", "c_name")


@query("jon_08_tag_semijoin", "select p_partkey, p_name from part where exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R' and l_discount > 0.09)")
def jon_08(s, d):
    return t(s, d, "part").join(t(s, d, "lineitem").where("l_returnflag = 'R' and l_discount > 0.09").select(c("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("jon_09_interactions", "select e.event_id, c.c_name from events e join customer c on e.user_id = c.c_custkey where e.event_type = 'purchase'")
def jon_09(s, d):
    return t(s, d, "events").where("event_type = 'purchase'").join(t(s, d, "customer"), c("user_id") == c("c_custkey")).select("event_id", "c_name")


@query("jon_10_reviews_users", "select event_id, value, split_part(c_name, '#', 1) first_name from events join customer on user_id = c_custkey where event_type = 'view' order by event_id limit 50")
def jon_10(s, d):
    return t(s, d, "events").where("event_type = 'view'").join(t(s, d, "customer"), c("user_id") == c("c_custkey")).orderBy("event_id").limit(50).select("event_id", "value", F.substring_index("c_name", "#", 1).alias("first_name"))


@query("jon_11_aggregate_joined", "select c_custkey, c_name, n_name, n from (select o_custkey, count(*) n from orders group by 1) join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey")
def jon_11(s, d):
    n = t(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return n.join(t(s, d, "customer"), c("o_custkey") == c("c_custkey")).join(t(s, d, "nation"), c("c_nationkey") == c("n_nationkey"), "left").select("c_custkey", "c_name", "n_name", "n")


@query("jon_12_left_with_on_predicate", "select n_nationkey, count(c_custkey) n from nation left join customer on c_nationkey = n_nationkey and c_acctbal > 9000 group by 1")
def jon_12(s, d):
    rich = t(s, d, "customer").where("c_acctbal > 9000")
    return t(s, d, "nation").join(rich, c("c_nationkey") == c("n_nationkey"), "left").groupBy("n_nationkey").agg(F.count("c_custkey").alias("n"))


@query("jon_13_count_per_venue", "select c_custkey, coalesce(n, 0) n from customer left join (select o_custkey c_custkey, count(*) n from orders where o_orderstatus = 'P' group by 1) using (c_custkey)")
def jon_13(s, d):
    return R.counted(t(s, d, "customer").select("c_custkey"), t(s, d, "orders").where("o_orderstatus = 'P'").select(c("o_custkey").alias("c_custkey")), "c_custkey")


@query("jon_14_exists_live", f"{B.BASE} select venue_id, venue_name from venues v where exists (select 1 from live l where l.venue_id = v.venue_id)")
def jon_14(s, d):
    from ..operators import listing as L

    return B.venues(s, d).join(B.outings(s, d).where(L.live(B.NOW)).select("venue_id"), "venue_id", "left_semi").select("venue_id", "venue_name")


@query("jon_15_not_exists_chain", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT') and not exists (select 1 from events where user_id = c_custkey and event_type = 'error') and not exists (select 1 from supplier where s_suppkey = c_custkey)")
def jon_15(s, d):
    return R.without(
        t(s, d, "customer").select("c_custkey"), (t(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(c("o_custkey").alias("c_custkey")), "c_custkey"),
        (t(s, d, "events").where("event_type = 'error'").select(c("user_id").alias("c_custkey")), "c_custkey"), (t(s, d, "supplier").select(c("s_suppkey").alias("c_custkey")), "c_custkey"),
    )


@query("jon_16_tuple_not_in", "select l_orderkey, l_linenumber from lineitem where (l_orderkey, l_linenumber) not in (select l_orderkey, l_linenumber from lineitem where l_quantity > 10)")
def jon_16(s, d):
    li = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return li.select("l_orderkey", "l_linenumber").join(li.where("l_quantity > 10"), ["l_orderkey", "l_linenumber"], "left_anti")


@query("jon_17_in_distinct", "select doc_id from documents where source in (select distinct source from documents where lang = 'es' and source like 'src1%')")
def jon_17(s, d):
    x = t(s, d, "documents").select("doc_id", "source", "lang")
    return x.join(x.where(c("source").startswith("src1") & (c("lang") == "es")).select("source").distinct(), "source", "left_semi").select("doc_id")


@query("jon_18_lateral_alias", "select o_orderkey, x.cents, x.cents // 100 euros from orders, lateral (select floor(o_totalprice * 100)::bigint cents) x")
def jon_18(s, d):
    return t(s, d, "orders").select("o_orderkey", F.floor(c("o_totalprice") * 100).alias("cents")).withColumn("euros", F.expr("cents div 100"))


@query("jon_19_update_from", "select o_orderkey, coalesce(case when c_acctbal < 0 then 'draft' end, o_orderstatus) status from orders left join customer on c_custkey = o_custkey")
def jon_19(s, d):
    return t(s, d, "orders").join(t(s, d, "customer"), c("c_custkey") == c("o_custkey"), "left").select("o_orderkey", F.when(c("c_acctbal") < 0, "draft").otherwise(c("o_orderstatus")).alias("status"))


@query("jon_20_key_lookup", "select l.l_orderkey, l.l_linenumber, p.p_name from lineitem l join part p on p.p_partkey = l.l_partkey and p.p_size = l.l_quantity")
def jon_20(s, d):
    return t(s, d, "lineitem").join(t(s, d, "part"), (c("p_partkey") == c("l_partkey")) & (c("p_size").cast("double") == c("l_quantity"))).select("l_orderkey", "l_linenumber", "p_name")


@query("jon_21_ordered_array_agg", "select o_orderkey, coalesce((select string_agg(l_returnflag, ',' order by l_linenumber, l_partkey, l_returnflag) from lineitem where l_orderkey = o_orderkey), '') tags from orders")
def jon_21(s, d):
    tags = t(s, d, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))), lambda x: x["l_returnflag"]), ",").alias("tags"))
    return t(s, d, "orders").select("o_orderkey").join(tags, "o_orderkey", "left").select("o_orderkey", F.coalesce("tags", F.lit("")).alias("tags"))


@query("jon_23_ngram_containment", """with w as (select doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ') w from documents),
  k as (select distinct p_name, string_split(p_name, ' ')[1] k from part), g as (select distinct doc_id, unnest(w) g from w) select doc_id, p_name from g join k on g = k""")
def jon_23(s, d):
    w = t(s, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), " "))).alias("g"))
    k = t(s, d, "part").select("p_name", F.split("p_name", " ")[0].alias("g")).distinct()
    return w.join(k, "g").select("doc_id", "p_name")


@query("jon_24_blocked_self_join", "select a.s_suppkey a, b.s_suppkey b from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey and abs(a.s_acctbal - b.s_acctbal) < 500")
def jon_24(s, d):
    x = t(s, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return R.banded(x, "s_nationkey", "s_acctbal", 500, "s_suppkey").select("a", "b")


@query("jon_25_interval_overlap", f"""{B.BASE}, x as (select id, venue_id, start_date::date s, eff::date e from r) select a.id a, b.id b from x a join x b on a.venue_id = b.venue_id and a.id < b.id and a.s <= b.e and b.s <= a.e""")
def jon_25(s, d):
    x = B.outings(s, d).select("id", "venue_id", c("start_date").cast("date").alias("s"), times.effective_end(c("start_date"), c("end_date")).cast("date").alias("e"))
    return R.overlapping(x, "venue_id", "s", "e", "id").select("a", "b")


@query("jon_26_order_preserving_ids", "select pos, o_orderkey, o_totalprice from (select unnest([7, 3, 99, 3, 12]) k, generate_subscripts([7, 3, 99, 3, 12], 1) - 1 pos) join orders on o_orderkey = k")
def jon_26(s, d):
    ids = s.range(1).select(F.posexplode(F.array(*map(F.lit, [7, 3, 99, 3, 12]))).alias("pos", "k")).select(c("pos").cast("long").alias("pos"), "k")
    return t(s, d, "orders").join(F.broadcast(ids), c("o_orderkey") == c("k")).select("pos", "o_orderkey", "o_totalprice")  # five rows


@query("src_19_inline_arrays", "select unnest([1, 2, 3])::int id, unnest(['a', 'b', 'c']) v")
def src_19(s, d):
    return s.range(1).select(F.inline(F.arrays_zip(F.array(*map(F.lit, [1, 2, 3])).alias("id"), F.array(*map(F.lit, "abc")).alias("v")))).toDF("id", "v")


# ---------------------------------------------------------------- aggregates


@query("agg_03_count_per_category", f"{B.BASE} select category_slug, count(*) n from live where category_slug is not null group by 1")
def agg_03(s, d):
    from ..operators import listing as L

    return B.rows(s, d).where(L.live(B.NOW) & c("category_slug").isNotNull()).groupBy("category_slug").agg(F.count(F.lit(1)).alias("n"))


@query("agg_04_map", f"""{B.BASE}, g as (select venue_id, category_slug, count(*) k from live where lat is not null and category_slug is not null group by 1, 2),
  m as (select venue_id, arg_min(category_slug, (-k, category_slug)) top_category from g group by 1)
  select l.venue_id, count(*) n, count(*) filter (price_status = 'free') free, any_value(m.top_category) top_category, arg_min(title, (-quality_score, start_date, id)) best_title
  from live l left join m on l.venue_id = m.venue_id where lat is not null group by 1""")
def agg_04(s, d):
    from ..operators import listing as L

    live = B.rows(s, d).where(L.live(B.NOW) & c("lat").isNotNull())
    best = F.min_by("title", F.struct(-c("quality_score"), "start_date", "id"))
    return live.groupBy("venue_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("price_status") == "free").alias("free"), F.expr("mode() within group (order by category_slug)").alias("top_category"), best.alias("best_title"))


@query("agg_05_active_venues", f"{B.BASE} select venue_id, venue_name, count(*) n from live where venue_name is not null group by 1, 2 order by n desc, venue_name limit 50")
def agg_05(s, d):
    from ..operators import listing as L

    return B.rows(s, d).where(L.live(B.NOW) & c("venue_name").isNotNull()).groupBy("venue_id", "venue_name").agg(F.count(F.lit(1)).alias("n")).orderBy(c("n").desc(), "venue_name").limit(50)


@query("agg_06_run_end", f"{B.BASE} select max(coalesce(end_date, start_date)) run_end from outings where id % 11 = 5")
def agg_06(s, d):
    return B.outings(s, d).where("id % 11 = 5").agg(F.max(F.coalesce("end_date", "start_date")).alias("run_end"))


@query("agg_07_having", "select user_id, avg(value) rating, count(*) n from events where event_type = 'view' group by 1 having count(*) >= 3")
def agg_07(s, d):
    return t(s, d, "events").where("event_type = 'view'").groupBy("user_id").agg(F.avg("value").alias("rating"), F.count(F.lit(1)).alias("n")).where("n >= 3")


@query("agg_08_saves", "select user_id, count(*) n from events where event_type = 'purchase' group by 1 order by n desc, user_id limit 12")
def agg_08(s, d):
    return t(s, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(c("n").desc(), "user_id").limit(12)


@query("agg_09_name_suggestions", "select split_part(p_name, ' ', 1) k, min(p_name) name, count(*) n from part where p_name like 'r%' or p_name like '% r%' group by 1")
def agg_09(s, d):
    return t(s, d, "part").where(c("p_name").startswith("r") | c("p_name").contains(" r")).groupBy(F.split("p_name", " ")[0].alias("k")).agg(F.min("p_name").alias("name"), F.count(F.lit(1)).alias("n"))


@query("agg_10_member_stats", """select user_id, count(*) filter (event_type = 'view') views, count(*) filter (event_type = 'click') saves, count(*) filter (event_type = 'purchase') attended,
  count(distinct event_type) kinds, count(distinct case when event_type in ('click', 'purchase') then ts::date end) as days, coalesce(bool_or(event_type = 'signup'), false) onboarded from events group by 1""")
def agg_10(s, d):
    k = lambda x: F.count_if(c("event_type") == x)
    days = F.count_distinct(F.when(c("event_type").isin("click", "purchase"), c("ts").cast("date")))
    return t(s, d, "events").groupBy("user_id").agg(k("view").alias("views"), k("click").alias("saves"), k("purchase").alias("attended"), F.count_distinct("event_type").alias("kinds"), days.alias("days"), F.bool_or(c("event_type") == "signup").alias("onboarded"))


@query("agg_11_shares", "select user_id, event_type, count(*) n, floor(100 * count(*) / sum(count(*)) over (partition by user_id) + 0.5)::int percent from events group by 1, 2")
def agg_11(s, d):
    return R.shares(t(s, d, "events"), "user_id", "event_type")


@query("agg_12_counts_for_ids", "select event_type, count(*) n from events where event_id in (1, 5, 5, 9, 12, 40, 41, 77) group by 1")
def agg_12(s, d):
    return t(s, d, "events").where(c("event_id").isin(*{1, 5, 5, 9, 12, 40, 41, 77})).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("agg_13_daily_quota", "select user_id, count(*) n from events where ts >= timestamp '2024-01-14 23:00:00' and ts < timestamp '2024-01-15 23:00:00' group by 1")
def agg_13(s, d):
    return t(s, d, "events").where(times.paris_day(c("ts")) == F.lit("2024-01-15").cast("date")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("agg_14_upcoming", f"{B.BASE} select venue_id, count(*) n from live where start_date >= {B.NOW_SQL} group by 1")
def agg_14(s, d):
    from ..operators import listing as L

    return B.outings(s, d).where(L.live(B.NOW) & (c("start_date") >= times.stamp(B.NOW))).groupBy("venue_id").agg(F.count(F.lit(1)).alias("n"))


@query("agg_15_reason_histogram", """with x as (select doc_id, list_filter([case when n_chars < 200 then 'short' end, case when lang <> 'fr' then 'foreign' end, case when source = 'src0' then 'aggregator' end], lambda x: x is not null) r from documents)
  select reason, count(*) n from (select unnest(r) reason from x) group by 1""")
def agg_15(s, d):
    reasons = F.array_compact(F.array(F.when(c("n_chars") < 200, "short"), F.when(c("lang") != "fr", "foreign"), F.when(c("source") == "src0", "aggregator")))
    return t(s, d, "documents").select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("agg_16_trending_zero_preserving", "select n_name, count(s_suppkey) n from nation left join supplier on s_nationkey = n_nationkey and s_acctbal > 5000 group by 1 order by n desc, n_name limit 30")
def agg_16(s, d):
    return t(s, d, "nation").join(t(s, d, "supplier").where("s_acctbal > 5000"), c("s_nationkey") == c("n_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("n")).orderBy(c("n").desc(), "n_name").limit(30)


@query("agg_17_placeholder_images", f"{B.BASE}, m as (select image_url from outings group by 1 having count(distinct title) >= 5) select id, case when image_url in (select image_url from m where image_url is not null) then null else image_url end image_url from outings")
def agg_17(s, d):
    return R.shared_values(B.outings(s, d).select("id", "title", "image_url"), "image_url", "title", 5).select("id", "image_url")


@query("agg_19_work_by_venue", f"""{B.BASE} select venue_id, min(start_date) next_date, min(price_min) filter (price_status = 'paid') price_from, max(price_max) filter (price_status = 'paid') price_to, bool_or(price_status = 'free') any_free
  from live where title like 'L’Invitation%' group by 1""")
def agg_19(s, d):
    from ..operators import listing as L

    paid = c("price_status") == "paid"
    return B.rows(s, d).where(L.live(B.NOW) & c("title").startswith("L’Invitation")).groupBy("venue_id").agg(F.min("start_date").alias("next_date"), F.min(F.when(paid, c("price_min"))).alias("price_from"), F.max(F.when(paid, c("price_max"))).alias("price_to"), F.bool_or(c("price_status") == "free").alias("any_free"))


@query("agg_20_best_title", f"""{B.BASE}, g as (select id % 11 k, title, count(*) n, max(quality_score) q from outings group by 1, 2) select k, arg_min(title, (-n, -q, title)) best from g group by 1""")
def agg_20(s, d):
    g = B.outings(s, d).groupBy((c("id") % 11).alias("k"), "title").agg(F.count(F.lit(1)).alias("n"), F.max("quality_score").alias("q"))
    return g.groupBy("k").agg(F.min_by("title", F.struct(-c("n"), -c("q"), "title")).alias("best"))


@query("agg_21_report", "select o_orderstatus, count(*) n from orders group by 1 order by n desc, o_orderstatus limit 12")
def agg_21(s, d):
    return t(s, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).orderBy(c("n").desc(), "o_orderstatus").limit(12)


@query("agg_22_tag_corpus", "select count(distinct w) tags, count(*) links, count(*) / count(distinct p_partkey)::double mean from (select p_partkey, unnest(string_split(p_name, ' ')) w from part)")
def agg_22(s, d):
    return t(s, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("w")).agg(F.count_distinct("w").alias("tags"), F.count(F.lit(1)).alias("links"), (F.count(F.lit(1)) / F.count_distinct("p_partkey")).alias("mean"))


@query("agg_23_swipes", "select user_id, count(*) filter (value >= 50 and event_type = 'view') right_view, count(*) filter (value < 50 and event_type = 'view') left_view from events group by 1")
def agg_23(s, d):
    v = c("event_type") == "view"
    return t(s, d, "events").groupBy("user_id").agg(F.count_if(v & (c("value") >= 50)).alias("right_view"), F.count_if(v & (c("value") < 50)).alias("left_view"))


@query("agg_24_nested_by_day", "select ts::date dy, user_id, string_agg(event_id::varchar, ',' order by ts, event_id) ids from events where event_type = 'purchase' group by 1, 2")
def agg_24(s, d):
    ids = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"].cast("string"))
    return t(s, d, "events").where("event_type = 'purchase'").groupBy(c("ts").cast("date").alias("dy"), "user_id").agg(F.array_join(ids, ",").alias("ids"))


# ---------------------------------------------------------------- set operations


def _kind(s, d, k):
    return t(s, d, "events").where(c("event_type") == k)


@query("set_01_union_distinct", "select user_id, ts::date dy from events where event_type = 'click' union select user_id, ts::date from events where event_type = 'purchase'")
def set_01(s, d):
    x = lambda k: _kind(s, d, k).select("user_id", c("ts").cast("date").alias("dy"))
    return x("click").union(x("purchase")).distinct()


@query("set_02_nested_union", "select user_id from events where event_type = 'click' and value > 150 union (select user_id from events where event_type = 'view' and value > 150 union select c_custkey from customer where c_acctbal > 9900)")
def set_02(s, d):
    x = lambda k: _kind(s, d, k).where("value > 150").select("user_id")
    return x("click").union(x("view").union(t(s, d, "customer").where("c_acctbal > 9900").select("c_custkey"))).distinct()


@query("set_03_union_all_signals", "select user_id, count(*) n from (select user_id from events where event_type = 'click' union all select user_id from events where event_type = 'view' and value > 50 union all select user_id from events where event_type = 'purchase' union all select o_custkey from orders where o_totalprice > 450000) group by 1")
def set_03(s, d):
    parts = [_kind(s, d, "click"), _kind(s, d, "view").where("value > 50"), _kind(s, d, "purchase")]
    rest = t(s, d, "orders").where("o_totalprice > 450000").select(c("o_custkey").alias("user_id"))
    out = rest
    for p in parts:
        out = out.unionByName(p.select("user_id"))
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("set_04_discriminator", "select 'save' kind, event_id from events where event_type = 'click' union all select 'attend', event_id from events where event_type = 'purchase'")
def set_04(s, d):
    x = lambda k, name: _kind(s, d, k).select(F.lit(name).alias("kind"), "event_id")
    return x("click", "save").unionByName(x("purchase", "attend"))


@query("set_05_ordered_union_minus_seen", f"""{B.BASE}, u as (select id, 0 src, row_number() over (order by id desc) p from live qualify p <= 20 union all select id, 1, row_number() over (order by start_date, id) p from live qualify p <= 20)
  select id, min(src * 100 + p) pos from u where id % 3 <> 1 group by id""")
def set_05(s, d):
    from ..operators import listing as L

    live = B.outings(s, d).where(L.live(B.NOW)).select("id", "start_date")
    new = live.orderBy(c("id").desc()).limit(20).withColumn("src", F.lit(0)).withColumn("p", F.row_number().over(Window.orderBy(c("id").desc())))  # 20 rows
    soon = live.orderBy("start_date", "id").limit(20).withColumn("src", F.lit(1)).withColumn("p", F.row_number().over(Window.orderBy("start_date", "id")))
    return new.union(soon).where("id % 3 <> 1").groupBy("id").agg(F.min(c("src") * 100 + c("p")).cast("long").alias("pos"))


@query("set_06_array_sets", "select user_id, list_sort(list(distinct event_type)) a, list_sort(list_filter(['click', 'view', 'other'], lambda x: not list_contains(list(distinct event_type), x))) missing from events group by 1".replace("list_sort(list(distinct event_type)) a", "array_to_string(list_sort(list(distinct event_type)), ',') a").replace("list_sort(list_filter(", "array_to_string(list_sort(list_filter(").replace("x))) missing", "x))), ',') missing"))
def set_06(s, d):
    have = F.collect_set("event_type")
    return t(s, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(have), ",").alias("a"), F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, ["click", "view", "other"])), have)), ",").alias("missing"))


# ---------------------------------------------------------------- windows


@query("win_01_three_per_key", "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts, event_id) <= 3")
def win_01(s, d):
    return R.top(t(s, d, "events").select("user_id", "event_id", "ts"), ["user_id"], [c("ts"), c("event_id")], 3).select("user_id", "event_id")


@query("win_02_first_occurrence", f"{B.BASE} select id from outings qualify row_number() over (partition by lower(title), venue_id order by start_date, id) = 1")
def win_02(s, d):
    o = B.outings(s, d).groupBy(F.lower("title").alias("k"), "venue_id").agg(F.min_by("id", F.struct("start_date", "id")).alias("id"))
    return o.select("id")


@query("win_03_suggest", f"{B.BASE}, x as (select id, title, start_date from live where txt like '%soiree%' order by start_date, id limit 15) select id, title from x qualify row_number() over (partition by lower(title) order by start_date, id) = 1 order by start_date, id limit 5")
def win_03(s, d):
    from ..operators import listing as L

    x = B.rows(s, d).where(L.live(B.NOW) & L.search_text().contains("soiree")).orderBy("start_date", "id").limit(15)
    return R.top(x.withColumn("k", F.lower("title")), ["k"], [c("start_date"), c("id")], 1).orderBy("start_date", "id").limit(5).select("id", "title")


@query("win_04_runs", """with g as (select user_id, ts::date dy, date_diff('day', lag(ts::date) over (partition by user_id order by ts::date), ts::date) gap from events where event_type = 'signup')
  select user_id, date_diff('day', min(dy), max(dy))::int span_days, coalesce(max(gap), 0)::int gap_days, count(*) n, date_diff('day', min(dy), max(dy)) <= 28 and coalesce(max(gap), 0) <= 6 is_run from g group by 1""")
def win_04(s, d):
    return R.runs(_kind(s, d, "signup").select("user_id", c("ts").cast("date").alias("dy")), "user_id", "dy", 28, 6)


@query("win_05_round_robin", "select event_id, row_number() over (partition by user_id, event_type order by event_id) turn, min(event_id) over (partition by user_id, event_type) first from events")
def win_05(s, d):
    out = R.round_robin(t(s, d, "events").select("event_id", F.concat_ws(" ", c("user_id").cast("string"), "event_type").alias("who")), "who", ["event_id"])
    return out.select("event_id", "turn", c("group_first.event_id").alias("first"))


@query("win_06_interleave", """with a as (select event_id, row_number() over (partition by user_id order by value desc, event_id) i from events where event_type = 'view'), b as (select event_id, row_number() over (partition by user_id order by md5(event_id::varchar), event_id) i from events where event_type = 'click')
  select event_id, (i - 1) // 2 * 3 + (i - 1) % 2 slot from a union all select event_id, (i - 1) * 3 + 2 from b""")
def win_06(s, d):
    mine = t(s, d, "events")
    rank = lambda rows, *o: rows.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy(*o)).cast("long"))
    a = rank(mine.where("event_type = 'view'"), c("value").desc(), "event_id").select("event_id", F.expr("(i - 1) div 2 * 3 + (i - 1) % 2").alias("slot"))
    b = rank(mine.where("event_type = 'click'"), F.md5(c("event_id").cast("string").cast("binary")), "event_id").select("event_id", ((c("i") - 1) * 3 + 2).alias("slot"))
    return a.union(b)


@query("win_08_latest_answers", "select user_id, arg_max(event_id, (ts, event_id)) event_id, arg_max(value, (ts, event_id)) \"value\" from events group by 1")
def win_08(s, d):
    return R.latest(t(s, d, "events").select("user_id", "event_id", "ts", "value"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("win_09_canonical_of_group", "select o_custkey, arg_max(o_orderkey, (o_orderstatus = 'O', o_totalprice, -epoch(o_orderdate), o_orderkey)) canonical from orders group by 1")
def win_09(s, d):
    rank = F.struct(c("o_orderstatus") == "O", "o_totalprice", -F.unix_seconds(c("o_orderdate").cast("timestamp")), "o_orderkey")
    return t(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", rank).alias("canonical"))


@query("win_10_last_success", "select source, max(doc_id) last from documents where n_chars > 500 group by 1")
def win_10(s, d):
    return R.latest(t(s, d, "documents").where("n_chars > 500").select("source", "doc_id"), "source", ["doc_id"]).select("source", c("doc_id").alias("last"))


@query("win_11_cap_per_user", "select user_id, event_id from events qualify row_number() over (partition by user_id order by case event_type when 'error' then 0 when 'click' then 1 else 2 end, ts, event_id) <= 20")
def win_11(s, d):
    kind = F.when(c("event_type") == "error", 0).when(c("event_type") == "click", 1).otherwise(2)
    return R.top(t(s, d, "events").select("user_id", "event_id", "ts", kind.alias("k")), ["user_id"], [c("k"), c("ts"), c("event_id")], 20).select("user_id", "event_id")


@query("srt_08_members_top", "select user_id, count(*) filter (event_type = 'click') + 2 * count(*) filter (event_type = 'purchase') score from events group by 1 order by score desc, user_id limit 10")
def srt_08(s, d):
    score = F.count_if(c("event_type") == "click") + 2 * F.count_if(c("event_type") == "purchase")
    return t(s, d, "events").groupBy("user_id").agg(score.alias("score")).orderBy(c("score").desc(), "user_id").limit(10)


# ---------------------------------------------------------------- scalar functions

_TRI = "list_distinct(flatten(list_transform(list_filter(string_split(trim(regexp_replace({0}, '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, (length(w) + 2)::bigint), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("txt_01_fold", f"select doc_id, {F0.format('text')} folded from documents")
def txt_01(s, d):
    return t(s, d, "documents").select("doc_id", text.fold(c("text")).alias("folded"))


@query("txt_03_slug", f"select doc_id, trim(regexp_replace({F0.format('text')}, '[^a-z0-9]+', '-', 'g'), '-') slug from documents")
def txt_03(s, d):
    return t(s, d, "documents").select("doc_id", text.slug(c("text")).alias("slug"))


@query("txt_12_truncate", r"select doc_id, case when length(text) <= 80 then text else regexp_replace(substr(text, 1, 79), '\s+\S*$', '') || '…' end short from documents")
def txt_12(s, d):
    return t(s, d, "documents").select("doc_id", text.truncated(c("text"), 80).alias("short"))


@query("txt_15_stable_id", "select c_custkey, substr(sha1(c_name || '|' || coalesce(case when c_custkey % 3 = 0 then null else c_mktsegment end, '') || '|' || c_nationkey), 1, 16) id from customer")
def txt_15(s, d):
    return t(s, d, "customer").select("c_custkey", text.stable_id(c("c_name"), F.when(c("c_custkey") % 3 != 0, c("c_mktsegment")), c("c_nationkey")).alias("id"))


@query("txt_18_trigram_similarity", f"""with p as (select distinct p_name from part), x as (select p_name, {_TRI.format('p_name')} g from p)
  select a.p_name a, b.p_name b, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g)))::double sim from x a join x b on split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2) and a.p_name < b.p_name""")
def txt_18(s, d):
    x = t(s, d, "part").select("p_name").distinct().select("p_name", F.split("p_name", " ")[1].alias("k"), text.trigrams(c("p_name")).alias("g"))
    a, b = x.toDF("a", "k", "ga"), x.toDF("b", "k", "gb")
    return a.join(b, "k").where("a < b").select("a", "b", text.similarity(c("ga"), c("gb")).alias("sim"))


@query("txt_19_keywords", "select doc_id, array_to_string(list_filter(['avec', 'dans', 'pour', 'sur', 'une'], lambda w: regexp_matches(" + F0.format("text") + ", '\\b' || w || '\\b')), ',') found from documents")
def txt_19(s, d):
    words = ["avec", "dans", "pour", "sur", "une"]
    found = F.array_compact(F.array(*(F.when(text.fold(c("text")).rlike(rf"\b{w}\b"), w) for w in words)))
    return t(s, d, "documents").select("doc_id", F.array_join(found, ",").alias("found"))


@query("txt_25_arrondissement", "select c_custkey, case when n between 2 and 20 then n || 'e' when n = 1 then '1er' end arr from (select c_custkey, c_nationkey n from customer)")
def txt_25(s, d):
    return t(s, d, "customer").select("c_custkey", text.arrondissement(F.concat(F.lit("750"), F.lpad(c("c_nationkey").cast("string"), 2, "0"))).alias("arr"))


@query("txt_26_zip", r"select page_id, nullif(regexp_extract(url, '(?:^|[^0-9])([0-9]{5})(?:[^0-9]|$)', 1), '') zip from pages")
def txt_26(s, d):
    return t(s, d, "pages").select("page_id", text.zip_code(c("url")).alias("zip"))


@query("txt_28_masking", "select c_custkey, substr(c_name, 1, 1) || '***@' || c_mktsegment email from customer")
def txt_28(s, d):
    return t(s, d, "customer").select("c_custkey", text.masked_email(F.concat("c_name", F.lit("@"), "c_mktsegment")).alias("email"))


@query("dte_02_paris_day", "select event_id, (ts + interval 1 hour)::date dy from events")
def dte_02(s, d):
    return t(s, d, "events").select("event_id", times.paris_day(c("ts")).alias("dy"))  # winter only: the tables' month


@query("dte_05_night_day", "select event_id, (ts - interval 3 hour)::date as night, date_trunc('week', ts + interval 1 hour)::date as week from events")
def dte_05(s, d):
    return t(s, d, "events").select("event_id", times.night_day_of(c("ts")).alias("night"), F.date_trunc("week", times.to_paris(c("ts")).cast("timestamp")).cast("date").alias("week"))


@query("dte_06_effective_end", f"{B.BASE} select id, eff, long_run from r")
def dte_06(s, d):
    return B.outings(s, d).select("id", times.effective_end(c("start_date"), c("end_date")).alias("eff"), times.long_run(c("start_date"), c("end_date")).alias("long_run"))


@query("dte_08_slots", "select event_id, case when h < 4 then 'night' when h < 12 then 'morning' when h < 14 then 'noon' when h < 18 then 'afternoon' when h < 21 then 'evening' else 'late' end slot from (select event_id, hour(ts + interval 1 hour) h from events)")
def dte_08(s, d):
    return t(s, d, "events").select("event_id", times.slot(c("ts")).alias("slot"))


@query("dte_11_repaired_end", "select l_orderkey, l_linenumber, case when l_shipdate >= o_orderdate then l_shipdate when l_shipdate + interval 1 day >= o_orderdate then l_shipdate + interval 1 day end fixed from lineitem join orders on o_orderkey = l_orderkey")
def dte_11(s, d):
    return t(s, d, "lineitem").join(t(s, d, "orders"), c("o_orderkey") == c("l_orderkey")).select("l_orderkey", "l_linenumber", times.repaired_end(c("o_orderdate"), c("l_shipdate")).alias("fixed"))


@query("dte_12_time_unknown", "select event_id, strftime(ts + interval 1 hour, '%H:%M') in ('00:00', '23:59') unknown from events")
def dte_12(s, d):
    return t(s, d, "events").select("event_id", F.date_format(times.to_paris(c("ts")), "HH:mm").isin("00:00", "23:59").alias("unknown"))


@query("dte_13_seconds_between", f"select o_orderkey, round((epoch_us(o_orderdate) - epoch_us({B.NOW_SQL})) / 86400e6, 6) as days from orders")
def dte_13(s, d):
    return t(s, d, "orders").select("o_orderkey", F.round(times.seconds_between(c("o_orderdate"), times.stamp(B.NOW)) / 86_400, 6).alias("days"))


@query("num_02_price_range", "select l_orderkey, min(cents) lo, max(cents) hi from (select l_orderkey, round(l_extendedprice * 100)::bigint cents from lineitem) where cents between 0 and 10000000 group by 1")
def num_02(s, d):
    cents = F.round(c("l_extendedprice") * 100).cast("long")
    return t(s, d, "lineitem").select("l_orderkey", cents.alias("cents")).where("cents between 0 and 10000000").groupBy("l_orderkey").agg(F.min("cents").alias("lo"), F.max("cents").alias("hi"))


@query("num_03_half_even_cents", "select p_partkey, round_even(p_retailprice::decimal(12,2) / 8, 0)::bigint cents from part")
def num_03(s, d):
    return t(s, d, "part").select("p_partkey", F.bround(c("p_retailprice").cast("decimal(12,2)") / 8, 0).cast("long").alias("cents"))


@query("num_04_clamps", "select event_id, least(greatest(value, 10), 100) v, greatest(null, value) w from events")
def num_04(s, d):
    return t(s, d, "events").select("event_id", F.least(F.greatest("value", F.lit(10.0)), F.lit(100.0)).alias("v"), F.greatest(F.lit(None).cast("double"), "value").alias("w"))


@query("num_06_week_hash", "select o_orderpriority, list_reduce(list_prepend(0::bigint, list_transform(string_split(o_orderpriority, ''), lambda x: ascii(x)::bigint)), lambda a, x: (a * 31 + x) % 4294967296) h from (select distinct o_orderpriority from orders)")
def num_06(s, d):
    codes = F.transform(F.filter(F.split("o_orderpriority", ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return t(s, d, "orders").select("o_orderpriority").distinct().select("o_orderpriority", F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: (a * 31 + x) % 4294967296).alias("h"))


_LL = "select vec_id, 48.85 + embedding[1]::double * 0.1 lat, 2.35 + embedding[2]::double * 0.1 lng from embeddings"


@query("geo_01_haversine", f"with x as ({_LL}) select vec_id, round(2 * 6371000.0 * asin(sqrt(power(sin((radians(48.86) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(48.86)) * power(sin(radians(2.34 - lng) / 2), 2))), 3) m from x")
def geo_01(s, d):
    x = _points(s, d)
    return x.select("vec_id", F.round(geo.haversine_m(c("lat"), c("lng"), F.lit(48.86), F.lit(2.34)), 3).alias("m"))


@query("geo_02_flat_km", f"with x as ({_LL}) select vec_id, round(111.32 * sqrt(power(lat - 48.86, 2) + power((lng - 2.34) * cos(radians(48.86)), 2)), 6) km from x")
def geo_02(s, d):
    return _points(s, d).select("vec_id", F.round(geo.flat_km(c("lat"), c("lng"), 48.86, 2.34), 6).alias("km"))


@query("geo_03_box", f"with x as ({_LL}) select vec_id from x where lat between 48.70 and 49.01 and lng between 2.14 and 2.64")
def geo_03(s, d):
    return _points(s, d).where(geo.in_box(c("lat"), c("lng"))).select("vec_id")


@query("geo_04_grid_neighbours", f"with x as (select vec_id, floor(lat / 0.0015)::bigint i, floor(lng / 0.0022)::bigint j from ({_LL})) select a.vec_id a, b.vec_id b from x a join x b on a.vec_id < b.vec_id and abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1")
def geo_04(s, d):
    i, j = geo.cell(c("lat"), c("lng"))
    x = _points(s, d).select("vec_id", i.alias("i"), j.alias("j"))
    near = x.select(c("vec_id").alias("a"), F.explode(geo.neighbours(c("i"), c("j"))).alias("n")).select("a", c("n.i").alias("i"), c("n.j").alias("j"))
    return near.join(x, ["i", "j"]).where("a < vec_id").select("a", c("vec_id").alias("b"))


def _points(s, d):
    e = lambda k: F.element_at("embedding", k).cast("double") * 0.1
    return t(s, d, "embeddings").select("vec_id", (48.85 + e(1)).alias("lat"), (2.35 + e(2)).alias("lng"))


@query("arr_02_json_elements", "select event_id, (props->>'k')::int k, props like '%\"k\"%' has_k from events")
def arr_02(s, d):
    return t(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), c("props").contains('"k"').alias("has_k"))


@query("arr_01_slices", "select conv_id, array_to_string((list_distinct_keep)[1:2], ',') roles from (select conv_id, list(role order by turn) l, list_filter(['system', 'user', 'assistant'], lambda x: list_contains(list(role), x)) list_distinct_keep from conversations group by 1)")
def arr_01(s, d):
    seen = F.collect_set("role")
    kept = F.filter(F.array(*map(F.lit, ["system", "user", "assistant"])), lambda x: F.array_contains(c("seen"), x))
    return t(s, d, "conversations").groupBy("conv_id").agg(seen.alias("seen")).select("conv_id", F.array_join(F.slice(kept, 1, 2), ",").alias("roles"))


@query("dml_upsert", """with o as (select c_custkey k, c_name n, c_acctbal b from customer where c_custkey % 3 <> 0), w as (select c_custkey k, case when c_custkey % 4 = 0 then null else upper(c_name) end n, case when c_custkey % 2 = 0 then c_acctbal + 1 else c_acctbal end b from customer where c_custkey % 5 <> 0)
  select coalesce(o.k, w.k) k, coalesce(w.n, o.n) n, case when o.k is null or (w.k is not null and w.b > 0) then w.b else o.b end b,
  case when o.k is null then 'insert' when w.k is null then 'keep' when coalesce(w.n, o.n) is distinct from o.n or (case when w.b > 0 then w.b else o.b end) is distinct from o.b then 'update' else 'touch' end action from o full join w on o.k = w.k""")
def dml_upsert(s, d):
    x = t(s, d, "customer").select(c("c_custkey").alias("k"), c("c_name").alias("n"), c("c_acctbal").alias("b"))
    new = x.where("k % 5 <> 0").select("k", F.when(c("k") % 4 != 0, F.upper("n")).alias("n"), F.when(c("k") % 2 == 0, c("b") + 1).otherwise(c("b")).alias("b"))
    return R.upsert(x.where("k % 3 <> 0"), new, "k", ["n"], {"b": F.coalesce(c("new_b") > 0, F.lit(False))})


@query("dml_counters", "select o_custkey, greatest(count(*) filter (o_orderstatus <> 'F') - count(*) filter (o_orderstatus = 'F'), 0) n from orders group by 1")
def dml_counters(s, d):
    return t(s, d, "orders").groupBy("o_custkey").agg(F.greatest(F.count_if(c("o_orderstatus") != "F") - F.count_if(c("o_orderstatus") == "F"), F.lit(0)).alias("n"))


@query("dml_views_dedup_hour", "select user_id, date_trunc('hour', ts) h, count(*) n from (select distinct user_id, event_type, ts from events where event_type = 'view') group by 1, 2")
def dml_views(s, d):
    return _kind(s, d, "view").select("user_id", "event_type", "ts").distinct().groupBy("user_id", F.date_trunc("hour", c("ts").cast("timestamp")).cast("timestamp_ntz").alias("h")).agg(F.count(F.lit(1)).alias("n"))


@query("rec_03_rank_fusion", """with l as (select user_id, event_type, row_number() over (partition by event_type order by count(*) desc, user_id) - 1 r from events group by 1, 2), x as (select user_id, r, case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 else 3 end l from l)
  select user_id, round(sum(greatest(0.0::double, (40 - r) / 40.0::double) / (l + 1) + 0.25::double), 9) score, count(*) lists from x group by 1""")
def rec_03(s, d):
    n = t(s, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    r = n.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(c("n").desc(), "user_id")) - 1)
    k = F.when(c("event_type") == "view", 0).when(c("event_type") == "click", 1).when(c("event_type") == "purchase", 2).otherwise(3)
    return R.fused(r.withColumn("l", k), "user_id", "r", "l").withColumn("score", F.round("score", 9))
