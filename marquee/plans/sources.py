"""Queries: payloads made from the driver's tables, parsed, and compared with the tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import artists, french, text, titles
from ..operators import discovery, etl
from ..sources import readers as S
from ..sources import tourism, venues
from . import bindings as B
from .registry import query

c = F.col
t = B.read


def _iso(x):
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")


def _orders(s, d):
    return t(s, d, "orders")


@query("src_01_jsonld", "select o_orderkey k, o_orderpriority title, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') start_date, 'V' || o_custkey venue_name, (o_orderkey % 900 * 100)::int price_min, o_orderkey % 10 = 0 is_cancelled from orders")
def src_01(s, d):
    k = c("o_orderkey")
    event = F.struct(F.lit("MusicEvent").alias("@type"), c("o_orderpriority").alias("name"), _iso(c("o_orderdate")).alias("startDate"), F.struct(F.lit("Place").alias("@type"), F.concat(F.lit("V"), c("o_custkey").cast("string")).alias("name")).alias("location"), F.struct((k % 900).cast("string").alias("price"), F.lit("EUR").alias("priceCurrency")).alias("offers"), F.when(k % 10 == 0, "https://schema.org/EventCancelled").otherwise("https://schema.org/EventScheduled").alias("eventStatus"))
    page = F.concat(F.lit('<html><head><script type="application/ld+json"><!-- {"@graph": ['), F.to_json(event), F.lit(",]} --></script></head><body><p>x</p></body></html>"))
    return S.jsonld(_orders(s, d).select(k.alias("k"), page.alias("v")), "k", "v").select("k", "title", "start_date", "venue_name", "price_min", "is_cancelled")


@query("src_03_microdata", "select o_orderkey k, o_orderpriority title, strftime(o_orderdate, '%Y-%m-%d') start_date, 'V' || o_custkey venue_name from orders")
def src_03(s, d):
    page = F.concat(F.lit('<div itemscope itemtype="https://schema.org/Event"><h2 itemprop="name">'), c("o_orderpriority"), F.lit('</h2><meta itemprop="startDate" content="'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"><span itemprop="location" itemscope itemtype="https://schema.org/Place"><b itemprop="name">V'), c("o_custkey").cast("string"), F.lit("</b></span></div>"))
    return S.microdata(B.spread(_orders(s, d)).select(c("o_orderkey").alias("k"), page.alias("v")), "k", "v").select("k", "title", "start_date", "venue_name")


@query("src_04_icalendar", "select o_orderkey k, 'u' || o_orderkey uid, 'A, ' || o_orderpriority title, o_orderdate + interval 18 hour start_date, o_orderkey % 10 = 0 is_cancelled from orders")
def src_04(s, d):
    k = c("o_orderkey")
    text = F.concat(F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:u"), k.cast("string"), F.lit("\r\nSUMMARY:A\\, "), F.substring("o_orderpriority", 1, 3), F.lit("\r\n "), F.expr("substring(o_orderpriority, 4)"), F.lit("\r\nDTSTART:"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("T180000Z\r\nSTATUS:"), F.when(k % 10 == 0, "CANCELLED").otherwise("CONFIRMED"), F.lit("\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"))
    return S.icalendar(_orders(s, d).select(k.alias("k"), text.alias("v")), "k", "v").select("k", "uid", "title", "start_date", "is_cancelled")


@query("src_05_tribe", "select o_orderkey source_id, o_orderpriority title, o_orderdate start_date, (o_orderkey % 90 * 100 + 50)::int price_min, (o_orderkey % 90 * 100 + 1050)::int price_max, 'V' || o_custkey venue_name from orders")
def src_05(s, d):
    k = c("o_orderkey")
    e = F.struct(k.alias("id"), c("o_orderpriority").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("utc_start_date"), F.struct(F.lit("EUR").alias("currency_code"), F.array(F.concat((k % 90).cast("string"), F.lit(",50")), F.concat((k % 90 + 10).cast("string"), F.lit(".50"))).alias("values")).alias("cost_details"), F.struct(F.concat(F.lit("V"), c("o_custkey").cast("string")).alias("venue")).alias("venue"))
    return S.tribe(_orders(s, d).select(F.to_json(F.struct(F.array(e).alias("events"))).alias("v")), "v").select("source_id", "title", "start_date", "price_min", "price_max", "venue_name")


@query("src_06_open_data", f"select o_orderkey::varchar source_id, o_orderdate + interval 12 hour - interval 1 hour * (case when {B.summer_sql('o_orderdate')} then 2 else 1 end) start_date, case when o_orderkey % 10 = 0 then 'free' else 'paid' end price_status, case when o_orderkey % 3 = 0 then null else 48.85::double end lat from orders, range(2)")
def src_06(s, d):
    k = c("o_orderkey")
    occ = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T12:00:00+00:00_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T13:00:00+00:00"))
    r = F.struct(k.cast("string").alias("id"), F.concat(occ, F.lit(";"), occ).alias("occurrences"), F.when(k % 10 == 0, "gratuit sous condition").otherwise("payant").alias("price_type"), F.struct(F.when(k % 3 == 0, 0.0).otherwise(48.85).alias("lat"), F.lit(2.35).alias("lon")).alias("lat_lon"))
    return S.open_data(_orders(s, d).select(F.to_json(r).alias("v")), "v").select("source_id", "start_date", "price_status", "lat")


@query("src_08_open_agenda", "select o_orderkey source_id, case when o_orderkey % 3 = 0 then 'en ' else 'fr ' end || o_orderpriority title, o_orderdate start_date, o_orderdate + interval 1 day end_date, 2 n_timings, o_orderkey % 10 = 0 is_online from orders")
def src_08(s, d):
    k = c("o_orderkey")
    day = F.expr("interval '1' day")
    title = F.when(k % 3 == 0, F.create_map(F.lit("en"), F.concat(F.lit("en "), c("o_orderpriority")))).otherwise(F.create_map(F.lit("en"), F.lit("x"), F.lit("fr"), F.concat(F.lit("fr "), c("o_orderpriority"))))
    times = F.array(F.struct(_iso(c("o_orderdate")).alias("begin"), _iso(c("o_orderdate")).alias("end")), F.struct(_iso(c("o_orderdate") + day).alias("begin"), _iso(c("o_orderdate") + day).alias("end")))
    e = F.struct(k.alias("uid"), title.alias("title"), times.alias("timings"), F.when(k % 10 == 0, 2).otherwise(1).alias("attendanceMode"))
    return S.open_agenda(_orders(s, d).select(F.to_json(e).alias("v")), "v").select("source_id", "title", "start_date", "end_date", "n_timings", "is_online")


@query("src_09_union_dedup", "select doc_id % 500 k, min(doc_id) first from (select doc_id from documents where lang = 'fr' union all select doc_id from documents where source = 'src1') group by 1")
def src_09(s, d):
    x = t(s, d, "documents")
    return x.where("lang = 'fr'").select("doc_id").union(x.where("source = 'src1'").select("doc_id")).groupBy((c("doc_id") % 500).alias("k")).agg(F.min("doc_id").alias("first"))


@query("src_11_ticketing", "select 't' || o_orderkey source_id, o_orderpriority title, o_orderdate + interval 20 hour start_date, (o_orderkey % 90 * 100)::int price_min, o_orderkey % 10 = 0 is_cancelled, o_orderdate - interval 30 day on_sale_at from orders where o_orderkey % 35 <> 0")
def src_11(s, d):
    k = c("o_orderkey")
    name = F.when(k % 35 == 0, F.lit("Parking du Zénith")).otherwise(c("o_orderpriority"))
    start = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("localDate"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T20:00:00Z")).alias("dateTime"))
    e = F.struct(F.concat(F.lit("t"), k.cast("string")).alias("id"), name.alias("name"), F.struct(start.alias("start"), F.struct(F.when(k % 10 == 0, "cancelled").otherwise("onsale").alias("code")).alias("status")).alias("dates"), F.array(F.struct(F.lit("USD").alias("currency"), F.lit(1.0).alias("min"), F.lit(1.0).alias("max")), F.struct(F.lit("EUR").alias("currency"), (k % 90).cast("double").alias("min"), (k % 90 + 20).cast("double").alias("max"))).alias("priceRanges"), F.struct(F.struct(_iso(c("o_orderdate") - F.expr("interval '30' day")).alias("startDateTime")).alias("public")).alias("sales"))
    return S.ticketing(_orders(s, d).select(F.to_json(F.struct(F.struct(F.array(e).alias("events")).alias("_embedded"))).alias("v")), "v").select("source_id", "title", "start_date", "price_min", "is_cancelled", "on_sale_at")


@query("src_12_showtimes", "select user_id cinema, event_type film, ts::date as day, string_agg(strftime(ts, '%H:%M'), ', ' order by ts) times, min(ts) start_date from (select distinct user_id, event_type, ts from events) group by 1, 2, 3")
def src_12(s, d):
    return S.showtimes(t(s, d, "events").select(c("user_id").alias("cinema"), c("event_type").alias("film"), c("ts").alias("at")))


@query("src_13_embedded_json", "select page_id k, page_id * 3 n from pages")
def src_13(s, d):
    page = F.concat(F.lit('<script>var a=1; window.__DATA__ = {"props": {"n": '), (c("page_id") * 3).cast("string"), F.lit("}}; go();</script>"), c("html"))
    out = S.embedded(t(s, d, "pages").select(c("page_id").alias("k"), page.alias("v")), "k", "v", "window.__DATA__")
    return out.select("k", F.get_json_object("json", "$.props.n").cast("long").alias("n"))


@query("src_15_sitemap", "select url from pages")
def src_15(s, d):
    xml = F.concat(F.lit("<urlset><url><loc>\n "), c("url"), F.lit(" </loc></url></urlset>"))
    return S.sitemap(t(s, d, "pages").select(xml.alias("value")))


@query("src_16_config_join", "select page_id, case when url like '%example.org%' then 'jsonld' else 'ics' end kind from pages where url like '%example.org%' or url like '%example.net%'")
def src_16(s, d):
    config = s.createDataFrame([("example.org", "jsonld"), ("example.net", "ics")], "site string, kind string")
    site = F.regexp_extract("url", r"(example\.[a-z]+)", 1)
    return t(s, d, "pages").select("page_id", site.alias("site")).join(F.broadcast(config), "site").select("page_id", "kind")  # two rows


@query("src_17_enrichment", "select p.p_partkey, s.s_name poster from part p left join supplier s on s.s_suppkey = p.p_partkey % 1000 and s.s_nationkey = p.p_size % 25")
def src_17(s, d):
    p = t(s, d, "part").select("p_partkey", (c("p_partkey") % 1000).alias("s_suppkey"), (c("p_size") % 25).alias("s_nationkey"))
    return p.join(t(s, d, "supplier").select("s_suppkey", "s_nationkey", c("s_name").alias("poster")), ["s_suppkey", "s_nationkey"], "left").select("p_partkey", "poster")


@query("src_20_zone_share", "select source, avg(case when lang = 'fr' then 1.0 else 0 end) share, count(*) n from documents group by 1")
def src_20(s, d):
    return t(s, d, "documents").groupBy("source").agg(F.avg(F.when(c("lang") == "fr", 1.0).otherwise(0.0)).alias("share"), F.count(F.lit(1)).alias("n"))


@query("src_21_artist_events", f"select 'b' || o_orderkey source_id, o_orderdate + interval 20 hour - interval 1 hour * (case when {B.summer_sql('o_orderdate')} then 2 else 1 end) start_date, 'V' || o_custkey venue_name, o_orderpriority || ',' || o_orderstatus artists from orders")
def src_21(s, d):
    e = F.struct(F.concat(F.lit("b"), c("o_orderkey").cast("string")).alias("id"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T20:00:00")).alias("datetime"), F.struct(F.concat(F.lit("V"), c("o_custkey").cast("string")).alias("name")).alias("venue"), F.array("o_orderpriority", "o_orderstatus").alias("lineup"))
    out = S.artist_events(_orders(s, d).select(F.to_json(F.array(e)).alias("v")), "v")
    return out.select("source_id", "start_date", "venue_name", F.array_join("artists", ",").alias("artists"))


@query("txt_11_clean_text")
def txt_11(s, d):
    return t(s, d, "pages").select("page_id", S.clean_text("html").alias("text"))


@query("num_01_prices", "select o_orderkey k, case o_orderkey % 4 when 0 then 0 when 3 then 0 else (o_orderkey % 80 * 100)::int end lo, case o_orderkey % 4 when 0 then 0 when 3 then 0 when 1 then (o_orderkey % 80 * 100)::int else (o_orderkey % 80 * 100 + 1250)::int end hi, case o_orderkey % 4 when 0 then 'free' when 3 then 'unknown' else 'paid' end status from orders")
def num_01(s, d):
    k = c("o_orderkey")
    n = (k % 80).cast("string")
    text = F.when(k % 4 == 0, "Entrée libre").when(k % 4 == 1, F.concat(F.lit("Plein tarif : "), n, F.lit(" €"))).when(k % 4 == 2, F.concat(F.lit("De "), n, F.lit(" à "), (k % 80 + 12).cast("string"), F.lit(",50 euros"))).otherwise("Sur place, saison 2026")
    return t(s, d, "orders").select(k.alias("k"), S.price(text).alias("p")).select("k", c("p.min").alias("lo"), c("p.max").alias("hi"), c("p.status").alias("status"))


_MONTHS = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]


@query("dte_03_french_dates", "select o_orderkey k, o_orderdate::date first, case when o_orderkey % 2 = 0 then (o_orderdate + interval 40 day)::date end last, case when o_orderkey % 2 = 1 then '20:30' end clock from orders")
def dte_03(s, d):
    words = lambda x: F.concat_ws(" ", F.dayofmonth(x).cast("string"), F.element_at(F.array(*map(F.lit, _MONTHS)), F.month(x)), F.year(x).cast("string"))
    later = c("o_orderdate") + F.expr("interval '40' day")
    text = F.when(c("o_orderkey") % 2 == 0, F.concat(F.lit("Du "), words(c("o_orderdate")), F.lit(" au "), words(later))).otherwise(F.concat(F.lit("Le "), words(c("o_orderdate")), F.lit(" à 20h30")))
    return _orders(s, d).select(c("o_orderkey").alias("k"), french.dates(text, date(1998, 6, 15)).alias("f")).select("k", c("f.start").alias("first"), c("f.end").alias("last"), c("f.time").alias("clock"))


@query("txt_07_title_flags", "select o_orderkey k, o_orderpriority clean, o_orderkey % 3 = 0 cancelled, o_orderkey % 3 = 1 sold_out from orders")
def txt_07(s, d):
    k = c("o_orderkey")
    title = F.when(k % 3 == 0, F.concat(F.lit("ANNULÉ - "), c("o_orderpriority"))).when(k % 3 == 1, F.concat(c("o_orderpriority"), F.lit(" [COMPLET]"))).otherwise(c("o_orderpriority"))
    return t(s, d, "orders").select(k.alias("k"), titles.flagged(title).alias("f")).select("k", "f.clean", "f.cancelled", "f.sold_out")


_SHOUTS = {"LE BAL DE L'OPÉRA AVEC DJ ": "Le Bal de l'Opéra avec DJ ", "NUIT UB40, LOUIS XIV ET ": "Nuit UB40, Louis XIV et ", "SAINT-GERMAIN : LE ": "Saint-Germain : le ", "": ""}


@query("txt_09_title_case", f"select p_partkey, ({B._list(list(_SHOUTS.values()))})[p_partkey % 4 + 1] || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || substr(w, 2)), ' ') title from part")
def txt_09(s, d):
    first = F.element_at(F.array(*map(F.lit, _SHOUTS)), (c("p_partkey") % 4 + 1).cast("int"))
    return t(s, d, "part").select("p_partkey", S.title_case(F.concat(first, F.upper("p_name"))).alias("title"))


_FOREIGN = {"Жанна Щукина": "zhanna shchukina", "Θέατρο Ψυχή": "theatro psukhe", "Ля Скала": "lia skala", "東京 Hall": "hall", "Œuvre & Çà": "oeuvre et ca"}


@query("txt_04_fold", f"select p_partkey, ({B._list(list(_FOREIGN.values()))})[p_partkey % 5 + 1] || ' ' || p_name words from part")
def txt_04(s, d):
    first = F.element_at(F.array(*map(F.lit, _FOREIGN)), (c("p_partkey") % 5 + 1).cast("int"))
    return t(s, d, "part").select("p_partkey", text.words_of(F.concat_ws(" -", first, "p_name")).alias("words"))


_FOUND = "source, doc_id, case lang when 'fr' then 'in' when 'en' then 'out' when 'de' then 'online' end zone, n_chars % 3 > 0 cultural, source in ('src0', 'src1') official, source = 'src1' cultural_name"


@query("src_20_sources", f"""with s as (select {_FOUND} from documents qualify row_number() over (partition by source order by md5('7:' || source || ':' || doc_id), doc_id) <= 100),
  g as (select source, count(*) n, count(*) filter (zone = 'in') n_in, count(*) filter (zone = 'out') n_out, count(*) filter (cultural) n_cultural, bool_or(official) o, bool_or(cultural_name) nm from s group by 1),
  h as (select *, (n_in + n_out)::double k, case when n_in + n_out > 0 then n_in / (n_in + n_out) else 0 end share from g),
  w as (select *, case when n_in = 0 then 'nothing in the zone' when not o and n < 5 then 'too few rows' when n_cultural / n < (case when o then 0.25 else 0.4 end) and not (nm and o) then 'off topic' when not o then case when share >= 0.8 then 'in the zone' else 'mostly out of the zone' end
    when share >= 0.5 then 'in the zone' when n_in < 3 then 'too few in the zone' else 'partly in the zone' end reason from h)
  select source, n, n_in, n_out, n_cultural, share, round(case when k > 0 then greatest((share + 1.96 * 1.96 / (2 * k) - 1.96 * sqrt(share * (1 - share) / k + 1.96 * 1.96 / (4 * k * k))) / (1 + 1.96 * 1.96 / k), 0) else 0 end, 6) least_share, case reason when 'in the zone' then 'all' when 'partly in the zone' then 'dept' end as mode, reason from w""")
def src_20_sources(s, d):
    x = t(s, d, "documents").select("source", "doc_id", F.when(c("lang") == "fr", "in").when(c("lang") == "en", "out").when(c("lang") == "de", "online").alias("zone"), (c("n_chars") % 3 > 0).alias("cultural"), c("source").isin("src0", "src1").alias("official"), (c("source") == "src1").alias("cultural_name"))
    return discovery.judged(discovery.sampled(x, "source", "doc_id"), "source").withColumn("least_share", F.round("least_share", 6))


@query("txt_06_title_artists", "select p_partkey, list_filter(string_split(p_name, ' '), lambda w: length(w) between 2 and 80) artists from part")
def txt_06(s, d):
    return t(s, d, "part").select("p_partkey", S.title_artists(F.replace("p_name", F.lit(" "), F.lit(" + "))).alias("artists"))


@query("er_16_artist_backfill", "select p_partkey id, string_split(p_name, ' ')[1] artist from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 45)")
def er_16(s, d):
    todo = t(s, d, "part").join(t(s, d, "lineitem").where("l_quantity > 45").select(c("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")
    return todo.select(c("p_partkey").alias("id"), F.element_at(S.title_artists(F.replace("p_name", F.lit(" "), F.lit(" + "))), 1).alias("artist"))


#: titles, and the names in them
_LINE_UPS = {
    "Zolan Ferr + Mira Quay, en concert à Paris": "Zolan Ferr|Mira Quay", "Jam session jazz — Odile Brandt": "Odile Brandt", "Anton Vell, piano : Beethoven, Dvorak & Korngold": "Anton Vell", "Metal Symphonique": "", "Dans le sillage du vent - Ostie": "", "Verdi : Requiem": "",
    "Kora Lind et Pavel Osk": "Kora Lind|Pavel Osk", "Tik et Tok, Bo et Lou": "Tik et Tok|Bo et Lou", "[nouvelle date] - Selma Roy - La Cigale - Paris": "Selma Roy", "Wobo #48 : Onig, Blek & Galerie Quinze": "Onig|Blek|Galerie Quinze", "Concert de Mara Sol à L'Olympia": "Mara Sol",
}
_MUSICAL_SQL = ", ".join(f"'{x}'" for x in artists.MUSICAL)
_NAMED_SQL = f"""case when category_slug in ({_MUSICAL_SQL}) then ({B._list(list(_LINE_UPS.values()))})[id % {len(_LINE_UPS)} + 1] else '' end"""


def _played(s, d):
    """Outings with line-ups in their titles; every fifth has one from its source too."""
    k = c("id")
    title = F.element_at(F.array(*map(F.lit, _LINE_UPS)), (k % len(_LINE_UPS) + 1).cast("int"))
    given = F.when(k % 5 == 0, F.array(F.lit("TBA"), F.lit(" Lune  Noire"), F.lit("lune noire"), c("venue_name"))).when(k % 5 == 1, F.array(F.lit("No information")))
    return B.rows(s, d).withColumns({"title": title, "given": given})


@query("txt_06_artists", f"{B.BASE} select id, case when id % 5 = 0 then 'Lune Noire' else {_NAMED_SQL} end names, case when id % 5 = 0 then 'source' when {_NAMED_SQL} <> '' then 'title' end origin from r")
def txt_06_artists(s, d):
    found = artists.of_outing(c("title"), c("category_slug"), c("given"), c("venue_name"))
    return _played(s, d).select("id", found.alias("a")).select("id", F.array_join("a.name", "|").alias("names"), F.get("a", F.lit(0))["origin"].alias("origin"))


@query("er_16_backfilled", f"{B.BASE} select id, unnest(string_split({_NAMED_SQL}, '|')) as name from live where id % 5 > 1 and {_NAMED_SQL} <> '' and id not in (select l_orderkey from lineitem where l_quantity > 45)")
def er_16_backfilled(s, d):
    have = t(s, d, "lineitem").where("l_quantity > 45").select(c("l_orderkey").alias("id"))
    return etl.backfilled_artists(_played(s, d).where("id % 5 > 1"), have, B.NOW).select("id", "name")


@query("snk_04_geojson", """select 'Feature' kind, c_custkey id, '[' || (2.25::double + (c_custkey % 89) * 0.002::double)::decimal(8,3)::varchar || ',' || (48.8::double + (c_custkey % 97) * 0.002::double)::decimal(8,3)::varchar || ']' coordinates from customer where c_custkey % 17 <> 0 and c_custkey % 10 <> 0""")
def snk_04(s, d):
    v = B.venues(s, d).where("lat is not null")
    feature = F.struct(F.lit("Feature").alias("type"), c("venue_id").alias("id"), F.struct(F.lit("Point").alias("type"), F.array(c("lng").cast("decimal(8,3)").cast("string"), c("lat").cast("decimal(8,3)").cast("string")).alias("coordinates")).alias("geometry"))
    j = v.select(F.to_json(feature).alias("j"))
    return j.select(F.get_json_object("j", "$.type").alias("kind"), F.get_json_object("j", "$.id").cast("long").alias("id"), F.replace(F.get_json_object("j", "$.geometry.coordinates"), F.lit('"'), F.lit("")).alias("coordinates"))


@query("snk_05_sitemap", f"{B.BASE} select '<loc>/e/' || slug || '</loc>' line from live where quality_score >= 50 order by quality_score desc, id limit 45000")
def snk_05(s, d):
    from ..operators import listing as L

    return B.outings(s, d).where(L.live(B.NOW) & (c("quality_score") >= 50)).orderBy(c("quality_score").desc(), "id").limit(45_000).select(F.concat(F.lit("<loc>/e/"), c("slug"), F.lit("</loc>")).alias("line"))


@query("snk_07_stale_runs", "select event_id, case when ts < timestamp '2024-01-20' - interval 2 hour and event_type = 'error' then 'failed' else event_type end status from events")
def snk_07(s, d):
    stale = (c("ts") < F.lit("2024-01-20").cast("timestamp_ntz") - F.expr(f"interval '{etl.STALE_HOURS}' hour")) & (c("event_type") == "error")
    return t(s, d, "events").select("event_id", F.when(stale, "failed").otherwise(c("event_type")).alias("status"))


# ---------------------------------------------------------------- tourism objects, cinema programmes, configured sites

_UTC_START = f"(x - interval 1 hour * (case when {B.summer_sql('(case when timed then sd else sd - interval 1 day end)')} then 2 else 1 end))"


@query("src_10_tourism", f"""with p as (select o_orderkey k, o_orderkey % 3 = 0 timed, o_orderdate::date + i::int sd from (select *, unnest(range(0, case when o_orderkey % 11 = 0 then 13 when o_orderkey % 2 = 0 then 2 else 1 end)) i from orders where o_orderkey % 5 <> 0 and o_orderkey % 4 <> 0) o),
  q as (select *, sd + case when timed then interval 1230 minute else interval 0 minute end x from p),
  u as (select k, timed, x, {_UTC_START} s, case when timed then {_UTC_START} else sd + interval 1439 minute - interval 1 hour * (case when {B.summer_sql('sd')} then 2 else 1 end) end done from q),
  g as (select k, timed, x, s, count(*) over (partition by k) n, row_number() over (partition by k order by s) r, max(s) over (partition by k) z from u where done >= {B.NOW_SQL})
  select 'https://data.example/' || k || case when n between 2 and 12 then '#' || case when timed then strftime(x, '%Y-%m-%dT%H:%M:%S') else strftime(x, '%Y-%m-%d') end else '' end source_id, 'Fête ' || (k % 7) title, case when k % 9 = 0 then 'festivals' else 'concerts' end category_slug, '750' || (10 + k % 10) venue_zip, 'Paris' venue_city,
    s start_date, case when n > 12 then z end end_date, timed time_known from g where n <= 12 or r = 1""")
def src_10(s, d):
    k = c("o_orderkey")
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    n = F.when(k % 11 == 0, 12).when(k % 2 == 0, 1).otherwise(0)
    period = lambda i: F.concat(F.lit('{"@type": "Period", "startDate": "'), day(F.date_add(c("o_orderdate").cast("date"), i)), F.lit('"'), F.when(k % 3 == 0, F.lit(', "startTime": "20:30:00"')).otherwise(F.lit("")), F.lit("}"))
    whole_year = F.when(k % 7 == 0, F.lit('{"startDate": "1999-01-01T00:00:00", "endDate": "1999-12-31"}, ')).otherwise(F.lit(""))
    label = F.when(k % 2 == 0, F.concat(F.lit('{"en": ["Feast"], "fr": ["Fête '), (k % 7).cast("string"), F.lit('"]}'))).otherwise(F.concat(F.lit('[{"@value": "Feast", "@language": "en"}, {"@value": "Fête '), (k % 7).cast("string"), F.lit('", "@language": "fr"}]')))
    kind = F.when(k % 5 == 0, "urn:onto#SportsEvent").when(k % 9 == 0, "urn:onto#Festival").otherwise("Concert")
    place = F.concat(F.lit('[{"schema:address": [{"schema:postalCode": "'), F.when(k % 4 == 0, "69001").otherwise(F.concat(F.lit("750"), (k % 10 + 10).cast("string"))), F.lit('", "hasAddressCity": {"rdfs:label": {"fr": ["Paris"]}}}], "schema:geo": {"schema:latitude": "0", "schema:longitude": "2.35"}}]'))
    o = F.concat(F.lit('{"@id": "https://data.example/'), k.cast("string"), F.lit('", "@type": ["schema:Event", "'), kind, F.lit('"], "rdfs:label": '), label, F.lit(', "http://onto.example/core#isLocatedAt": '), place, F.lit(', "takesPlaceAt": ['), whole_year, F.array_join(F.transform(F.sequence(F.lit(0), n), period), ", "), F.lit("]}"))
    return tourism.tourism(B.spread(t(s, d, "orders").select(o.alias("v"))), "v", B.NOW).select("source_id", "title", "category_slug", "venue_zip", "venue_city", "start_date", "end_date", "time_known")


@query("src_12_cinema_days", "select user_id cinema, event_type film, ts::date as day, string_agg(strftime(z, '%H:%M'), ', ' order by z) times, min(z) start_date from (select distinct user_id, event_type, date_trunc('second', ts) z, ts::date ts from events) group by 1, 2, 3")
def src_12_cinema_days(s, d):
    g = t(s, d, "events").groupBy(c("user_id").alias("cinema"), "event_type").agg(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("startsAt"))).alias("at"))
    films = g.groupBy("cinema").agg(F.collect_list(F.struct(c("event_type").alias("title"), F.create_map(F.lit("original"), F.slice("at", 1, 1), F.lit("dubbed"), F.slice("at", F.lit(2), F.size("at"))).alias("showtimes"))).alias("films"))
    return S.cinema_days(films.select(F.to_json(F.struct("cinema", "films")).alias("v")), "v")


@query("src_16_kinds", "select c_custkey as \"key\", case c_custkey % 4 when 0 then 'jsonld' when 1 then 'microdata' when 2 then 'ics' end kind, case when c_custkey % 4 = 2 then 'Fête à ' || c_custkey else c_name end title, (date '1998-07-01' + (c_custkey % 28)::int) + interval 18 hour start_date, c_custkey % 4 = 0 and c_custkey % 3 = 0 is_cancelled from customer where c_custkey % 4 < 3")
def src_16_kinds(s, d):
    k, day = c("c_custkey"), F.date_add(F.lit("1998-07-01").cast("date"), (c("c_custkey") % 28).cast("int"))
    at = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T20:00:00+02:00"))
    ld = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.lit("Event").alias("@type"), c("c_name").alias("name"), at.alias("startDate"), F.when(k % 3 == 0, "https://schema.org/EventCancelled").alias("eventStatus"))), F.lit("</script>"))
    micro = F.concat(F.lit('<div itemscope itemtype="https://schema.org/Event"><b itemprop="name">'), c("c_name"), F.lit('</b><meta itemprop="startDate" content="'), at, F.lit('"></div>'))
    ics = F.concat(F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:u\r\nSUMMARY:Fête à "), k.cast("string"), F.lit("\r\nDTSTART:"), F.date_format(day, "yyyyMMdd"), F.lit("T180000Z\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"))
    config = s.createDataFrame([(0, "jsonld"), (1, "microdata"), (2, "ics")], "site int, kind string")
    pages = t(s, d, "customer").select((k % 4).cast("int").alias("site"), k.alias("key"), F.when(k % 4 == 0, ld).when(k % 4 == 1, micro).otherwise(ics).alias("value"))
    return venues.by_kind(pages, config).select("key", "kind", "title", "start_date", "is_cancelled")


@query("src_14_listing_detail", """with d as (select o_orderkey k, o_orderkey % 3 <> 0 has, case when o_orderkey % 4 = 0 then null when o_orderkey % 5 = 0 then o_orderdate else o_orderdate + interval 19 hour end s from orders),
  x as (select k, coalesce(case when has then s end, case when k % 2 = 0 then o_orderdate + interval 20 hour end) s, case when has then (k % 6)::int * 100 else 1500 end p, has from d join orders on k = o_orderkey)
  select 'p/' || k url, s start_date, strftime(s, '%H:%M') <> '00:00' time_known, case when p > 0 or k % 12 = 0 then p end price_min, case when p = 0 and k % 12 = 0 then 'free' when p = 0 then 'unknown' else 'paid' end price_status from x where s is not null""")
def src_14(s, d):
    k = c("o_orderkey")
    o = t(s, d, "orders").select(k, "o_orderdate", F.concat(F.lit("p/"), k.cast("string")).alias("url"))
    hours = lambda n: c("o_orderdate") + F.expr(f"interval '{n}' hour")
    cards = o.select("url", F.when(k % 2 == 0, hours(20)).alias("start_date"), F.lit(True).alias("time_known"), F.lit(1500).alias("price_min"), F.lit(1500).alias("price_max"), F.lit("paid").alias("price_status"))
    start = F.when(k % 4 == 0, None).when(k % 5 == 0, c("o_orderdate")).otherwise(hours(19))
    price = ((k % 6) * 100).cast("int")
    details = o.where(k % 3 != 0).select("url", start.alias("start_date"), price.alias("price_min"), price.alias("price_max"), F.when(price > 0, "paid").when(k % 12 == 0, "free").otherwise("paid").alias("price_status"))
    return venues.completed(cards, details).select("url", "start_date", "time_known", "price_min", "price_status")
