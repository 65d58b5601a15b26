"""Queries: what titles, addresses, searches, requests and written dates say."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, phrases, text, titles, times
from ..operators import editorial, quality
from . import bindings as B
from .registry import query

c = F.col
t = B.read

# ---------------------------------------------------------------- titles

# What sources put before and after a title.
BEFORE = ["", "09.10 | PARIS | ", "Ven. 9 octobre : ", "ANNULÉ - ", "[COMPLET] ", "Annulé faute de participants. ", "Annulée ", "Le concert est annulé : "]
AFTER = ["", " – 09/10/2026 - 17:30", " - 9 octobre 2026 à 20h", " (complet)", " COMPLET supplémentaire", " en concert à Paris au Bataclan", " | 09.10", " annulée : demain", " - sold out", " au Trianon le 12 mars", " (09/10/2026)"]


def _titles(s, d):
    o = B.outings(s, d)
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    return o.select("id", F.concat(pick(BEFORE, c("id") % len(BEFORE)), c("title"), pick(AFTER, F.floor(c("id") / 8) % len(AFTER))).alias("title"), "category_id").transform(B.spread)


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _rep(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {_q(pattern)}, {_q(to)}, 'g')"


_T = f"""{B.BASE}, tt as (select id k, category_slug, ({B._list(BEFORE)})[id % {len(BEFORE)} + 1] || title || ({B._list(AFTER)})[(id // 8) % {len(AFTER)} + 1] raw from r)"""
# What should be left of each of them, where a rule takes something away, and what the marks say.
_FLAG_BEFORE, _FLAG_AFTER = {3: "", 4: "", 5: "", 6: "", 7: "Le concert est : "}, {3: "", 4: " supplémentaire", 7: " : demain", 8: ""}
_DATE_BEFORE, _DATE_AFTER = {1: "", 2: ""}, {1: "", 2: "", 6: "", 9: " au Trianon", 10: ""}
_B, _A = f"id % {len(BEFORE)}", f"(id // 8) % {len(AFTER)}"


def _left_sql(before: dict, after: dict) -> str:
    pick = lambda xs, new, at: f"({B._list([new.get(i, x) for i, x in enumerate(xs)])})[{at} + 1]"
    return f"trim({pick(BEFORE, before, _B)} || title || {pick(AFTER, after, _A)})"


@query("txt_08_without_dates", f"{B.BASE} select id, {_left_sql(_DATE_BEFORE, _DATE_AFTER)} title from r")
def txt_08(s, d):
    return _titles(s, d).select("id", titles.without_dates(c("title")).alias("title"))


@query("txt_07_flagged", f"{B.BASE} select id, {_left_sql(_FLAG_BEFORE, _FLAG_AFTER)} clean, {_B} in (3, 5, 6, 7) or {_A} = 7 cancelled, {_B} = 4 or {_A} in (3, 4, 8) sold_out from r")
def txt_07_flagged(s, d):
    return _titles(s, d).select("id", titles.flagged(c("title")).alias("f")).select("id", "f.clean", "f.cancelled", "f.sold_out")


_PLAIN = _rep(_rep(_rep("replace(replace(" + B.FOLD_SQL.format("t") + ", 'œ', 'oe'), 'æ', 'ae')", r"\([^)]*\)|\[[^\]]*\]", " "), r"\b(19|20)[0-9]{2}\b", " "), "[^a-z0-9]+", " ")


@query("txt_10_dedup_title", f"""{B.BASE}, m as (select id k, {_left_sql(_DATE_BEFORE | _FLAG_BEFORE, _DATE_AFTER | _FLAG_AFTER | {5: ""})} t from r), p as (select k, t, trim({_PLAIN}) w from m), n as (select *, array_to_string(list_filter(string_split(w, ' '), lambda x: x <> '' and x not in ({', '.join(_q(x) for x in (*text.ARTICLES, *text.TITLE_NOISE))})), ' ') z from p)
  select k id, t title, case when z <> '' then z else w end words from n""")
def txt_10(s, d):
    return _titles(s, d).select("id", titles.for_matching(c("title")).alias("title")).select("id", "title", text.plain_title(c("title")).alias("words"))


_ADDRESSES = ["12 bd de la Villette, 75019 Paris", "3 Pl. du Châtelet", "Av Sainte-Anne 75001", "r. St Denis, Paris Cedex", "Quai d’Orsay", None, "Fbg du Temple & Cie"]


@query("txt_17_address", f"""with x as (select c_custkey k, ({'[' + ', '.join('null' if a is None else _q(a) for a in _ADDRESSES) + ']'})[c_custkey % 7 + 1] a from customer),
  w as (select k, list_filter(string_split({_rep(_rep("replace(replace(replace(" + B.FOLD_SQL.format("coalesce(a, '')") + ", 'œ', 'oe'), 'æ', 'ae'), '&', ' et ')", "[^a-z0-9]+", " "), chr(92) + "b" + chr(92) + "d{5}" + chr(92) + "b", " ")}, ' '), lambda v: v <> '') w from x)
  select k, array_to_string(list_filter(list_transform(w, lambda v: case v {' '.join(f"when '{a}' then '{b}'" for a, b in titles.STREETS.items())} else v end), lambda v: v not in ({', '.join(_q(v) for v in (*text.ARTICLES, *titles.ADDRESS_NOISE))})), ' ') address from w""")
def txt_17(s, d):
    a = F.element_at(F.array(*map(F.lit, _ADDRESSES)), (c("c_custkey") % 7 + 1).cast("int"))
    return t(s, d, "customer").select(c("c_custkey").alias("k"), titles.address(a).alias("address"))


@query("txt_23_followable", f"""{_T}, a as (select k, trim({_rep("string_split(" + _rep("raw", r"\s*[(\[][^)\]]*[)\]]\s*", " ") + ", ' | ')[1]", r"\s+", " ")}) l from tt), b as (select k, l, trim({_rep(_rep(B.FOLD_SQL.format('l'), r"\s+", " "), '''^[\\s\\-–—:;,.!?'"«»()\\[\\]|/]+|[\\s\\-–—:;,.!?'"«»()\\[\\]|/]+$''')}) term from a)
  select k id, term, {_rep('l', r'^[\s\-–—:;,.]+|[\s\-–—:;,.]+$')} label from b where length({_rep('term', r'[^\p{L}\p{N}]')}) >= 3""")
def txt_23(s, d):
    return _titles(s, d).select("id", titles.followable(c("title")).alias("f")).where("f is not null").select("id", "f.term", "f.label")


# ---------------------------------------------------------------- categories

_FORMAT_TITLES = ["Atelier gravure", "Blind test musical", "Conférence-débat", "Soirée jazz", "Yoga au parc", "Visite guidée", "Projection rare", "DJ set au bar", "La visite", "Table ronde", "Afterwork géant"]
_WORDS_SQL = "trim(" + _rep("replace(replace(replace(" + B.FOLD_SQL.format("title") + ", 'œ', 'oe'), 'æ', 'ae'), '&', ' et ')", "[^a-z0-9]+", " ") + ")"
_LEAD_SQL = "case " + " ".join(f"when regexp_matches(w, {_q(rf'^(?:{titles._word(x.replace('-', ' ') for x in words)}){chr(92)}b')}) then '{slug}'" for slug, words in titles.FORMATS.items()) + " end"
_OVERRIDE = f"""{B.BASE}, ft as (select id, ({B._list(_FORMAT_TITLES)})[id % {len(_FORMAT_TITLES)} + 1] title, category_slug cur, quality_score, status, id % 3 = 0 marked from r), fw as (select *, {_WORDS_SQL} w from ft), fl as (select *, {_LEAD_SQL} lead from fw),
  fo as (select *, case when lead is not null then case when cur is not distinct from lead or cur is not distinct from 'festivals' then null else lead end
    when regexp_matches(w, {_q(rf'(^| )(?:{titles._word(titles.PARTIES)})( |$)')}) and (cur is null or cur in ({', '.join(map(_q, titles.GENERIC))})) then 'soirees' end o from fl)"""


def _formats(s, d):
    title = F.element_at(F.array(*map(F.lit, _FORMAT_TITLES)), (c("id") % len(_FORMAT_TITLES) + 1).cast("int"))
    return B.rows(s, d).select("id", title.alias("title"), "category_slug", "quality_score", "status", F.when(c("id") % 3 == 0, F.array(F.lit("no_category"))).otherwise(F.array().cast("array<string>")).alias("soft"))


@query("cls_03_category_override", f"{_OVERRIDE} select id, o category from fo")
def cls_03(s, d):
    return _formats(s, d).select("id", titles.category_override(c("title"), c("category_slug")).alias("category"))


_DETECT = {"ateliers": "atelier", "soirees": "blind|afterwork|dj set", "sport": "yoga", "concerts": "jazz"}


@query("er_11_reclassified", f"""{_OVERRIDE}, n as (select *, case when cur is null then {'case ' + ' '.join(f"when regexp_matches({B.FOLD_SQL.format('title')}, '{p}') then '{k}'" for k, p in _DETECT.items()) + ' end'} else o end new from fo)
  select id, new category, case when marked then least(100, quality_score + 10) else quality_score end::int score, case when status = 'draft' and marked and quality_score + 10 >= 50 then 'active' else status end status from n where new is not null and new is distinct from cur""")
def er_11(s, d):
    rows = _formats(s, d).withColumn("detected", quality.category(text.fold(c("title")), _DETECT, list(_DETECT)))
    return editorial.reclassified(rows, c("detected")).select("id", c("category_slug").alias("category"), c("quality_score").alias("score"), "status")


@query("scr_03_legacy_quality", f"""{B.BASE} select id, (15 + case when length(coalesce(short_desc, '')) * 8 > 100 then 20 else 0 end + case when length(coalesce(short_desc, '')) * 8 > 300 then 10 else 0 end + case when image_url is not null then 25 else 0 end + 10
  + case when price_status <> 'unknown' then 10 else 0 end + case when id % 3 = 0 then 10 else 0 end)::int score from r""")
def scr_03(s, d):
    none = F.lit(None).cast("string")
    return B.rows(s, d).select("id", titles.legacy_quality(c("title"), F.repeat("short_desc", F.lit(8)), c("image_url"), c("start_date"), F.when(c("price_status") != "unknown", c("price_status")), F.when(c("id") % 3 == 0, "x").otherwise(none)).alias("score"))


# ---------------------------------------------------------------- searches and requests

# Searches and requests.
SEARCHES = ["expo", "concert jazz", "stand up gratuit", "théâtre de la ville de paris", "métal", "film en famille", "Zénith", "  ", "humour ce soir", "danse et theatre", "pièces de théâtre", "r&b", "l’expo Monet"]
REQUESTS = [
    "ce soir dans le 11e", "gratuit ce week-end", "concert jazz moins de 20 €", "une comédie musicale en famille demain", "expo pour 2 personnes dans le 5 ou 75012", "sortie insolite à deux près de moi", "pas cher et festif cette semaine",
    "quoi faire", "du stand-up entre amis vendredi soir max 30 euros", "théâtre pour 12 personnes", "visite du 1er et du 20e aujourd'hui", "cirque pour enfants de 6 ans", "trois places de ciné maintenant",
]


def _array(xs: list[str]) -> str:
    return "[" + ", ".join(_q(x) for x in xs) + "]"


def _padded_sql(x: str) -> str:
    return f"' ' || {B.FOLD_SQL.format(f"replace({x}, '’', chr(39))")} || ' '"


def _hits_sql(rules, x: str = "t") -> str:
    return "list_filter([" + ", ".join(f"case when regexp_matches({x}, {_q(p)}) then '{k}' end" for k, p in rules) + "], lambda v: v is not null)"


_GONE = "t"
for _p in (*(p for _, p in phrases.TOPIC_WORDS), *(p for _, p in phrases.INTENT_WORDS), phrases.FREE_WORDS):
    _GONE = _rep(_GONE, _p, " ")
_GONE_SHORT = "g0"
for _, _p in phrases.CATEGORY_WORDS:
    _GONE_SHORT = _rep(_GONE_SHORT, _p, " ")


@query("txt_21_search_filters", f"""with x as (select doc_id k, ({_array(SEARCHES)})[doc_id % {len(SEARCHES)} + 1] raw from documents), p as (select *, replace({_padded_sql('raw')}, chr(39), ' ') t from x),
  a as (select *, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda v: v <> '')) <= {phrases.SHORT} short, {_hits_sql(phrases.TOPIC_WORDS)} topics, {_hits_sql(phrases.INTENT_WORDS)} intents, {_hits_sql(phrases.CATEGORY_WORDS)} named, regexp_matches(t, {_q(phrases.FREE_WORDS)}) free, {_GONE} g0 from p),
  b as (select *, case when short and len(named) > 0 then named when short and regexp_matches(t, {_q(phrases.GENRES)}) then {_array(list(phrases.GENRE_CATEGORIES))} else [] end cats, trim(regexp_replace(case when short then {_GONE_SHORT} else g0 end, '\\s+', ' ', 'g')) rest from a)
  select k, case when not free and len(topics) + len(intents) + len(cats) = 0 then nullif(trim(raw), '') when not regexp_matches(rest, {_q(phrases.FILLERS)}) then rest end q, array_to_string(cats, ',') categories, array_to_string(intents, ',') intents, array_to_string(topics, ',') topics, free from b""")
def txt_21(s, d):
    raw = F.element_at(F.array(*map(F.lit, SEARCHES)), (c("doc_id") % len(SEARCHES) + 1).cast("int"))
    out = t(s, d, "documents").select(c("doc_id").alias("k"), phrases.search_filters(raw).alias("f"))
    return out.select("k", "f.q", *(F.array_join(f"f.{x}", ",").alias(x) for x in ("categories", "intents", "topics")), "f.free")


_PLACES = f"list_distinct(list_filter(list_transform(list_filter(list_transform(regexp_extract_all(t, {_q(phrases.PLACE)}), lambda v: trim(v)), lambda v: regexp_matches(v, {_q(phrases.PLACE_MARK)}) and not regexp_matches(v, {_q(phrases.UNIT)})), lambda v: regexp_replace(regexp_extract(v, '(750[0-9][0-9]|[0-9]+)', 1), '^750', '')::int), lambda n: n between 1 and 20))"
_ASKED = ", ".join(f"case when regexp_matches({'replace(t, ' + _q(phrases.MUSICAL) + ', chr(32))' if k == 'theatre' else 't'}, {_q(p)}) then '{k}' end" for k, p in phrases.ASKED_CATEGORIES)
_REQUEST = f"""with x as (select doc_id k, ({_array(REQUESTS)})[doc_id % {len(REQUESTS)} + 1] raw from documents), p as (select *, {_padded_sql('raw')} t from x),
  a as (select *, case {' '.join(f"when regexp_matches(t, {_q(r)}) then '{k}'" for k, r in phrases.WHEN)} end w, list_filter([{_ASKED}], lambda v: v is not null) cats, list_sort({_PLACES}) places, regexp_matches(t, {_q(phrases.ASKED_FREE)}) free, {_hits_sql(phrases.MOODS)} moods,
    coalesce(nullif(regexp_extract(t, {_q(phrases.AT_MOST)}, 1), '')::int, case when regexp_matches(t, {_q(phrases.CHEAP)}) then {phrases.CHEAP_EUROS} end) price, regexp_extract_all(t, {_q(phrases.ASKED_GENRES)}, 1) genres, regexp_matches(t, {_q(phrases.NEAR)}) near,
    case when regexp_matches(t, {_q(phrases.PEOPLE)}) then case regexp_extract(t, {_q(phrases.PEOPLE)}, 1) {' '.join(f"when '{a}' then {n}" for a, n in phrases.NUMBERS.items())} else try_cast(regexp_extract(t, {_q(phrases.PEOPLE)}, 1) as int) end when regexp_matches(t, {_q(phrases.COUPLE)}) then 2 end people from p),
  b as (select *, list_transform(places, lambda n: n || case when n = 1 then 'er' else 'e' end) arr, list_filter(genres, lambda g, i: list_position(genres, g) = i)[1:{phrases.MOST_KEYWORDS}] kw from a)"""


@query("txt_22_requests", f"""{_REQUEST} select k, w "when", array_to_string(cats, ',') categories, array_to_string(list_sort(arr), ',') arrondissements, price max_price, free, array_to_string(moods, ',') intents, array_to_string(kw, ',') keywords, near near_me, people,
  ((w is not null)::int + (len(cats) + len(kw) > 0)::int + (len(arr) > 0 or near)::int + (free or price is not null)::int + (len(moods) > 0)::int) >= case when len(regexp_split_to_array(trim(raw), '\\s+')) <= 4 then 1 else 3 end understood from b""")
def txt_22(s, d):
    raw = F.element_at(F.array(*map(F.lit, REQUESTS)), (c("doc_id") % len(REQUESTS) + 1).cast("int"))
    out = t(s, d, "documents").select(c("doc_id").alias("k"), raw.alias("raw"), phrases.request(raw).alias("i"))
    joined = lambda x: F.array_join(f"i.{x}", ",").alias(x)
    return out.select("k", "i.when", joined("categories"), F.array_join(F.array_sort("i.arrondissements"), ",").alias("arrondissements"), "i.max_price", "i.free", joined("intents"), joined("keywords"), "i.near_me", "i.people", phrases.well_understood(c("raw"), c("i")).alias("understood"))


# ---------------------------------------------------------------- dates

_NAME = lambda names, i: f"({B._list(list(names))})[{i}]"


def _clock_sql(x: str) -> str:
    return f"(hour({x}) || 'h' || case when minute({x}) = 0 then '' else lpad(minute({x})::varchar, 2, '0') end)"


def _short_sql(x: str) -> str:
    return f"(day({x}) || ' ' || {_NAME(labels.SHORT_MONTHS, f'month({x})')})"


def _capital_sql(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || substr({x}, 2))"


_N = "timestamp '1998-06-15 16:00:00'"
_WHEN = f"""{B.BASE}, a as (select id, start_date s, end_date e, time_known k, {B.paris_sql('start_date')} ps, {B.paris_sql('end_date')} pe, eff, long_run from r),
  b as (select *, datediff('day', date '1998-06-15', (ps - interval 4 hour)::date) ahead, datediff('day', date '1998-06-15', (pe - interval 4 hour)::date) lft from a),
  w as (select *, case when long_run then case when s > {_N} then 'Du ' || {_short_sql('ps')} || ' au ' || {_short_sql('pe')} when lft <= 0 then 'Dernier jour aujourd''hui' when lft = 1 then 'Dernier jour demain'
      when lft <= 7 then 'Plus que ' || lft || ' jours · jusqu''au ' || {_short_sql('pe')} else 'En cours · jusqu''au ' || {_short_sql('pe')} end
    when s <= {_N} and eff >= {_N} then case when not k then 'Aujourd''hui' when e is not null and e >= s + interval 4 hour then 'Aujourd''hui · jusqu''à ' || {_clock_sql('pe')} else 'En ce moment · depuis ' || {_clock_sql('ps')} end
    else case when ahead = 0 then case when hour(ps) >= 17 or hour(ps) < 4 then 'Ce soir' else 'Aujourd''hui' end when ahead = 1 then 'Demain' when ahead between 2 and 6 then {_capital_sql(_NAME(labels.DAYS, 'isodow(ps)'))}
      else {_capital_sql(_NAME(labels.SHORT_DAYS, 'isodow(ps)'))} || ' ' || {_short_sql('ps')} end || case when k then ' · ' || {_clock_sql('ps')} else '' end end label from b)"""
_LONG = lambda x: f"({_NAME(labels.DAYS, f'isodow({x})')} || ' ' || day({x}) || ' ' || {_NAME(labels.MONTHS, f'month({x})')} || case when year({x}) = 1998 then '' else ' ' || year({x}) end)"


@query("dte_07_labels", f"""{_WHEN}, z as (select *, date_diff('second', {_N}, s) sec, floor(date_diff('second', {_N}, s) / 60.0 + 0.5)::bigint mins from w)
  select id, label, case when long_run then case when s <= {_N} and lft <= 0 then 'Dernier jour' when s <= {_N} and lft <= 3 then 'J-' || lft end when k and sec > 0 and sec < 10800 then case when mins < 60 then 'Dans ' || mins || ' min' else 'Dans ' || floor(mins / 60.0 + 0.5)::bigint || ' h' end
      when k and s <= {_N} and eff >= {_N} then 'En cours' end badge,
    case when long_run then 'Du ' || {_LONG('ps')} || ' au ' || {_LONG('pe')} else {_capital_sql(_LONG('ps'))} end "primary",
    case when long_run then case when s <= {_N} then 'En cours — ' || regexp_replace(label, '^En cours · ', '') end when not k then 'Horaire non communiqué' else {_clock_sql('ps')} || case when e is not null and (ps - interval 4 hour)::date = (pe - interval 4 hour)::date then ' – ' || {_clock_sql('pe')} else '' end end secondary from z""")
def dte_07(s, d):
    a = (c("start_date"), c("end_date"), c("time_known"), B.NOW)
    return B.outings(s, d).select("id", labels.when(*a).alias("label"), labels.badge(*a).alias("badge"), labels.full(*a).alias("f")).select("id", "label", "badge", "f.primary", "f.secondary")


@query("dte_01_written_dates", f"""with x as (select o_orderkey id, o_orderdate d, o_orderkey % 7 k, date_diff('hour', o_orderdate + interval 12 hour, {B.paris_sql("(o_orderdate + interval 12 hour)")}) h from orders)
  select id, case k when 1 then d + interval 20 hour - to_hours(h) when 2 then d + interval 18 hour when 4 then d + interval 19 hour when 5 then null else d + interval 12 hour - to_hours(h) end as "at", k in (1, 2, 4) time_known from x""")
def dte_01(s, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = c("o_orderkey") % 7
    mail = F.concat(F.date_format("o_orderdate", "EEE, d MMM yyyy"), F.lit(" 20:00:00 +0100"))
    written = F.when(k == 0, day).when(k == 1, F.concat(day, F.lit(" 20:00"))).when(k == 2, F.concat(day, F.lit("T20:00:00+02:00"))).when(k == 3, F.concat(day, F.lit("T00:00:00"))).when(k == 4, mail).when(k == 5, F.lit("bientôt")).otherwise(F.concat(day, F.lit("T00:00")))
    return t(s, d, "orders").select(c("o_orderkey").alias("id"), labels.instant(written, midnight_unknown=True).alias("w")).select("id", "w.at", "w.time_known")


@query("dte_09_series_times", f"""with a as (select o_custkey k, o_orderdate + to_hours(o_orderkey % 3 * 2) s, o_orderdate - interval 30 day o from orders)
  select k, case when count(distinct strftime({B.paris_sql('s')}, '%H:%M')) = 1 then min(strftime({B.paris_sql('s')}, '%H:%M')) end clock, coalesce(min(o) filter (o > {_N}), max(o)) on_sale_at from a group by 1""")
def dte_09(s, d):
    o = t(s, d, "orders").select(c("o_custkey").alias("k"), (c("o_orderdate") + F.expr("make_dt_interval(0, int(o_orderkey % 3 * 2))")).alias("s"), (c("o_orderdate") - F.expr("interval '30' day")).alias("o"))
    g = o.groupBy("k").agg(F.collect_list("s").alias("s"), F.collect_list("o").alias("o"))
    return g.select("k", labels.agreed_time(c("s")).alias("clock"), labels.series_on_sale(c("o"), B.NOW).alias("on_sale_at"))


@query("dte_07_film_times")
def dte_07_films(s, d):
    o = B.outings(s, d).where(c("start_date") > times.stamp(B.NOW) - F.expr("interval '20' day")).groupBy("venue_id").agg(F.array_sort(F.collect_list(c("start_date") + F.expr("make_dt_interval(0, int(id % 24))"))).alias("at"))
    return o.select("venue_id", labels.film_times(c("at"), B.NOW).alias("line"))
