"""Objects of a national tourism platform: JSON-LD whose properties come with any prefix, read natively as variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times
from ..functions.text import once
from .structured import _at, _many, _number, _one, _string

# Classes of the platform's ontology; the first one present gives the category.
EVENT_CLASSES = ("EntertainmentAndEvent", "Event")
CATEGORY_OF_CLASS = {
    "Exhibition": "expos", "ExhibitionEvent": "expos", "TheaterEvent": "theatre", "Opera": "concerts", "Concert": "concerts", "MusicEvent": "concerts", "DanceEvent": "danse", "ScreeningEvent": "cinema", "Festival": "festivals",
    "Conference": "conferences", "Reading": "conferences", "ArtistSigning": "conferences", "Traineeship": "ateliers", "Visit": "visites", "ShowEvent": "spectacles", "VisualArtsEvent": "spectacles",
}
LEFT_OUT = ("SaleEvent", "Market", "GarageSale", "BricABrac", "FairOrShow", "OpenDay", "BusinessEvent", "Congress", "SportsEvent", "SportsCompetition", "Rally", "Rambling", "Game", "ReligiousEvent")
DEPARTMENTS = ("75", "92", "93", "94")
MOST_PERIODS = 12
RUN_DAYS, GAP_DAYS = 400, 45


def local_names(json: Column) -> Column:
    """JSON with property names without their prefixes; names that begin with @ stay."""
    return F.regexp_replace(json, r'"[^"@\\]*[#/:]([A-Za-z]+)"(\s*:)', '"$1"$2')


def texts(v: Column, language: str = "fr") -> Column:
    """Every text of a variant, at any depth: literals and numbers, lists, ``@value`` objects and maps by language; what is unmarked or in the language first, each part in the order of the document (of keys, in a map).

    A reference (an ``@id`` with at most one more key), a boolean, a null and keys that name no language have no text. The
    walk is breadth-first: a list of open values is expanded level by level, as often as the value is deep.
    """
    node = "struct<path: array<int>, language: string, value: variant>"
    level = f"array<{node}>"
    named = lambda path, tongue, value: F.struct(path.alias("path"), tongue.alias("language"), value.alias("value")).cast(node)
    deep = lambda n, i: F.concat(n["path"], F.array(i))

    def inside(n: Column) -> Column:
        """The parts of a list or an object; any other value stands for itself."""
        items = F.try_variant_get(n["value"], "$", "array<variant>")
        keys = F.try_variant_get(n["value"], "$", "map<string,variant>")
        tongue = F.coalesce(_string(_at(n["value"], "['@language']")), n["language"])
        by_key = F.map_entries(F.map_filter(keys, lambda k, _: k.rlike("^@?[a-z]{2}(-[A-Za-z]{2})?$|^@none$")))
        parts = F.when(items.isNotNull(), F.transform(items, lambda x, i: named(deep(n, i), n["language"], x)))
        parts = parts.when(F.map_contains_key(keys, "@value"), F.array(named(deep(n, F.lit(0)), tongue, F.try_element_at(keys, F.lit("@value")))))
        parts = parts.when(F.map_contains_key(keys, "@id") & (F.size(keys) <= 2), F.array().cast(level))
        parts = parts.when(keys.isNotNull(), F.transform(by_key, lambda e, i: named(deep(n, i), F.when(e["key"] != "@none", F.substr(F.ltrim(e["key"], F.lit("@")), F.lit(1), F.lit(2))), e["value"])))
        return parts.otherwise(F.array(n)).cast(level)

    signs = F.regexp_replace(F.regexp_replace(F.to_json(v), r'"(?:[^"\\]|\\.)*"', ""), r"[^\[{\]}]", "")
    step = lambda a, x: F.struct((a["now"] + F.when(x.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(a["most"], a["now"] + F.when(x.isin("[", "{"), 1).otherwise(-1)).alias("most"))
    depth = F.aggregate(F.filter(F.split(signs, ""), lambda x: x != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"]
    start = F.filter(F.array(named(F.array().cast("array<int>"), F.lit(None).cast("string"), v)), lambda n: n["value"].isNotNull()).cast(level)
    leaves = F.aggregate(F.sequence(F.lit(0), F.coalesce(depth, F.lit(0))), start, lambda nodes, _: F.flatten(F.transform(nodes, inside)).cast(level))
    said = F.filter(F.transform(leaves, lambda n: F.struct(F.coalesce(n["language"] != language, F.lit(False)).alias("other"), n["path"].alias("path"), F.trim(_string(n["value"])).alias("text"), F.schema_of_variant(n["value"]).alias("kind"))), lambda n: ~n["kind"].isin("BOOLEAN", "VOID") & (n["text"] != ""))
    return F.array_sort(said)["text"]


def text(v: Column) -> Column:
    """What most properties are, without a walk: a literal, a list of literals, ``@value`` objects or a map by language as one text: French or unmarked first, then any."""
    by_language = lambda x: F.try_variant_get(x, "$", "map<string,variant>")
    marked = lambda x: F.coalesce(_string(_at(x, "['@language']")), F.lit("fr"))
    french = F.transform(_many(v), lambda x: F.coalesce(_string(x), F.when(marked(x) == "fr", _string(_at(x, "['@value']"))), _string(_one(_at(x, "fr"))), _string(_one(_at(x, "['@fr']")))))
    other = F.transform(_many(v), lambda x: F.coalesce(_string(_at(x, "['@value']")), F.get(F.array_compact(F.transform(F.map_values(F.map_filter(by_language(x), lambda k, _: k.rlike("^@?[a-z]{2}(-[A-Za-z]{2})?$|^@none$"))), lambda y: _string(_one(y)))), F.lit(0))))
    return F.coalesce(F.get(F.array_compact(french), F.lit(0)), F.get(F.array_compact(other), F.lit(0)))


def _classes(o: Column) -> Column:
    return F.transform(_many(_at(o, "['@type']")), lambda x: F.element_at(F.split(_string(x), "[#/:]"), -1))


def _clock(v: Column) -> Column:
    """Minutes of the day of a written time; null if it is none."""
    h, m = (F.regexp_extract(v, r"(\d{1,2}):(\d{2})", i).try_cast("int") for i in (1, 2))
    return F.when((h <= 23) & (m <= 59), h * 60 + m)


def periods(objects: DataFrame, key: str) -> DataFrame:
    """(key, start_date, end_date, time_known, last) of every period of objects(key, o): Paris clock times as UTC; last: when it is over."""
    p = objects.select(key, F.explode(_many(_at(F.col("o"), "takesPlaceAt"))).alias("p"))
    p = once(p, key, *(text(_at(F.col("p"), n)).alias(n) for n in ("startDate", "endDate", "startTime", "endTime")))
    day = lambda n: F.substring(n, 1, 10).try_cast("date")
    p = once(p, key, day("startDate").alias("sd"), day("endDate").alias("ed"), _clock(F.col("startTime")).alias("st"), _clock(F.col("endTime")).alias("et")).where("sd is not null")
    p = p.withColumn("ed", F.expr("if(ed < sd, null, ed)"))
    p = p.where(~F.expr("coalesce(st is null and et is null and dayofyear(sd) = 1 and month(ed) = 12 and day(ed) = 31, false)"))  # a whole year is a lasting offer
    at = lambda d, m: times.from_paris(F.expr(f"cast({d} as timestamp_ntz) + make_dt_interval(0, 0, {m})"))
    p = p.withColumns({"start_date": at("sd", "coalesce(st, 0)"), "_timed": F.when(F.col("et").isNotNull(), at("coalesce(ed, sd)", "et")), "_day": F.when(F.col("ed").isNotNull(), at("ed", "1439"))})
    end = F.when(F.col("_timed").isNull() | (F.col("st").isNotNull() & (F.col("_timed") <= F.col("start_date"))), F.col("_day")).otherwise(F.col("_timed"))
    p = p.withColumn("end_date", end)
    last = F.coalesce("end_date", F.when(F.col("st").isNull(), at("sd", "1439")).otherwise(F.col("start_date")))
    return once(p, key, "start_date", "end_date", F.col("st").isNotNull().alias("time_known"), last.alias("last"))


def occurrences(coming: DataFrame, key: str) -> DataFrame:
    """(key, start_date, end_date, time_known, n): each coming period; of more than MOST_PERIODS the whole run, or the next one if they lie far apart."""
    w = Window.partitionBy(key).orderBy("start_date", "end_date")
    gap = F.col("start_date").cast("timestamp").cast("long") - F.lag(F.col("start_date").cast("timestamp").cast("long")).over(w)
    p = coming.select(key, "start_date", "end_date", "time_known", gap.alias("gap"))
    by = F.struct("start_date", "end_date", "time_known")
    g = p.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("gap"), F.min(by).alias("a"), F.max(by).alias("z"), F.collect_list(by).alias("every"))
    done = F.coalesce("z.end_date", "z.start_date")
    span = done.cast("timestamp").cast("long") - F.col("a.start_date").cast("timestamp").cast("long")
    run = (span <= RUN_DAYS * 86_400) & (F.col("gap") <= GAP_DAYS * 86_400)
    one = F.struct(F.col("a.start_date"), F.when(run, done).otherwise(F.col("a.end_date")).alias("end_date"), F.col("a.time_known"))
    g = g.withColumn("p", F.explode(F.when(F.col("n") > MOST_PERIODS, F.array(one)).otherwise(F.col("every"))))
    return g.select(key, "p.start_date", "p.end_date", "p.time_known", F.when(F.col("n") > MOST_PERIODS, 1).otherwise(F.col("n")).alias("n"))


def tourism(payloads: DataFrame, value: str, now) -> DataFrame:
    """Rows of events within the departments from objects (one JSON object a row) of all their coming periods."""
    o = F.col("o")
    found = once(payloads, F.try_parse_json(local_names(F.col(value))).alias("o")).where("o is not null")
    found = once(found, "o", F.coalesce(_string(_at(o, "['@id']")), text(_at(o, "uri")), text(_at(o, "uuid"))).alias("uri"), F.get(texts(_at(o, "label")), F.lit(0)).alias("title"), _classes(o).alias("classes")).where("uri is not null and title is not null")
    any_of = lambda names: F.arrays_overlap("classes", F.array(*map(F.lit, names)))
    found = found.where(any_of(EVENT_CLASSES) & ~(any_of(LEFT_OUT) & ~any_of(CATEGORY_OF_CLASS)))
    # level by level, as each of them is looked at many times
    found = once(found, *found.columns, _one(_at(o, "isLocatedAt")).alias("place"))
    place = F.col("place")
    found = once(found, *found.columns, _one(_at(place, "address")).alias("address"), _one(_at(place, "geo")).alias("geo"))
    address, geo = F.col("address"), F.col("geo")
    found = once(found, *found.columns, _one(_at(address, "hasAddressCity")).alias("town"))
    town = F.col("town")
    lat, lng = (_number(_one(_at(geo, n))) for n in ("latitude", "longitude"))
    category = None
    for name, slug in CATEGORY_OF_CLASS.items():
        category = F.when(F.array_contains("classes", name), slug) if category is None else category.when(F.array_contains("classes", name), slug)
    rows = once(
        found, "o", "uri", "title", category.alias("category_slug"), F.coalesce(text(_at(place, "label")), text(_at(place, "name"))).alias("venue_name"), F.nullif(F.regexp_extract(text(_at(address, "postalCode")), r"\d{5}", 0), F.lit("")).alias("venue_zip"),
        F.coalesce(text(_at(address, "addressLocality")), text(_at(town, "label"))).alias("venue_city"), text(_at(_one(_at(town, "isPartOfDepartment")), "insee")).alias("department"), F.when((lat != 0) & (lng != 0), lat).alias("lat"), F.when((lat != 0) & (lng != 0), lng).alias("lng"),
    ).dropDuplicates(["uri"])
    rows = rows.where(F.coalesce(F.left("venue_zip", F.lit(2)), F.col("department")).isin(*DEPARTMENTS))
    # the rows' other columns go along with their periods, so that objects are read once
    kept = F.struct(*(x for x in rows.columns if x != "o"))
    coming = occurrences(periods(rows.select(kept.alias("of"), "o"), "of").where(F.col("last") >= times.stamp(now)), "of")
    out = coming.select("of.*", "start_date", "end_date", "time_known", "n")
    paris = times.to_paris(F.col("start_date"))
    local = F.when(F.col("time_known"), F.date_format(paris, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(paris, "yyyy-MM-dd"))
    return out.select(F.when(F.col("n") > 1, F.concat("uri", F.lit("#"), local)).otherwise(F.col("uri")).alias("source_id"), "title", "category_slug", "venue_name", "venue_zip", "venue_city", "lat", "lng", "start_date", "end_date", "time_known")
