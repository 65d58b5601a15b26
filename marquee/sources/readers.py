"""Landed payloads as DataFrames of raw events.

JSON formats are read with declared schemas by built-in functions; HTML,
iCalendar and French text go through Arrow-batched Python. Fetching is not part
of the engine: payloads are files or columns.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import parsing, structured

ICS = "uid string, title string, start_date timestamp_ntz, end_date timestamp_ntz, time_known boolean, venue_name string, description string, url string, lat double, lng double, is_cancelled boolean, tags array<string>"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: path, value."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def parsed(payloads: DataFrame, key: str, value: str, parse: Callable[[str], list[dict]], schema: str) -> DataFrame:
    """(key, *schema) for every record that parse finds in a payload; a payload that is none gives no rows."""
    names = [x.split()[0] for x in schema.split(", ")]
    kind = dict(payloads.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *(r.get(n) for n in names)) for k, v in zip(pdf[key], pdf[value], strict=True) for r in parse(v or "")]
            yield pd.DataFrame(rows, columns=[key, *names], dtype=object)

    return payloads.select(key, value).mapInPandas(run, f"{key} {kind}, {schema}")


def jsonld(pages: DataFrame, key: str, value: str) -> DataFrame:
    """Raw events of the JSON-LD scripts of pages."""
    return structured.rows(structured.objects(pages, key, value, structured.jsonld_objects), key)


def microdata(pages: DataFrame, key: str, value: str) -> DataFrame:
    """Raw events of the microdata of pages."""
    return structured.rows(structured.objects(pages, key, value, structured.microdata_objects), key)


def icalendar(files: DataFrame, key: str, value: str) -> DataFrame:
    return parsed(files, key, value, parsing.ics_events, ICS)


def sitemap(files: DataFrame, value: str = "value") -> DataFrame:
    """url of each location, natively."""
    return files.select(F.explode(F.regexp_extract_all(value, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), 1)).alias("url"))


def embedded(pages: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, json) of the object of a name in the page's scripts."""
    return parsed(pages, key, value, lambda v: [{"json": json.dumps(x)}] if (x := parsing.embedded_json(v, name)) is not None else [], "json string")


def zipped_objects(files: DataFrame) -> DataFrame:
    """(path, name, json) of the JSON files in zip files read by spark.read.format('binaryFile')."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(path, n, z.read(n).decode("utf-8", "replace")) for n in z.namelist() if n.endswith(".json")]
            yield pd.DataFrame(rows, columns=["path", "name", "json"], dtype=object)

    return files.select("path", "content").mapInPandas(run, "path string, name string, json string")


# ---------------------------------------------------------------- JSON formats, natively


def _utc(c: Column) -> Column:
    return F.to_timestamp_ntz(F.replace(F.substring(c, 1, 19), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss"))


def _cents(c: Column) -> Column:
    return F.bround(F.replace(c, F.lit(","), F.lit(".")).try_cast("decimal(10,2)") * 100, 0).cast("int")


def tribe(payloads: DataFrame, value: str) -> DataFrame:
    """WordPress event calendars: one row an event."""
    schema = "events array<struct<id: long, title: string, url: string, utc_start_date: string, utc_end_date: string, all_day: boolean, cost: string, cost_details: struct<currency_code: string, values: array<string>>, venue: struct<venue: string, address: string, zip: string, city: string>>>"
    e = payloads.select(F.explode(F.from_json(value, schema)["events"]).alias("e"))
    prices = F.filter(F.transform("e.cost_details.values", _cents), lambda x: x.isNotNull())
    euro = F.coalesce(F.col("e.cost_details.currency_code"), F.lit("EUR")) == "EUR"
    return e.select(
        F.col("e.id").alias("source_id"), "e.title", "e.url", _utc(F.col("e.utc_start_date")).alias("start_date"), _utc(F.col("e.utc_end_date")).alias("end_date"), (~F.coalesce("e.all_day", F.lit(False))).alias("time_known"),
        F.when(euro, F.array_min(prices)).alias("price_min"), F.when(euro, F.array_max(prices)).alias("price_max"), F.col("e.venue.venue").alias("venue_name"), F.col("e.venue.zip").alias("venue_zip"),
    )


def open_data(payloads: DataFrame, value: str) -> DataFrame:
    """Open-data records: one row for each of ``B_E;B_E`` occurrences; their offset, always +00:00, is Paris time."""
    schema = "id string, title string, occurrences string, price_type string, price_detail string, lat_lon struct<lat: double, lon: double>, address_name string, address_zipcode string, qfap_tags string"
    r = payloads.select(F.from_json(value, schema).alias("r")).select("r.*")
    o = r.withColumn("o", F.explode(F.filter(F.split("occurrences", ";"), lambda x: x != "")))
    at = lambda i: F.convert_timezone(F.lit("Europe/Paris"), F.lit("UTC"), _utc(F.split("o", "_").getItem(i)))
    zero = (F.col("lat_lon.lat") == 0) | F.col("lat_lon.lat").isNull()
    return o.select(
        F.col("id").alias("source_id"), "title", at(0).alias("start_date"), at(1).alias("end_date"), F.when(F.col("price_type").startswith("gratuit"), "free").when(F.col("price_type") == "payant", "paid").otherwise("unknown").alias("price_status"),
        F.col("address_name").alias("venue_name"), F.when(F.col("address_zipcode").rlike("^[0-9]{5}$"), F.col("address_zipcode")).alias("venue_zip"), F.when(~zero, F.col("lat_lon.lat")).alias("lat"), F.when(~zero, F.col("lat_lon.lon")).alias("lng"), F.split("qfap_tags", ";").alias("tags"),
    )


def open_agenda(payloads: DataFrame, value: str, language: str = "fr") -> DataFrame:
    """Agenda events with texts by language and timings."""
    schema = "uid long, title map<string,string>, description map<string,string>, timings array<struct<begin: string, end: string>>, location struct<name: string, postalCode: string, latitude: double, longitude: double>, attendanceMode int, status int"
    r = payloads.select(F.from_json(value, schema).alias("r")).select("r.*")
    pick = lambda m: F.coalesce(F.try_element_at(m, F.lit(language)), F.try_element_at(m, F.lit("en")), F.get(F.map_values(m), F.lit(0)))
    begins, ends = F.transform("timings", lambda x: x["begin"]), F.transform("timings", lambda x: x["end"])
    return r.select(F.col("uid").alias("source_id"), pick(F.col("title")).alias("title"), pick(F.col("description")).alias("description"), _utc(F.array_min(begins)).alias("start_date"), _utc(F.array_max(ends)).alias("end_date"), F.size("timings").alias("n_timings"), F.col("location.name").alias("venue_name"), F.col("location.postalCode").alias("venue_zip"), (F.col("attendanceMode") == 2).alias("is_online"), (F.col("status") == 6).alias("is_cancelled"))


def ticketing(payloads: DataFrame, value: str) -> DataFrame:
    """Ticketing events: local or UTC times, EUR price ranges, on-sale time; rows that sell no event are left out."""
    schema = "_embedded struct<events: array<struct<id: string, name: string, url: string, dates: struct<start: struct<localDate: string, dateTime: string, timeTBA: boolean, noSpecificTime: boolean>, status: struct<code: string>>, priceRanges: array<struct<currency: string, min: double, max: double>>, classifications: array<struct<segment: struct<name: string>, genre: struct<name: string>>>, sales: struct<public: struct<startDateTime: string>>, _embedded: struct<venues: array<struct<name: string, postalCode: string>>>>>>"
    e = payloads.select(F.explode(F.from_json(value, schema)["_embedded"]["events"]).alias("e"))
    euro = F.filter("e.priceRanges", lambda p: p["currency"] == "EUR")
    cents = lambda x: F.bround(x.cast("decimal(12,3)") * 100, 0).cast("int")
    exact = F.col("e.dates.start.dateTime").isNotNull() & ~F.coalesce("e.dates.start.timeTBA", F.lit(False)) & ~F.coalesce("e.dates.start.noSpecificTime", F.lit(False))
    noon = F.convert_timezone(F.lit("Europe/Paris"), F.lit("UTC"), F.to_timestamp_ntz(F.concat("e.dates.start.localDate", F.lit(" 12:00:00"))))
    out = e.where(~F.col("e.name").rlike(r"(?iu)\b(parking|carte cadeau|gift card|assurance)\b"))
    return out.select(F.col("e.id").alias("source_id"), F.col("e.name").alias("title"), F.when(exact, _utc(F.col("e.dates.start.dateTime"))).otherwise(noon).alias("start_date"), exact.alias("time_known"), F.array_min(F.transform(euro, lambda p: cents(p["min"]))).alias("price_min"), F.array_max(F.transform(euro, lambda p: cents(p["max"]))).alias("price_max"), (F.col("e.dates.status.code") == "cancelled").alias("is_cancelled"), _utc(F.col("e.sales.public.startDateTime")).alias("on_sale_at"), F.get("e._embedded.venues", F.lit(0))["name"].alias("venue_name"))


def showtimes(rows: DataFrame) -> DataFrame:
    """(cinema, film, day, times, start_date) of screenings(cinema, film, at): one row a cinema, film and day."""
    day = F.to_date("at")
    g = rows.groupBy("cinema", "film", day.alias("day")).agg(F.sort_array(F.collect_set("at")).alias("ats"))
    return g.select("cinema", "film", "day", F.array_join(F.transform("ats", lambda x: F.date_format(x, "HH:mm")), ", ").alias("times"), F.element_at("ats", 1).alias("start_date"))


def cinema_days(payloads: DataFrame, value: str) -> DataFrame:
    """showtimes() of cinema programmes in JSON: films with their screenings by version."""
    schema = "cinema long, films array<struct<title: string, showtimes: map<string, array<struct<startsAt: string>>>>>"
    r = payloads.select(F.from_json(value, schema).alias("r")).select("r.cinema", F.explode("r.films").alias("f"))
    s = r.select("cinema", F.col("f.title").alias("film"), F.explode(F.flatten(F.map_values("f.showtimes"))).alias("s"))
    return showtimes(s.select("cinema", "film", _utc(F.col("s.startsAt")).alias("at")).where("at is not null"))


def artist_events(payloads: DataFrame, value: str) -> DataFrame:
    schema = "array<struct<id: string, datetime: string, on_sale_datetime: string, venue: struct<name: string, latitude: string, longitude: string, city: string>, lineup: array<string>>>"
    e = payloads.select(F.explode(F.from_json(value, schema)).alias("e"))
    local = F.convert_timezone(F.lit("Europe/Paris"), F.lit("UTC"), _utc(F.col("e.datetime")))
    return e.select(F.col("e.id").alias("source_id"), local.alias("start_date"), _utc(F.col("e.on_sale_datetime")).alias("on_sale_at"), F.col("e.venue.name").alias("venue_name"), F.col("e.venue.latitude").try_cast("double").alias("lat"), F.col("e.lineup").alias("artists"))


# ---------------------------------------------------------------- pandas UDFs


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields.items()])


@F.pandas_udf(T.StringType())
def clean_text(v: pd.Series) -> pd.Series:
    return v.map(parsing.clean_text)


@F.pandas_udf(_struct(min=T.IntegerType(), max=T.IntegerType(), is_free=T.BooleanType(), status=T.StringType()))
def price(v: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parsing.price(x) for x in v], columns=["min", "max", "is_free", "status"])


@F.pandas_udf(T.StringType())
def title_case(v: pd.Series) -> pd.Series:
    return v.map(lambda x: parsing.title_case(x or ""))


@F.pandas_udf(T.ArrayType(T.StringType()))
def title_artists(v: pd.Series) -> pd.Series:
    return v.map(lambda x: parsing.title_artists(x or ""))
