"""The driver's tables seen as a catalogue: outings, venues, categories, and a fixed moment."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.listing import CATEGORIES, with_dims

NOW = datetime(1998, 6, 15, 16, 0, tzinfo=UTC)
NOW_SQL = "timestamp '1998-06-15 16:00:00'"
# Words that titles, descriptions and keywords are made of here.
TITLES = ["Soirée jazz", "Récital de piano", "Exposition Monet", "Stand-up: l'impro", "Opéra pour enfants", "L’Invitation", "Métallos & metal", "Visite du jardin", "Forum senior", "Nuit électro DJ", "Théâtre 71"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores, where much is done with each: a table's row groups may be fewer."""
    n = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n)


def outings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as outings."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    title = F.concat(F.element_at(F.array(*map(F.lit, TITLES)), (k % 11 + 1).cast("int")), F.lit(" "), (k % 7).cast("string"))
    return o.select(
        k.alias("id"), title.alias("title"), F.concat(F.lit("o-"), k.cast("string")).alias("slug"), F.when(k % 4 != 0, F.concat(F.lit("En plein air, "), F.lower("o_orderpriority"))).alias("short_desc"),
        F.when(k % 5 == 0, F.lit("concert nocturne")).when(k % 5 == 1, F.lit("famille")).alias("keywords"), F.when(k % 6 != 0, F.concat(F.lit("img/"), (k % 50).cast("string"))).alias("image_url"),
        F.col("o_orderdate").alias("start_date"), F.when(k % 3 != 0, F.expr("o_orderdate + make_dt_interval(0, int(o_orderkey % 2400))")).alias("end_date"), (k % 8 != 0).alias("time_known"),
        F.when(k % 5 != 0, F.floor(F.col("o_totalprice")) % 9000).otherwise(0).cast("int").alias("price_min"), F.when(k % 5 != 0, F.floor(F.col("o_totalprice")) % 9000 + 500).otherwise(0).cast("int").alias("price_max"),
        F.when(k % 5 == 0, "free").when(k % 7 == 0, "unknown").otherwise("paid").alias("price_status"), F.when(F.col("o_orderstatus") == "F", "expired").otherwise("active").alias("status"),
        F.when(k % 13 == 0, k - 1).alias("canonical_id"), (k % 101).cast("int").alias("quality_score"), (k % 9).cast("int").alias("save_count"), (k % 301).cast("int").alias("view_count"),
        F.col("o_custkey").alias("venue_id"), (k % 14).cast("int").alias("category_id"), F.concat(F.lit("src"), (k % 4).cast("string")).alias("source"),
    )


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as venues; every 17th has no row."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.where(k % 17 != 0).select(
        k.alias("venue_id"), F.concat(F.element_at(F.array(F.lit("Théâtre "), F.lit("Le Grand "), F.lit("Galerie ")), (k % 3 + 1).cast("int")), F.col("c_name")).alias("venue_name"), F.concat(F.lit("v-"), k.cast("string")).alias("venue_slug"),
        F.when(F.col("c_nationkey").between(1, 20), F.concat(F.col("c_nationkey").cast("string"), F.when(F.col("c_nationkey") == 1, "er").otherwise("e"))).alias("arrondissement"),
        F.when(F.col("c_nationkey") == 0, "Montreuil").otherwise("Paris").alias("city"), F.when(F.col("c_nationkey") == 0, "93100").when(F.col("c_nationkey") > 20, None).otherwise(F.concat(F.lit("750"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))).alias("zip_code"),
        F.when(k % 10 != 0, 48.8 + (k % 97) * 0.002).alias("lat"), F.when(k % 10 != 0, 2.25 + (k % 89) * 0.002).alias("lng"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations 0 to 11 as categories."""
    slug = F.element_at(F.array(*map(F.lit, CATEGORIES)), F.col("n_nationkey") + 1)
    return read(spark, sf_dir, "nation").where("n_nationkey < 12").select(F.col("n_nationkey").alias("category_id"), slug.alias("category_slug"), F.initcap(slug).alias("category_name"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_dims(outings(spark, sf_dir), venues(spark, sf_dir), categories(spark, sf_dir))


def _list(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


OUTINGS_SQL = f"""
outings as (select o_orderkey id, ({_list(TITLES)})[o_orderkey % 11 + 1] || ' ' || (o_orderkey % 7) title, 'o-' || o_orderkey slug,
  case when o_orderkey % 4 <> 0 then 'En plein air, ' || lower(o_orderpriority) end short_desc,
  case o_orderkey % 5 when 0 then 'concert nocturne' when 1 then 'famille' end keywords, case when o_orderkey % 6 <> 0 then 'img/' || (o_orderkey % 50) end image_url,
  o_orderdate start_date, case when o_orderkey % 3 <> 0 then o_orderdate + to_hours(o_orderkey % 2400) end end_date, o_orderkey % 8 <> 0 time_known,
  (case when o_orderkey % 5 <> 0 then floor(o_totalprice)::bigint % 9000 else 0 end)::int price_min, (case when o_orderkey % 5 <> 0 then floor(o_totalprice)::bigint % 9000 + 500 else 0 end)::int price_max,
  case when o_orderkey % 5 = 0 then 'free' when o_orderkey % 7 = 0 then 'unknown' else 'paid' end price_status, case o_orderstatus when 'F' then 'expired' else 'active' end status,
  case when o_orderkey % 13 = 0 then o_orderkey - 1 end canonical_id, (o_orderkey % 101)::int quality_score, (o_orderkey % 9)::int save_count, (o_orderkey % 301)::int view_count,
  o_custkey venue_id, (o_orderkey % 14)::int category_id, 'src' || (o_orderkey % 4) source from orders)"""
DIMS_SQL = f"""
venues as (select c_custkey venue_id, (['Théâtre ', 'Le Grand ', 'Galerie '])[c_custkey % 3 + 1] || c_name venue_name, 'v-' || c_custkey venue_slug,
  case when c_nationkey between 1 and 20 then c_nationkey || case c_nationkey when 1 then 'er' else 'e' end end arrondissement,
  case c_nationkey when 0 then 'Montreuil' else 'Paris' end city, case when c_nationkey = 0 then '93100' when c_nationkey > 20 then null else '750' || lpad(c_nationkey::varchar, 2, '0') end zip_code,
  case when c_custkey % 10 <> 0 then 48.8::double + (c_custkey % 97) * 0.002::double end lat, case when c_custkey % 10 <> 0 then 2.25::double + (c_custkey % 89) * 0.002::double end lng from customer where c_custkey % 17 <> 0),
categories as (select n_nationkey category_id, ({_list(CATEGORIES)})[n_nationkey + 1] category_slug, n_nationkey from nation where n_nationkey < 12)"""
FOLD_SQL = "translate(lower({0}), 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
BASE = f"""with {OUTINGS_SQL}, {DIMS_SQL},
r as (select o.*, v.* exclude (venue_id), c.category_slug, coalesce(end_date, start_date + interval 2 hour) eff, coalesce(end_date > start_date + interval 12 hour, false) long_run,
  {FOLD_SQL.format("title || ' ' || coalesce(short_desc, '') || ' ' || coalesce(keywords, '')")} txt, {FOLD_SQL.format("v.venue_name")} vtxt
  from outings o left join venues v on o.venue_id = v.venue_id left join categories c on o.category_id = c.category_id),
live as (select * from r where status = 'active' and canonical_id is null and eff >= {NOW_SQL})"""


def _sunday(x: str, month: int, days: int) -> str:
    """The last Sunday of a month in the year of x."""
    last = f"make_date(year({x}), {month}, {days})"
    return f"({last} - (isodow({last}) % 7)::int)"


def summer_sql(x: str) -> str:
    """Whether the Paris day x (from three in the morning on) has summer time: from the last Sunday of March to that of October, before 1996 of September."""
    return f"(({x})::date >= {_sunday(x, 3, 31)} and ({x})::date < case when year({x}) < 1996 then {_sunday(x, 9, 30)} else {_sunday(x, 10, 31)} end)"


def paris_sql(x: str) -> str:
    """The wall clock in Paris of a UTC timestamp; the change is at one o'clock UTC."""
    y = f"({x} - interval 1 hour)"
    return f"({x} + case when {summer_sql(y)} then interval 2 hour else interval 1 hour end)"
