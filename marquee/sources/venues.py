"""Sites described by a configuration: what kind of payload each has, and cards that detail pages complete."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from . import readers

COLUMNS = ("title", "start_date", "time_known", "venue_name", "is_cancelled")


def _written(rows: DataFrame) -> DataFrame:
    at = labels.instant(F.col("start_date"), midnight_unknown=True)
    return rows.withColumn("_w", at).withColumns({"start_date": F.col("_w.at"), "time_known": F.col("_w.time_known")})


KINDS = {
    "jsonld": lambda p: _written(readers.jsonld(p, "key", "value")),
    "microdata": lambda p: _written(readers.microdata(p, "key", "value").withColumn("is_cancelled", F.lit(False))),
    "ics": lambda p: readers.icalendar(p, "key", "value"),
}


def by_kind(payloads: DataFrame, config: DataFrame) -> DataFrame:
    """key, kind, title, start_date, time_known, venue_name and is_cancelled of payloads(site, key, value), each read as config(site, kind) says; sites without a kind give no rows."""
    held = payloads.join(config, "site").select("key", "value", "kind")
    read = lambda kind: KINDS[kind](held.where(F.col("kind") == kind)).select("key", F.lit(kind).alias("kind"), *COLUMNS)
    return reduce(DataFrame.unionByName, map(read, KINDS))


def completed(cards: DataFrame, details: DataFrame, key: str = "url") -> DataFrame:
    """Cards of listings with what their detail pages say, which goes first; an event that neither dates is left out.

    Midnight is no known time, and a price of zero on a page that does not say free is unknown. Cards keep their columns.
    """
    new = details.dropDuplicates([key]).select(key, *(F.col(c).alias(f"_{c}") for c in details.columns if c != key and c in cards.columns))
    out = cards.dropDuplicates([key]).join(new, key, "left")
    out = out.select(key, *((F.coalesce(f"_{c}", c) if f"_{c}" in new.columns else F.col(c)).alias(c) for c in cards.columns if c != key)).where("start_date is not null")
    return out.withColumns({c: x for c, x in _doubtful().items() if c in out.columns})


def _doubtful() -> dict[str, Column]:
    unsaid = (F.col("price_min") == 0) & (F.col("price_max") == 0) & (F.col("price_status") != "free")
    return {
        "time_known": F.col("time_known") & (F.date_format("start_date", "HH:mm") != "00:00"), "price_min": F.when(~F.coalesce(unsaid, F.lit(False)), F.col("price_min")),
        "price_max": F.when(~F.coalesce(unsaid, F.lit(False)), F.col("price_max")), "price_status": F.when(F.coalesce(unsaid, F.lit(False)), "unknown").otherwise(F.col("price_status")),
    }
