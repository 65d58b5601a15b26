"""Choosing among the answers of geocoders that landed as rows; nothing is fetched here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from .quality import DEPARTMENTS

# The least score of an address and of a name, kinds of features, classes of places that count, and kinds that do not.
LEAST_SCORE, LEAST_NAME_SCORE = 0.6, 0.5
KINDS = ("housenumber", "street", "locality")
PLACE_CLASSES = ("amenity", "leisure", "tourism", "building", "historic", "club", "shop", "office")
REJECTED_PLACES = ("parking", "bus_stop", "parking_entrance", "bicycle_parking", "atm", "bench", "post_box", "waste_basket", "toilets", "fuel", "charging_station")


def acceptable(by_name: Column) -> Column:
    """Whether a feature (score, kind, lat, lng, zip_code, street, venue_name) may stand for a venue; by_name: it was asked for by the venue's name alone, which must then hold the street's."""
    c = F.col
    fits = c("kind").isin(*KINDS) & geo.in_box(c("lat"), c("lng")) & F.substring("zip_code", 1, 2).isin(*DEPARTMENTS)
    street = text.words_of(c("street"))
    named = (F.length(street) >= 5) & F.contains(text.words_of(c("venue_name")), street)
    return F.coalesce(fits & F.when(by_name, named & (c("score") >= LEAST_NAME_SCORE)).otherwise(c("score") >= LEAST_SCORE), F.lit(False))


def chosen(features: DataFrame, key: str) -> DataFrame:
    """The first acceptable feature of each key: features(key, rank, score, kind, lat, lng, zip_code, street, venue_name)."""
    ok = features.where(acceptable(F.col("venue_name").isNotNull()))
    best = ok.groupBy(key).agg(F.min(F.struct("rank", "lat", "lng", "zip_code", "score", "kind")).alias("b"))
    return best.select(key, "b.rank", "b.lat", "b.lng", "b.zip_code", "b.score", "b.kind")


def chosen_places(places: DataFrame, key: str) -> DataFrame:
    """The first place of each key that has its name and lies in the zone: places(key, rank, class, kind, name, venue_name, venue_zip, lat, lng, zip_code)."""
    c = F.col
    name = text.normal_name(c("name")) == text.normal_name(c("venue_name"))
    zone = geo.in_box(c("lat"), c("lng")) & (c("zip_code").isNull() | F.substring("zip_code", 1, 2).isin(*DEPARTMENTS)) & (c("zip_code").isNull() | c("venue_zip").isNull() | (c("zip_code") == c("venue_zip")))
    ok = places.where(c("class").isin(*PLACE_CLASSES) & ~c("kind").isin(*REJECTED_PLACES) & name & zone)
    best = ok.groupBy(key).agg(F.min(F.struct("rank", "lat", "lng", "zip_code")).alias("b"))
    return best.select(key, "b.rank", "b.lat", "b.lng", "b.zip_code")
