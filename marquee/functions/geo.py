"""Distances, boxes and grid cells as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
KM_PER_DEGREE = 111.32

# The service zone and the wider region (south, north, west, east).
ZONE = (48.70, 49.01, 2.14, 2.64)
REGION = (48.12, 49.24, 1.44, 3.56)


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    s = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.when(s > 1, 1.0).otherwise(s)))  # null if a coordinate is


def flat_km(lat: Column, lng: Column, at_lat: float, at_lng: float) -> Column:
    """Equirectangular distance to a point."""
    return KM_PER_DEGREE * F.sqrt(F.pow(lat - at_lat, 2) + F.pow((lng - at_lng) * math.cos(math.radians(at_lat)), 2))


def in_box(lat: Column, lng: Column, box: tuple[float, float, float, float] = ZONE) -> Column:
    south, north, west, east = box
    return lat.between(south, north) & lng.between(west, east)


def near(lat: Column, lng: Column, at_lat: float, at_lng: float, km: float) -> Column:
    """A box that the scan can prune by, then the exact distance."""
    d_lat = km / KM_PER_DEGREE
    d_lng = km / (KM_PER_DEGREE * math.cos(math.radians(at_lat)))
    return lat.isNotNull() & in_box(lat, lng, (at_lat - d_lat, at_lat + d_lat, at_lng - d_lng, at_lng + d_lng)) & (flat_km(lat, lng, at_lat, at_lng) <= km)


def cell(lat: Column, lng: Column, d_lat: float = 0.0015, d_lng: float = 0.0022) -> tuple[Column, Column]:
    return F.floor(lat / d_lat).cast("long"), F.floor(lng / d_lng).cast("long")


def neighbours(i: Column, j: Column, reach: int = 1) -> Column:
    """array<struct<i, j>> of a cell and those around it; explode it on one side of a join."""
    steps = range(-reach, reach + 1)
    return F.array(*(F.struct((i + a).alias("i"), (j + b).alias("j")) for a in steps for b in steps))
