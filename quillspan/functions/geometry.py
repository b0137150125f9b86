"""Distances on earth and between vectors, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.7714


def haversine(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Metres from a point to an origin."""
    a = F.pow(F.sin(F.radians(lat - lat0) / 2), F.lit(2.0)) + F.cos(F.radians(lat)) * math.cos(math.radians(lat0)) * F.pow(F.sin(F.radians(lon - lon0) / 2), F.lit(2.0))
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def within(point: Column, lat0: float, lon0: float, radius: float) -> Column:
    """Whether a point lies in a circle; a band of latitudes is asked first, since its test is cheap and prunes."""
    reach = math.degrees(radius / EARTH_M)
    lat, lon = point["lat"], point["lon"]
    return (lat >= lat0 - reach) & (lat <= lat0 + reach) & (haversine(lat, lon, lat0, lon0) <= radius)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(v: Column, q: Column) -> Column:
    return _sum(F.zip_with(v, q, lambda a, b: a.cast("double") * b))


def similarity(v: Column, query: tuple[float, ...], kind: str) -> Column:
    """Scores from 0: (1 + cosine) / 2, (1 + dot) / 2 or 1 / (1 + squared distance)."""
    q = F.array(*(F.lit(float(x)) for x in query))
    if kind == "euclidean":
        return 1 / (1 + _sum(F.zip_with(v, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))))
    if kind == "dot_product":
        return (1 + dot(v, q)) / 2
    norm = math.sqrt(sum(x * x for x in query))
    return (1 + dot(v, q) / (F.sqrt(dot(v, v.cast("array<double>"))) * norm)) / 2
