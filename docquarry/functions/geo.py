"""Distances: great circles and cosines."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6_371_000.0


def haversine(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    p, q = math.radians(lat1), math.radians(lat2)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * EARTH_METRES * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def haversine_column(lat: Column, lng: Column, lat0: float, lng0: float) -> Column:
    """Metres from a point to (lat0, lng0)."""
    p, q = F.radians(lat), F.lit(math.radians(lat0))
    h = F.pow(F.sin((p - q) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lng - F.lit(lng0)) / 2), 2)
    h = F.when(h > 1, 1.0).when(h < 0, 0.0).otherwise(h)  # greatest and least would turn a null into a number
    return 2 * EARTH_METRES * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_column(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one length; zero if either has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)
