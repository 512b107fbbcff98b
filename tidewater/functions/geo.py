"""Distances and coordinate checks as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: The box of valid coordinates (south, north, west, east).
BOX = (-37.5, -28.0, 141.0, 154.0)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(half, F.lit(1.0))))


def arc_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """By the law of cosines, the cosine clamped to [-1, 1]."""
    cosine = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2) - F.radians(lon1)) + F.sin(F.radians(lat1)) * F.sin(F.radians(lat2))
    return EARTH_KM * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float] = BOX) -> Column:
    return F.coalesce(lat.between(box[0], box[1]) & lon.between(box[2], box[3]), F.lit(False))


def price_check(price: Column, low: float = 80.0, high: float = 300.0) -> Column:
    """struct(ok, reason)."""
    reason = F.when(price.isNull(), "missing").when(price < low, "below minimum").when(price > high, "above maximum")
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def valid_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://[^\s/]+"), F.lit(False))
