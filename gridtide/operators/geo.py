"""Nearest point by great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def nearest_point(places: DataFrame, points: list[tuple[str, float, float]]) -> DataFrame:
    """places (with lat, lon) and point, distance_km of the nearest; ties go to the first name.

    Points are a short list known beforehand, so each row compares them in place: no join, no shuffle, no UDF.
    """
    near = [F.struct(haversine_km(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)).alias("km"), F.lit(name).alias("name")) for name, lat, lon in points]
    best = F.least(*near) if len(near) > 1 else near[0]
    found = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), best)
    return places.withColumns({"point": found["name"], "distance_km": found["km"]})
