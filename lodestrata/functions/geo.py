"""Geography on doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    half_lat, half_lon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def cell_key(lat: Column, lon: Column) -> Column:
    """The tenth-of-a-degree cell, ``row:column``; null without a location."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat_ws(":", F.floor(lat * 10.0).cast("string"), F.floor(lon * 10.0).cast("string")))


def unit_sphere(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """x, y, z on the unit sphere."""
    return F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def degrees(dms: Column, hemisphere: Column) -> Column:
    """Degrees from ``d/n,m/n,s/n`` and a hemisphere; null for a zero denominator or a value out of range; six decimals."""
    parts = F.transform(F.split(dms, ","), lambda p: F.try_divide(F.element_at(F.split(p, "/"), 1).try_cast("double"), F.coalesce(F.get(F.split(p, "/"), F.lit(1)), F.lit("1")).try_cast("double")))
    value = F.get(parts, F.lit(0)) + F.get(parts, F.lit(1)) / 60.0 + F.get(parts, F.lit(2)) / 3600.0
    limit = F.when(F.upper(hemisphere).isin("N", "S"), 90.0).when(F.upper(hemisphere).isin("E", "W"), 180.0)
    return F.when(value.between(F.lit(0.0), limit), F.round(F.when(F.upper(hemisphere).isin("S", "W"), -value).otherwise(value), 6))


def iso6709(text: Column) -> tuple[Column, Column]:
    """(lat, lon) of ``+DD.D+DDD.D[+alt]/``, null if it isn't one or is out of range."""
    pattern = r"^([+-]\d{2}(?:\.\d+)?)([+-]\d{3}(?:\.\d+)?)(?:[+-]\d+(?:\.\d+)?)?/?$"
    lat, lon = (F.regexp_extract(text, pattern, i).try_cast("double") for i in (1, 2))
    sound = (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return F.when(sound, lat), F.when(sound, lon)
